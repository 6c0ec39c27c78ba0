from skein.llm import url_filter


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, 0.5) for k, u, h in rows], "page_id long, url string, html string, trust double")


def judged(spark, rows):
    return {r["page_id"]: r for r in url_filter.judge(pages(spark, rows)).collect()}


def rank(seed, edges, hosts, rounds=200):
    """Unnormalised personalised PageRank, one host at a time."""
    total = {}
    for a, _, n in edges:
        total[a] = total.get(a, 0) + n
    x = {h: 0.15 * seed.get(h, 0.0) for h in hosts}
    for _ in range(rounds):
        x = {h: 0.15 * seed.get(h, 0.0) + 0.85 * sum(x[a] * n / total[a] for a, b, n in edges if b == h) for h in hosts}
    return x


def test_rules(spark):
    urls = {
        1: ("HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
        3: ("https://badnet/x", "badnet", "/x", None, "allow"),
        4: ("https://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        5: ("https://myexample.com/de/1", "myexample.com", "/de/1", None, "allow"),
        6: ("https://x.org/fr/?a=/b", "x.org", "/fr/", "org/fr/", "allow"),
        7: ("https://x.net?x=/", "x.net", "", None, "allow"),
        8: (None, "", "", None, "allow"),
        9: ("no scheme/here", "", "", None, "allow"),
        10: ("https://y.net", "y.net", "", None, "allow"),
        11: ("ftp://Ä.net/x://y", "Ä.net", "/x://y", "net/", "block"),
        12: ("https://x.org#/fr/", "x.org", "", None, "allow"),
        13: ("", "", "", None, "allow"),
        14: ("https://x.org/fr?x", "x.org", "/fr", None, "allow"),
    }
    out = judged(spark, [(k, v[0], None) for k, v in urls.items()])
    for k, (_, host, path, rule, verdict) in urls.items():
        r = out[k]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), k


def test_links_spread_distrust_backward_and_trust_forward(spark):
    link = lambda *h: "".join(f'<p><A class="x" href="http://{x}/a?b">t</A>' for x in h)
    rows = [
        (1, "http://farm.com/1", link("bad.net", "worse.net")),
        (2, "http://mixed.com/1", link("bad.net", "good.com", "fine.com")),
        (3, "http://good.com/1", link("fine.com")),
        (4, "http://bad.net/1", link("farm.com", "good.com")),
        (5, "http://worse.net/1", "<a href='/self'>x</a>"),
        (6, "http://seed.org/fr/1", link("saved.com")),
        (7, "http://saved.com/1", link("bad.net")),
        (8, "http://fine.com/1", None),
    ]
    out = judged(spark, rows)
    edges = [("farm.com", "bad.net", 1), ("farm.com", "worse.net", 1), ("mixed.com", "bad.net", 1), ("mixed.com", "good.com", 1), ("mixed.com", "fine.com", 1), ("good.com", "fine.com", 1), ("bad.net", "farm.com", 1), ("bad.net", "good.com", 1), ("seed.org", "saved.com", 1), ("saved.com", "bad.net", 1)]
    hosts = {h for e in edges for h in e[:2]}
    trust = rank({"seed.org": 1.0}, edges, hosts)
    distrust = rank({"bad.net": 1.0, "worse.net": 1.0}, [(b, a, n) for a, b, n in edges], hosts)
    for r in out.values():
        assert abs(r["trust"] - trust[r["host"]]) < 1e-6 and abs(r["distrust"] - distrust[r["host"]]) < 1e-6
        by_method = "block" if distrust[r["host"]] - trust[r["host"]] > 0.075 else "allow"
        assert r["verdict"] == {"net/": "block", "org/fr/": "allow"}.get(r["rule"], by_method)
    assert (out[1]["verdict"], out[3]["verdict"], out[8]["verdict"]) == ("block", "allow", "allow")


def test_partly_blocked_host_keeps_its_other_pages(spark):
    rows = [(1, "http://e.example.com/de/1", "")] + [(k, f"http://e.example.com/en/{k}", "") for k in range(2, 6)]
    out = judged(spark, rows)
    assert [out[k]["verdict"] for k in range(1, 6)] == ["block"] + ["allow"] * 4


def test_empty_and_repeated(spark):
    assert url_filter.judge(pages(spark, [(1, "", "")]).limit(0)).count() == 0
    assert url_filter.judge(pages(spark, [(None, "http://a.net/", None)] * 3)).count() == 3


def test_relative_links_and_bases(spark):
    rows = [
        (1, "http://a.com/1", '<a href="/x">s</a><a href="//B.com/y">o</a><a href="mailto:x@c.com">m</a><a href="#top">t</a><a class=k href=rel?u=http://d.com>r</a>'),
        (2, "http://b.com/1", '<base href="https://e.com/dir/"><a href="page">p</a><a data-href="http://f.com/" name=n>n</a>'),
        (3, "http://c.com/1", None),
    ]
    pages_of = pages(spark, rows)
    host, path = url_filter.host_and_path(pages_of["url"])
    got = {(r["src"], r["dst"], r["n"]) for r in url_filter.host_edges(pages_of.select(host.alias("host"), "html")).collect()}
    assert got == {("a.com", "b.com", 1), ("b.com", "e.com", 1)}


def test_slow_cycle_reaches_its_fixed_point(spark):
    # two hosts that give each other all their links: distrust 0.15 / (1 - 0.85 ** 2) at the seed
    link = lambda h: f'<a href="http://{h}/">x</a>'
    out = judged(spark, [(1, "http://bad.net/", link("two.com")), (2, "http://two.com/", link("bad.net"))])
    assert abs(out[1]["distrust"] - 0.15 / (1 - 0.85**2)) < 1e-6 and abs(out[2]["distrust"] - 0.85 * 0.15 / (1 - 0.85**2)) < 1e-6
    assert out[2]["verdict"] == "block"
