import html
import re

from skein.llm import html_text
from skein.llm.html_text import extract

PAGE = """<html><body><header class=top><h1>Site</h1><p>Top menu text, with, commas, a, b, c</p></header>
<div id="sidebar"><p>Side, text, here</p></div>
<div class="content"><h2>Title &amp; more</h2><p>First  para,
 with <a href=x>a link</a>, and commas, and so on, quite long text to get points for it.<div>inner div text</div><p>Second para
 &lt;b&gt; &nbsp; x<ul><li>one<li>two</ul><script>if (a<b) {"<p>no</p>"}</script><form><p>Form, text</p></form></div>
<div class="comments"><p>Reader, comment, very, long, with, many, commas, and, so, on, and, on</p></div><footer>foot</footer></body></html>"""


def test_article_without_the_rest():
    assert extract(PAGE) == "Title & more\nFirst para, with a link, and commas, and so on, quite long text to get points for it.\ninner div text\nSecond para <b> x\none\ntwo"


def test_odd_pages():
    assert extract(None) == extract("") == extract("<div><script>x</script></div>") == ""
    assert extract("just text") == "just text"
    assert extract("<p>a<p>b") == "a\nb"
    assert extract("<p>a < b &amp;&amp; c</p>") == "a < b && c"
    assert extract("<div>" * 3000 + "x" + "</div>" * 10) == "x"
    assert extract("<p>x<!-- not closed <p>y</p>") == "x"
    assert extract("<article><p><b>One.<br><p>Two</p></article><footer>&copy; me") == "One.\nTwo"
    long = ", ".join(f"w{k}" for k in range(50_000))
    assert extract(f"<body><nav><a>m</a></nav><article><p>{long}</p></article></body>") == long


def test_names_in_and_around_an_article():
    page = '<div id="{}"><article class="post share"><div class="entry-header"><h1>Head</h1></div><p>One, two.</p><article class="comment"><p>Mine, too.</p></article></article></div>'
    assert extract(page.format("main")) == "Head\nOne, two."
    assert extract(page.format("has-sidebar")).startswith("Head\nOne, two.")


def test_attribute_names_are_compared_whole():
    text = "<p>One, two.</p>"
    for attrs in ('style="overflow:hidden"', 'title="hidden gems"', 'data-hidden="false"', 'data-id="related-1"', "data-class=sidebar", 'title="class=\'menu\' id=ad"', 'data-role="dialog"', "data-x=hidden", 'alt="a > b hidden"', 'data-aria-hidden="true"'):
        assert extract(f"<body><div {attrs}>{text}</div></body>") == "One, two.", attrs
    for attrs in ("hidden", 'class="x" hidden', "hidden=''", 'HIDDEN', 'a="1"hidden', 'aria-hidden="true"', "role=dialog", 'class = "menu"', "id='ad'", "data-x=1 id=related-1"):
        assert extract(f"<body><div {attrs}>{text}</div><p>Three.</p></body>") == "Three.", attrs


def test_a_long_section_does_not_hide_its_article():
    long, short = "word, " * 1000 + "end.", "Some, more, words, " + "and so on " * 28 + "here."
    rest = f"<section><p>{short}</p></section><ul><li>Item</li></ul><pre>code</pre><table><tr><td>cell</td></tr></table><p>Short end.</p>"
    want = f"T\n{long}\n{short}\nItem\ncode\ncell\nShort end."
    for tag in ("section", "blockquote", "div"):
        inner = f"<h1>T</h1><{tag}><p>{long}</p></{tag}>{rest}"
        menu = '<ul><li><a href="/a">A link</a></li><li><a href="/b">Another link</a></li></ul>'
        for page in (f"<article>{inner}</article>", f"<main>{inner}</main>", f"<div>{menu}{inner}{menu}</div>"):
            assert extract(f"<body><nav>m</nav>{page}</body>") == want, (tag, page[:40])
    assert extract(f"<table><tr><th>Head</th></tr><tr><td>One.</td><td><p>{long}</p></td></tr><tr><td>Two.</td></tr></table><p>After.</p>") == f"Head\nOne.\n{long}\nTwo.\nAfter."
    assert extract(f"<div><h1>T</h1><div><section><p>{long}</p></section></div>Bare.<p>Short end.</p></div>") == f"T\n{long}\nBare.\nShort end."


def test_link_lists_lose_to_text():
    menu = "".join(f'<p><a href="/{k}">A link, with, commas, number, {k}</a></p>' for k in range(30))
    assert extract(f"<div><div>{menu}</div><div><p>The article, which has some words.</p><p>And more, of them.</p></div></div>") == "The article, which has some words.\nAnd more, of them."


def test_pages_of_the_smallest_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r["page_id"]: r for r in html_text.main_text(pages.withColumn("text", pages["url"])).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in blocks if x)
        assert (out[r["page_id"]]["text"], out[r["page_id"]]["n_chars"]) == (want, len(want))


def test_nulls_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_all_sections_of_an_article_and_what_stands_beside(words):
    long = ", ".join(words(400, 5))
    pages = {
        f"<article><h1>T</h1><section><p>{long}</p></section><section><p>Short, closing section.</p></section><p>End.</p></article>": f"T\n{long}\nShort, closing section.\nEnd.",
        f"<body><div>{long}</div><p>Closing line.</p></body>": f"{long}\nClosing line.",
        f"<body><div class=content>{long}</div><div class=content>Second.</div></body>": f"{long}\nSecond.",
        f"<article><p>{long}</p><div class='related-work'>Kept.</div><div class='related-posts'>x</div><div class=ad>y</div></article>": f"{long}\nKept.",
    }
    for page, text in pages.items():
        assert html_text.extract(page) == text


COMMENT_PARTS = ("class='reader-comments'", "class='user-comments'", "class='post-comments-area'", "class='responses'", "class=commentList", "id=comments-section", "class='article__comments'", "class='c-box comments--open'", "id=respond", "class='comment-body'", "class='replies'", "role=comment", "itemprop=comment", "itemscope itemtype='https://schema.org/Comment'", "id=disqus_thread", "class=ReaderComments")
NO_COMMENT_PARTS = ("class='has-comments'", "class='entry no-comments'", "class='comments-closed'", "class='comment-policy'", "id='responses-of-cells'", "class='in-reply-to'", "class=commentary", "data-comments=4", "class='commented-code'")


def test_reader_comments_inside_and_beside_an_article(words):
    """Threads of several depths under any of their usual names, against what the article was made of."""
    import random

    rng = random.Random(8)
    line = lambda n: " ".join(words(rng.randrange(3, n)))

    def thread(depth):
        said = "".join(f"<li><span class=author>{line(4)}</span><time>{line(4)}</time><p>{line(90)}</p>{thread(depth - 1) if depth and rng.random() < 0.5 else ''}</li>" for _ in range(rng.randrange(1, 5)))
        return f"<h3>{line(4)}</h3><ol>{said}</ol>"

    for part in COMMENT_PARTS * 3:
        tag = rng.choice(("div", "section", "ul"))
        texts = [line(80) for _ in range(rng.randrange(1, 6))]
        body = "".join(f"<p>{x}</p>" for x in texts)
        comments = f"<{tag} {part}>{thread(2)}</{tag}>"
        for page in (f"<article>{body}{comments}</article>", f"<article><div>{body}<div>{comments}</div></div></article>", f"<main><article>{body}</article>{comments}</main>", f"<article>{body}</article>{comments}"):
            assert extract(f"<body><nav>m</nav>{page}<footer>f</footer></body>") == "\n".join(texts), (part, page[-200:])


def test_names_that_only_sound_like_comments():
    for part in NO_COMMENT_PARTS:
        assert extract(f"<article><p>One.</p><div {part}><p>Two, three.</p></div></article>") == "One.\nTwo, three.", part
    assert extract("<article><h2 id='comments-on-the-plan'>Comments on the plan</h2><p>One.</p></article>") == "Comments on the plan\nOne."


def test_extra_columns_of_the_same_names(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "theirs", 9, "y")], "page_id long, url string, html string, text string, n_chars int, found string")
    assert [tuple(r) for r in html_text.main_text(pages).select("page_id", "url", "text", "n_chars").collect()] == [(1, "u", "x", 1)]


def test_ties_between_containers():
    a, b = "<p>One, two, three, four.</p>", "<p>Aaa, bbb, ccccc, dddd.</p>"
    assert extract(f"<body><div>{a}</div><div>{b}</div></body>") == "One, two, three, four.\nAaa, bbb, ccccc, dddd."
    assert extract(f"<article>{a}</article><article>{b}</article>").startswith("One, two, three, four.")


def test_generated_pages(words):
    """Articles of several sections among parts that are left out, against what they were made of."""
    import random

    rng = random.Random(4)
    line = lambda n: " ".join(words(rng.randrange(2, n)))
    junk = ("<nav><a href=/a>%s</a></nav>", "<div class='ad box'>%s</div>", "<aside><p>%s</p></aside>", "<form><label>%s</label></form>", "<script>%s</script>", "<div id=comments><p>%s</p></div>", "<style>%s</style>", "<div role=alert>%s</div>", "<!-- %s -->")
    for _ in range(200):
        want, body = [], ""
        for _ in range(rng.randrange(1, 5)):
            part = ""
            for _ in range(rng.randrange(1, 6)):
                kind = rng.choice(("p", "h2", "pre", "blockquote", "li", "td"))
                text = line(60)
                want.append(text)
                inner = text.replace(" ", rng.choice((" ", "\n ", "&#32;", " <b>", "</i> ")), 1)
                block = f"<{kind}>{inner}</{kind}>"
                part += {"li": f"<ul>{block}</ul>", "td": f"<table><tr>{block}</tr></table>"}.get(kind, block)
                if rng.random() < 0.3:
                    part += rng.choice(junk) % line(30)
            body += f"<section>{part}</section>" if rng.random() < 0.7 else part
        out = lambda: "".join(rng.choice(junk) % line(200) for _ in range(rng.randrange(4)))
        page = f"<html><head><title>{line(9)}</title></head><body>{out()}<article>{body}</article>{out()}<footer>{line(30)}</footer></body></html>"
        assert html_text.extract(page) == "\n".join(want)


def test_time_grows_with_the_length():
    import time

    for make in (lambda k: '<a href="x ' * k, lambda k: "<b>" * k + "<p>x" * k, lambda k: "<div>" * k + "x", lambda k: "<p>a</i></b>" * k):
        began = time.time()
        html_text.extract(make(3000))
        assert time.time() - began < 3
