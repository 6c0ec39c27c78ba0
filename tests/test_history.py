from skein.operators import evidence


def test_each_finding_takes_its_own_new_hash(spark):
    old, new = ["a" * 40, "b" * 40], ["c" * 40, "d" * 40]
    commits = spark.createDataFrame([(k, h) for k, h in enumerate(old)], "id long, commit_hash string")
    rewrites = spark.createDataFrame(list(zip(old, new, strict=True)), "old_hash string, new_hash string")
    # one record's field has two values, and some are no hashes
    findings = spark.createDataFrame([(1, "sha", "AAAAAAAA"), (1, "sha", "b" * 40), (2, "sha", "no hash"), (3, "sha", None), (4, "sha", "e" * 9)], "id long, field string, value string")
    prior = spark.createDataFrame([], "old_hash string, commit_id long")
    _, found, _ = evidence.remap_history(commits, rewrites, findings, prior)
    got = sorted(((r["id"], r["value"]) for r in found.collect()), key=repr)
    assert got == [(1, new[0]), (1, new[1]), (2, "no hash"), (3, None), (4, "e" * 9)]
