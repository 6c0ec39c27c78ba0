import random

import sentencepiece

import corpus_pipeline
from skein.llm import stages
from skein.llm.sentencepiece import MODEL

from .test_decontamination import brute as overlaps
from .test_simhash import grouped


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix", "benchmark", "sentencepiece"]


def kept_texts(rows):
    """What suffix deduplication leaves, one string at a time."""
    first, out = {}, {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    for i, t in rows:
        b = t.encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                cover[p : p + 50] = b"\1" * 50
        out[i] = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode("utf-8", "ignore")
    return out


def test_run_against_brute_force(spark, tmp_path, words):
    rng = random.Random(1)
    items = [(k, " ".join(words(25, 70 + k))) for k in range(4)]
    passage = " ".join(words(60, 5))
    clean = [(k, " ".join(words(rng.randrange(60, 200)))) for k in range(80)]
    clean = [(i, t + " " + passage if i % 10 == 3 else t) for i, t in clean]
    dirty = [(200 + k, " ".join(items[k % 4][1].split()[:12] + ["new"] + items[k % 4][1].split()[13:]) + " " + " ".join(words(50))) for k in range(8)]
    copies = [(300 + k, clean[k][1] if k % 2 else clean[k][1].upper()) for k in range(10)]
    junk = [(400 + k, " ".join(w.upper() + "!!%%" for w in words(60))) for k in range(12)]
    rows = clean + dirty + [(i, t) for i, t in copies if not t.isupper()] + junk
    rng.shuffle(rows)
    spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keep int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    # the classifier: junk goes, nothing else does
    left = [(i, t) for i, t in rows if i < 400]
    groups = grouped(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    texts = kept_texts(left)
    hit = {d for d, _ in overlaps(list(texts.items()), items)}
    want = {i: t for i, t in texts.items() if i not in hit}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert out == {i: library.encode(t) for i, t in want.items()}
    assert len(hit) >= 4 and len(want) >= 70 and any(texts[i] != t for i, t in left)


def test_every_stage_but_the_last_returns_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", None, "s", 0), (None, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_bytes int")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert tuple(out.columns) == stages.COLUMNS, name
        # rows without an id are judged by their texts: null and empty ones are copies, and those of document 2 are its copies
        assert out.count() == (2 if name == "simhash" else 5), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_of_one_id_and_rows_without_one(spark, documents, words):
    """Different texts of one doc_id all stay, true repeats and near copies of a smaller id go; rows without an id are judged too."""
    from skein.llm import stages

    a, b, c = (" ".join(words(80, 900 + k)) for k in range(3))
    rows = [(1, a), (1, b), (1, a), (2, b), (None, c), (None, c), (None, a), (3, "")]
    left = stages.near_duplicates(spark, documents(rows).select(*stages.COLUMNS), "")
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in left.collect()) == sorted([(1, a), (1, b), (-1, c), (3, "")])
