"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts are lower-cased and cut to words, words become 64-bit hashes, and fixed masks over four or five neighbouring
words (some ignored) become seed hashes.  The seeds of all documents meet those of the benchmark in a hash join; each
meeting fixes an alignment of the item to the document, and the words of that alignment are compared one by
one.  A document is contaminated if, in some alignment, a window of min(n, max(13, n / 2)) consecutive words of the item's n
words has at least four fifths of them equal (the others are substituted), or if min(n, 13) consecutive words are all
equal, however long the item: an excerpt of a long item counts as one of a short item does.  An item of fewer than
LEAST_WORDS words is no evidence within other text: it counts where a document holds its words and nothing else.

The masks lose nothing: every window of at least five words with at most a fifth of its words substituted holds a
place where one of the masks sees only equal words (checked for lengths 5 to 25; a longer window contains such a one).

Such a window holds more than one seed, so an alignment needs LEAST_SEEDS of them before its words are looked at: seeds
are counted per alignment with map-side partial sums, and only documents with such an alignment are read again.

Only the benchmark's seeds are broadcast, in blocks of at most SEEDS_AT_ONCE rows, one pass over the documents for
each block.  Long texts are cut to overlapping runs of RUN words before their seeds are made, so a task's memory
does not grow with a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Word offsets that each mask looks at.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
LEAST_WORDS = 5
WINDOW = 13
#: Seeds that a window of so many words holds at least with a fifth of them substituted; longer ones hold at least LONG_SEEDS.
LEAST_SEEDS = {5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 2, 11: 4, 12: 6}
LONG_SEEDS = 6
#: Words of a text whose seeds are made at once.
RUN = 2048
#: Equal words per WHOLE words of a window.
EQUAL, WHOLE = 4, 5
#: Rows of one broadcast: about 60 bytes each.
SEEDS_AT_ONCE = 400_000
_SPACE = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; null or blank: none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t\n\x0b\f\r]+"))


def seeds(texts: DataFrame, key: str) -> DataFrame:
    """(key, at, seed): every mask at every word of texts(key, words)."""
    span = 1 + max(max(m) for m in MASKS)
    runs = texts.where(F.size("words") > max(MASKS[0])).select(key, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(RUN))).alias("base"))
    runs = runs.select(key, "base", F.slice("words", F.col("base") + 1, F.lit(RUN + span - 1)).alias("run"))
    runs = runs.select(key, "base", F.transform("run", lambda w: F.xxhash64(w)).alias("run"))
    shifted = F.arrays_zip(*[(F.col("run") if k == 0 else F.slice("run", k + 1, F.greatest(F.size("run") - k, F.lit(0)))).alias(f"w{k}") for k in range(span)])
    at = runs.select(key, "base", F.posexplode(shifted).alias("at", "w")).where(F.col("at") < RUN)
    each = F.array(*[F.when(F.col(f"w.w{m[-1]}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"w.w{k}") for k in m])) for n, m in enumerate(MASKS)])
    return at.select(key, (F.col("base") + F.col("at")).alias("at"), F.explode(each).alias("seed")).where("seed is not null")


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start): alignments with seeds enough, of docs(doc_id, words) and a stored table items(item_id, words, seeds)."""
    of_items = stored(seeds(items, "item_id").select("item_id", F.col("at").alias("item_at"), "seed").join(items.select("item_id", "seeds"), "item_id"))
    blocks = max(1, -(-of_items.count() // SEEDS_AT_ONCE))
    found = None
    for k in range(blocks):
        some = of_items.where(F.pmod(F.xxhash64("item_id", "item_at"), F.lit(blocks)) == k) if blocks > 1 else of_items
        # the seeds are dealt evenly by hash, so a block is about SEEDS_AT_ONCE rows; one that is not goes by a shuffle
        side = F.broadcast(some) if blocks == 1 or some.count() <= 2 * SEEDS_AT_ONCE else some
        hits = seeds(docs, "doc_id").join(side, "seed").groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("seeds").alias("seeds"))
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("doc_id", "item_id", "start").agg(F.sum("n").alias("n"), F.first("seeds").alias("seeds"))
    return found.where("n >= seeds").select("doc_id", "item_id", "start")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, equal_words) of documents(doc_id, text) and benchmark(item_id, text).

    One row per document and item that overlap as described above; equal_words: the most equal words of an alignment.
    Null and blank texts overlap with nothing, items of under five words only with documents of the same words, repeated
    rows count once, a null id is an id like others, empty tables give no rows, other columns are ignored.
    """
    size = F.size("words")
    window = F.least(size, F.greatest(F.lit(WINDOW), F.ceil(size / 2))).cast("int")
    least = F.lit(LONG_SEEDS)
    for n, x in LEAST_SEEDS.items():
        least = F.when(window == n, x).otherwise(least)
    given = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")).where(size > 0).distinct().select("*", window.alias("window"), least.alias("seeds")))
    items, short = given.where(size >= LEAST_WORDS), given.where(size < LEAST_WORDS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(alignments(docs.select("doc_id", words_of(F.col("text")).alias("words")), items))
    # documents are read again only where an alignment was found; ids may be null
    named = found.select(F.col("doc_id").alias("id"), "item_id", "start")
    again = docs.join(named.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("doc_id", words_of(F.col("text")).alias("doc_words"))
    pairs = named.join(items.withColumnRenamed("item_id", "of"), F.col("item_id").eqNullSafe(F.col("of"))).drop("of").join(again, F.col("doc_id").eqNullSafe(F.col("id")))
    same = F.transform("words", lambda w, i: F.when(F.get("doc_words", F.col("start") + i) == w, "1").otherwise("0"))
    pairs = pairs.select("doc_id", "item_id", "window", F.size("words").alias("n"), F.array_join(same, "").alias("equal"))
    verbatim = F.contains("equal", F.repeat(F.lit("1"), F.least("n", F.lit(WINDOW))))
    enough = verbatim | F.exists(F.sequence(F.lit(1), F.col("n") - F.col("window") + 1), lambda i: F.length(F.replace(F.substr("equal", i, F.col("window")), F.lit("0"), F.lit(""))) * WHOLE >= F.col("window") * EQUAL)
    out = pairs.where(enough).groupBy("doc_id", "item_id").agg(F.max("n").alias("item_words"), F.max(F.length(F.replace("equal", F.lit("0"), F.lit("")))).alias("equal_words"))
    if short.isEmpty():
        return out
    whole = docs.select("doc_id", words_of(F.col("text")).alias("words")).where(size < LEAST_WORDS).join(short.select("item_id", "words"), "words")
    return out.unionByName(whole.select("doc_id", "item_id", size.alias("item_words"), size.alias("equal_words")).distinct())


__all__ = ["contaminated", "alignments", "seeds", "words_of"]
