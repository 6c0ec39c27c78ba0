"""Best-first navigation of a graph for many questions at once, without a model's judgement.

Each question keeps a bounded set of evidence: its seeds, which nothing displaces, and what has been found from them.  A
round expands, for every question that goes on, the one item of best score that has not been expanded, scores what lies beside it,
and cuts the evidence to its bound.  Frontiers are stored between rounds, so a round costs one join of the chosen items with
the edges, however many questions there are; ends and order are fixed by score and id alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled
from .graph import both_ways

#: Expansions of a question, items that it keeps, and neighbours that one expansion takes in.
EVALUATIONS, EVIDENCE, BESIDE = 8, 24, 32


@dataclass
class Report:
    """evidence (question, place, id, score, protected, round), trace (question, round, id, score), stops (question, stop)."""

    evidence: DataFrame
    trace: DataFrame
    stops: DataFrame


def navigate(
    nodes: DataFrame, edges: DataFrame, questions: DataFrame, seeds: DataFrame, score: Callable[[Column, Column], Column], evaluations: int = EVALUATIONS, evidence: int = EVIDENCE, beside: int = BESIDE
) -> Report:
    """What is found for questions(question, text) from seeds(question, id) over nodes(id, text) and edges.

    score(question's text, node's text) is between 0 and 1, rounded to 9 digits.  Seeds are protected; they may exceed the bound alone.  An
    expansion takes the first `beside` neighbours, either way, by score and id; evidence is kept by protection, score and id, and what has been
    cut may come back from elsewhere, but nothing is expanded twice.  stop: work_cap where items were left at the last evaluation, stop where none were,
    no_evidence where no seed is a node.
    """
    # as many parts as asked for, however small they travel: joined by size, all ids of a hub and their texts are sorted in a few tasks
    spread = lambda rows: rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    texts, asked = nodes.select("id", F.col("text").alias("_text")), questions.select("question", F.col("text").alias("_asked"))
    scored = lambda rows: rows.join(spread(texts), "id").join(asked, "question").withColumn("score", F.round(score(F.col("_asked"), F.col("_text")).cast("double"), 9)).drop("_text", "_asked")
    steps = settled(both_ways(edges).select(F.col("here").alias("id"), "there"))  # edges come as often as they are given: what is near is made distinct
    held = settled(scored(spread(seeds.select("question", "id")).distinct()).select("question", "id", "score", F.lit(True).alias("protected"), F.lit(0).alias("round"), F.lit(False).alias("_done")))
    trace = None
    best = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    for k in range(1, evaluations + 1):
        chosen = settled(held.where("not _done").withColumn("_n", F.row_number().over(best)).where("_n = 1").select("question", "id", "score", F.lit(k).alias("round")))
        if chosen.isEmpty():
            break
        trace = chosen if trace is None else trace.unionByName(chosen)
        done = trace.select("question", "id")
        near = spread(chosen.select("question", "id").join(steps, "id").select("question", F.col("there").alias("id"))).distinct()
        near = scored(near).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= beside).drop("_n")
        new = near.join(held.select("question", "id"), ["question", "id"], "left_anti").select("question", "id", "score", F.lit(False).alias("protected"), F.lit(k).alias("round"))
        rows = held.drop("_done").unionByName(new)
        rank = Window.partitionBy("question").orderBy(F.desc("protected"), F.desc("score"), "id")
        rows = rows.withColumn("_n", F.row_number().over(rank)).where(F.col("protected") | (F.col("_n") <= evidence)).drop("_n")
        held = settled(rows.join(done.withColumn("_d", F.lit(True)), ["question", "id"], "left").withColumn("_done", F.coalesce("_d", F.lit(False))).drop("_d"))
    open_ = held.groupBy("question").agg(F.bool_or(~F.col("_done")).alias("_open"))
    stops = asked.select("question").distinct().join(open_, "question", "left").select("question", F.when(F.col("_open").isNull(), "no_evidence").when(F.col("_open"), "work_cap").otherwise("stop").alias("stop"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("protected"), F.desc("score"), "id"))
    out = held.select("question", place.alias("place"), "id", "score", "protected", "round")
    return Report(out, trace if trace is not None else held.select("question", "round", "id", "score").limit(0), stops)
