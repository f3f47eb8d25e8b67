"""Sentence windows of documents: texts, scores, gaps, shifts of style, spans.

Input rows are (doc, idx, ...). Windows are partitioned by document, so a task sorts one document's
sentences; a document is the unit the definitions speak of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions import text as X


def sentence_rows(df: DataFrame, id_col: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, idx, sentence), and the columns to keep."""
    return df.select(id_col, *(keep or []), F.posexplode(X.sentences(text_col)).alias("idx", "sentence"))


def centred_windows(sentences: DataFrame, id_col: str, least_words: int = 15) -> DataFrame:
    """Each sentence with its neighbours, clipped at the edges; null below ``least_words`` words."""
    w = W.Window.partitionBy(id_col).orderBy("idx").rowsBetween(-1, 1)
    joined = sentences.withColumn("window", F.array_join(F.collect_list("sentence").over(w), " "))
    return joined.withColumn("window", F.when(F.size(X.space_words("window")) >= least_words, F.col("window")))


def shifted_windows(sentences: DataFrame, id_col: str, size: int = 3) -> DataFrame:
    """Each sentence with the text of its window of ``size`` sentences, moved inward at the edges."""
    rows = W.Window.partitionBy(id_col).orderBy("idx")
    n = F.count(F.lit(1)).over(W.Window.partitionBy(id_col))
    near = F.collect_list("sentence").over(rows.rowsBetween(1 - size, size - 1))
    start = F.greatest(F.lit(0), F.least(F.col("idx") - 1, n - size))
    # The first of the sentences gathered is max(0, idx + 1 - size).
    first = start - F.greatest(F.lit(0), F.col("idx") + 1 - size)
    placed = sentences.withColumns({"_near": near, "_first": first})
    joined = F.array_join(F.slice("_near", F.col("_first").cast("int") + 1, size), " ")
    return placed.withColumn("window", joined).drop("_near", "_first")


def shifted_window_means(scores: DataFrame, id_col: str, score: str, size: int = 3) -> DataFrame:
    """Windows of ``size`` sentences that are moved inward at the edges; each window's score counts for all its members, whose means are returned. ``scores`` holds the window score of each idx."""
    n = F.count(F.lit(1)).over(W.Window.partitionBy(id_col))
    start = F.greatest(F.lit(0), F.least(F.col("idx") - 1, n - size))
    spread = scores.withColumn("_n", n).withColumn("_start", start)
    members = spread.withColumn("member", F.explode(F.sequence(F.col("_start"), F.least(F.col("_start") + size, F.col("_n")) - 1)))
    return members.groupBy(id_col, F.col("member").cast("int").alias("idx")).agg(F.avg(score).alias("mean_score"))


def interpolated(scores: DataFrame, id_col: str, score: str) -> DataFrame:
    """Null scores filled on the line between their neighbours, at the edges with the nearest; all null stays null."""
    past = W.Window.partitionBy(id_col).orderBy("idx").rowsBetween(W.Window.unboundedPreceding, 0)
    ahead = W.Window.partitionBy(id_col).orderBy("idx").rowsBetween(0, W.Window.unboundedFollowing)
    at = F.when(F.col(score).isNotNull(), F.col("idx"))
    l, r = F.last(score, True).over(past), F.first(score, True).over(ahead)
    li, ri = F.last(at, True).over(past), F.first(at, True).over(ahead)
    between = l + (F.col("idx") - li) / F.nullif(ri - li, F.lit(0)) * (r - l)
    return scores.withColumn("filled", F.coalesce(F.col(score), between, l, r))


def transitions(scores: DataFrame, id_col: str, score: str, threshold: float = 0.25) -> DataFrame:
    """Steps between neighbouring valid scores of at least the threshold, with their direction."""
    valid = scores.filter(F.col(score).isNotNull())
    step = F.col(score) - F.lag(score).over(W.Window.partitionBy(id_col).orderBy("idx"))
    return valid.withColumn("delta", F.round(step, 9)).filter(F.abs("delta") >= threshold).select(id_col, "idx", F.when(F.col("delta") > 0, "human_to_ai").otherwise("ai_to_human").alias("direction"), F.abs("delta").alias("delta"))


def spans(scores: DataFrame, id_col: str, score: str) -> DataFrame:
    """Of each document: sentences, those scored as AI, uncertain ones, whether it is mixed, mean score (0.5 if none)."""
    s = F.col(score)
    n = lambda c: F.count(F.when(c, 1))
    g = scores.groupBy(id_col).agg(F.count(F.lit(1)).alias("sentences"), n(s >= 0.5).alias("ai"), n((s > 0.35) & (s < 0.65)).alias("uncertain"), n(s < 0.5).alias("human"), F.coalesce(F.avg(s), F.lit(0.5)).alias("mean_score"))
    return g.withColumn("mixed", (F.col("ai") > 0) & (F.col("human") > 0))
