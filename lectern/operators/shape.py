"""Reshaping and checking of tables: labels, requests, positions, unions, transposition, fixed order, first rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions import kernel
from lectern.functions import text as X
from lectern.operators import running

REGISTERS = ("academic", "news", "social", "creative", "encyclopedic")
DETECTORS = ("stylometric", "hybrid", "neural")


def label_of(column: Column, scheme: str = "plain") -> Column:
    """0 for human, 1 for machine text, from labels of other collections.

    ``plain``: 0, 1 or the word human, any other word is machine. ``flipped``: 1 stands for human. ``named``: the
    name of a model, human for human. ``lenient``: as plain, but what is neither 0, 1, human nor ai counts as human.
    Null stays null.
    """
    word = F.lower(F.trim(column.cast("string")))
    human = word.isin("human", "0", "0.0")
    if scheme == "flipped":
        return (1 - F.expr("try_cast({} as int)".format(word._jc.toString()))).cast("int")
    if scheme == "lenient":
        return F.when(word.isNull(), None).when(word.isin("1", "1.0", "ai", "machine"), 1).otherwise(0)
    if scheme not in ("plain", "named"):
        raise ValueError(f"unknown scheme {scheme!r}; one of plain, flipped, named, lenient")
    return F.when(word.isNull(), None).when(human if scheme == "plain" else word == "human", 0).otherwise(1)


def checked_requests(
    df: DataFrame, text: str = "text", register: str = "register", detector: str | None = None,
    most_chars: int = 10_000, least_words: int = 30, known: tuple[str, ...] = REGISTERS,
) -> DataFrame:
    """``df`` with ``error``: the first rule a request breaks, or null. Rules in order: a text, its length, its words, a
    known register (null and "all" are), a known detector."""
    t, r = F.col(text), F.lower(F.trim(F.col(register)))
    error = F.when(t.isNull() | (X.strip(t) == ""), "no text")
    error = error.when(F.length(t) > most_chars, f"text over {most_chars} characters")
    error = error.when(F.size(X.space_words(t)) < least_words, f"text under {least_words} words")
    error = error.when(F.coalesce(r, F.lit("all")).isin(*known, "all") == F.lit(False), "unknown register")
    if detector:
        error = error.when(~F.coalesce(F.col(detector), F.lit(DETECTORS[0])).isin(*DETECTORS), "unknown detector")
    return df.withColumn("error", error)


def batch_too_large(df: DataFrame, batch: str, most: int = 1000) -> DataFrame:
    """(batch, requests) of batches with more than ``most`` requests."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("requests")).filter(F.col("requests") > most)


def head_of_each(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in the order given; each task keeps at most n of a group before the shuffle."""
    w = W.Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def attack_quota(
    df: DataFrame, attack: str, label: str, order: list[str], per_attack: int = 500, human: int = 1000, clean: str = "none"
) -> DataFrame:
    """The first machine texts of each attack up to the quota, and the first human texts without an attack up to theirs;
    human texts under an attack are left out."""
    side = F.when(F.col(label) == 1, F.concat(F.lit("1"), F.col(attack))).when(F.col(attack) == clean, F.lit("0"))
    sided = df.withColumn("_side", side).filter(F.col("_side").isNotNull())
    w = W.Window.partitionBy("_side").orderBy(*order)
    ranked = sided.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= max(per_attack, human))
    most = F.when(F.col("_side") == "0", human).otherwise(per_attack)
    return ranked.filter(F.col("_place") <= most).drop("_side", "_place")


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Rows side by side by their positions in the two orders; the longer table is cut. Columns of ``right`` whose names
    ``left`` has get ``_right`` at their end."""
    a = running.ranked(left, [], [F.col(c) for c in left_order], name="_place")
    names = {c: f"{c}_right" if c in left.columns else c for c in right.columns}
    b = running.ranked(right, [], [F.col(c) for c in right_order], name="_place")
    b = b.select("_place", *(F.col(c).alias(n) for c, n in names.items()))
    return a.join(b, "_place").drop("_place")


def key_union(frames: list[DataFrame], key: str) -> DataFrame:
    """The distinct keys of several tables, nulls left out."""
    out = None
    for df in frames:
        part = df.select(key).filter(F.col(key).isNotNull()).distinct()
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def transposed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """A small table on its side: one row for each of the columns, one column for each value of ``name``."""
    long = df.unpivot([name], columns, "column", "_value").filter(F.col(name).isNotNull())
    return long.groupBy("column").pivot(name).agg(F.first("_value", True))


def reindexed(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted keys in that order (``place``), with nulls where there are none; other keys are left out."""
    rows = [(i, k) for i, k in enumerate(wanted)]
    order = df.sparkSession.createDataFrame(rows, f"place int, {key} string")
    return F.broadcast(order).join(df, key, "left").select("place", *df.columns)


def shuffled(df: DataFrame, id_col: str, seed: str = "42") -> DataFrame:
    """Rows in a fixed pseudo-random order, which a range-partitioned sort gives."""
    from lectern.operators.corpus import hash_order

    return df.orderBy(hash_order(F.col(id_col), seed), F.col(id_col))


# Names shown for model families.
SHOWN = {
    "human": "Human",
    "openai": "OpenAI (GPT-4 / ChatGPT)",
    "llama": "Meta Llama",
    "mistral": "Mistral AI",
    "cohere": "Cohere",
    "mpt": "MosaicML MPT",
    "other": "Other AI",
    "reasoning": "Reasoning LLM (DeepSeek-R1 / OpenAI o1)",
}


def shown_name(column: Column) -> Column:
    """The name shown for a model family; others as they are."""
    pairs = [F.lit(x) for kv in SHOWN.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def top_mean(df: DataFrame, key: str, value: Column, n: int = 20) -> DataFrame:
    """The keys with the highest mean of a value, ties by key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean")).orderBy(F.col("mean").desc_nulls_last(), key).limit(n)


def _pair_entropies(lists: pa.Array) -> pa.Array:
    size = len(lists)
    lists = lists.cast(pa.list_(pa.string()))
    code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bound = np.concatenate([[0], np.cumsum(count)])
    pairs = np.maximum(count - 1, 0)
    at = np.arange(pairs.sum()) + np.repeat(bound[:-1] - np.concatenate([[0], np.cumsum(pairs)])[:-1], pairs)
    value = code[at] * (1 << 22) + code[at + 1] if len(at) else np.zeros(0, np.int64)
    _, value = np.unique(value, return_inverse=True)
    times, first = kernel.counts_of(np.repeat(np.arange(size), pairs), value, size, 32)
    return pa.array(kernel.entropy(pairs, kernel.sums(times * np.log2(times), first)))


def bigram_entropy(items: Column) -> Column:
    """Entropy in bits of the neighbouring pairs of an array of strings; 0 for fewer than two items or null."""
    return F.arrow_udf(_pair_entropies, "double", F.ArrowUDFType.SCALAR)(items)


def tag_ratios(tags: Column) -> Column:
    """From an array of part-of-speech tags: nouns by verbs, adjectives by adverbs, and the entropy of tag pairs."""
    of = lambda prefix: F.size(F.filter(tags, lambda t: t.startswith(prefix)))
    ratio = lambda a, b: of(a) / F.greatest(of(b), F.lit(1))
    return F.struct(
        ratio("NN", "VB").alias("noun_verb_ratio"), ratio("JJ", "RB").alias("adj_adv_ratio"),
        bigram_entropy(tags).alias("pos_transition_entropy"),
    )
