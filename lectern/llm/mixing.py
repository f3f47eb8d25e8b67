"""Documents mixed by source to target shares of tokens, with a cap on repeats.

Method: the tokens of all documents are summed by source, language and topic; iterative proportional
fitting rakes these sums to the target tokens of each source and to the language and topic shares of the
whole, no cell beyond its cap of repeats. A cell's raked sum over its own tokens is how often each of its
documents is wanted: the whole part is given to each, the rest by a systematic draw with that probability.

A source that is raked below its target with all its cells at their caps is short; it gives all it can and
is reported. The cells are categories, not rows: their table is small and raked on
the driver.

Defined results: documents with a null or empty text have no tokens and are not drawn; a null language or
topic is a category of its own; sources without documents are short; sources not listed take no part;
an empty table gives a mix of nothing in which every source is short; repeated ids are separate documents.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.stage import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: How a text is parted before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(name: str, pattern: str):
    """Tokens of each text; the vocabulary is the file of that name that the driver sent to the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(name), pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            kept = [b.column(c) for c in ("id", "source", "lang", "topic")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=["id", "source", "lang", "topic", "tokens"])

    return run


def _systematic(seed: int):
    """Repeats of each document: the whole part of how often it is wanted, and one more where the sum of the rest over
    its cell's documents passes a whole number. The sum starts at a number drawn for each partition and cell, so a
    document's chance is its rest, and a partition's draws of a cell differ from their expectation by less than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at: dict[int, float] = {}
        for b in batches:
            cell, often = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "often"))
            repeats = np.floor(often + 1e-9)
            rest = np.maximum(often - repeats, 0)
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                start = at[c] if c in at else np.random.default_rng([seed, part, c]).random()
                upto = start + np.cumsum(rest[rows])
                repeats[rows] += np.floor(upto) - np.floor(np.concatenate([[start], upto[:-1]]))
                at[c] = float(upto[-1] % 1)
            keep = np.flatnonzero(repeats > 0)
            kept = [b.column(c).take(pa.array(keep)) for c in ("doc_id", "source", "lang", "topic", "tokens")]
            names = ["doc_id", "source", "lang", "topic", "tokens", "repeats"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(repeats[keep].astype(np.int32))], names=names)

    return run


def rake(tokens: np.ndarray, source: np.ndarray, margins: list[np.ndarray], target: np.ndarray, cap: np.ndarray, rounds: int = 200) -> np.ndarray:
    """How often each cell is wanted. ``source`` and ``margins`` hold each cell's category numbers, ``target`` the tokens wanted of each source, ``cap`` each cell's most repeats.

    Margins other than the source keep the shares they have among all tokens. The source is raked last in
    each round, so its targets are met exactly wherever caps allow.
    """
    often = np.minimum(np.ones(len(tokens)), cap)
    shares = [np.bincount(m, tokens) / max(tokens.sum(), 1) for m in margins]
    for _ in range(rounds):
        before = often
        for m, share in zip(margins, shares):
            now = np.bincount(m, tokens * often, len(share))
            factor = np.divide(share * now.sum(), now, out=np.ones_like(now), where=now > 0)
            often = np.minimum(often * factor[m], cap)
        for _ in range(30):  # cells at their cap leave the rest of their source to the others
            now = np.bincount(source, tokens * often, len(target))
            full = often >= cap * (1 - 1e-12)
            stuck = np.bincount(source, np.where(full, tokens * often, 0), len(target))
            free = now - stuck
            factor = np.where(now > target, np.divide(target, now, out=np.ones_like(now), where=now > 0), np.divide(target - stuck, free, out=np.ones_like(now), where=free > 0))
            often = np.minimum(np.where((now > target)[source] | ~full, often * np.maximum(factor, 0)[source], often), cap)
            if np.all(np.abs(np.bincount(source, tokens * often, len(target)) - np.minimum(target, np.bincount(source, tokens * cap, len(target)))) <= 1e-6 * np.maximum(target, 1)):
                break
        if np.abs(often - before).max(initial=0) < 1e-9:
            break
    return often


class Mix:
    def __init__(self, docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, seed: int = 1):
        spark = docs.sparkSession
        # The targets are a fixed table of sources.
        t = targets.select("source", "weight", "max_repeats").dropna(subset=["source"]).toPandas()
        listed = F.broadcast(spark.createDataFrame(t[["source"]], "source string"))
        rows = docs.join(listed, "source").select(F.col("doc_id").cast("long").alias("id"), "source", F.coalesce(F.lower(F.trim("lang")), F.lit("unknown")).alias("lang"), F.coalesce(F.lower(F.trim("register")), F.lit("unknown")).alias("topic"), "text")
        spark.sparkContext.addFile(vocabulary)
        counted = written(rows.mapInArrow(_count(os.path.basename(vocabulary), pattern), "id long, source string, lang string, topic string, tokens long"))
        cells = counted.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()
        own = cells.groupby("source")["tokens"].sum()
        t["tokens"] = t["source"].map(own).fillna(0).astype("int64")
        self.size = int(t["tokens"].sum())
        t["target_tokens"] = t["weight"] * self.size
        self.table = t
        place = {s: i for i, s in enumerate(t["source"])}
        source = cells["source"].map(place).to_numpy(int)
        margins = [pd.factorize(cells[c])[0] for c in ("lang", "topic")]
        cells["often"] = rake(cells["tokens"].to_numpy(float), source, margins, t["target_tokens"].to_numpy(float), t["max_repeats"].to_numpy(float)[source]) if len(cells) else 0.0
        cap, often = t["max_repeats"].to_numpy(float)[source], cells["often"].to_numpy(float)
        # Short: raked below its target with every cell at its cap.
        raked = np.bincount(source, cells["tokens"].to_numpy(float) * often, len(t))
        free = np.bincount(source, often < cap * (1 - 1e-9), len(t))
        t["short"] = (raked < t["target_tokens"] * (1 - 1e-6)) & (free == 0)
        t["raked_tokens"] = raked
        cells["cell"] = np.arange(len(cells))
        # One row a source, language and topic: categories that occur, not rows.
        kinds = "source string, lang string, topic string, often double, cell int"
        wanted = spark.createDataFrame(cells[["source", "lang", "topic", "often", "cell"]], kinds)
        placed = counted.filter("tokens > 0").join(wanted, ["source", "lang", "topic"])
        placed = placed.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", "often", "cell")
        drawn = "doc_id long, source string, lang string, topic string, tokens long, repeats int"
        self.docs = placed.mapInArrow(_systematic(seed), drawn)

    def report(self) -> DataFrame:
        """One row a listed source: target and actual tokens and shares, tokens available, and whether it is short."""
        # One row a listed source, few by nature.
        used = self.docs.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats")).toPandas()
        t = self.table.merge(used, on="source", how="left").fillna({"used_tokens": 0, "most_repeats": 0})
        t["actual_share"] = t["used_tokens"] / max(t["used_tokens"].sum(), 1)
        columns = "source string, weight double, max_repeats int, tokens long, target_tokens double, used_tokens long, actual_share double, most_repeats int, short boolean"
        names = [c.split()[0] for c in columns.split(", ")]
        return self.docs.sparkSession.createDataFrame(t[names].astype({"used_tokens": "int64", "most_repeats": "int64"}), columns)
