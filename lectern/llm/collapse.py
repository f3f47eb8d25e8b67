"""Records identical but for white space, case, punctuation or the order of named fields.

Method: canonical records are range-partitioned, sorted on disk by Spark's external sorter, and runs
of adjacent rows with the same full key are scanned; each run gives one representative and its exact
number of copies. The range key ends in the row id, so a run of any size is cut into several
partitions; runs open at a partition's edge are joined afterwards from one summary row a partition.

Defined results: a null key takes part in no group and is its own record; an empty canonical key is a
key like any other; ties are broken by the smallest id; repeated ids keep one row each; an empty table
gives an empty table; other columns of the input are neither read nor kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions import codepoints as cp
from lectern.llm.neardup import connected
from lectern.plans.stage import written

#: Fields of a text that is no JSON object are parted by ";" or a line break before a name and ":" or "=".
FIELD_BREAK = re.compile(r"\s*[;\n]\s*(?=[^\W\d]\w{0,30}\s*[:=])")


class _Loose(dict):
    """For ``str.translate``: deletes what ``codepoints.canonical`` leaves out."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if code < cp.TOP and cp.tables()["loose"][code] else code
        return self[code]


_LOOSE = _Loose()


def plain(text: str) -> str:
    """The canonical form of one field."""
    return text.upper().lower().translate(_LOOSE)


def maybe_fields(p: cp.Pass) -> np.ndarray:
    """The texts of a pass that start with "{", or with a word and ":" or "="."""
    t = cp.tables()
    start, end, first = cp.words(p)
    solid, _ = cp.edges(~t["space"][p.at], p.off)
    at = np.searchsorted(solid, p.off)
    filled = np.flatnonzero(np.diff(at) > 0)
    opens = solid[at[filled]]
    out = np.zeros(len(p.off) - 1, bool)
    out[filled] = p.code[opens] == ord("{")
    worded = filled[np.diff(first)[filled] > 0]
    w = first[worded]
    after = np.concatenate([p.code, [0, 0]])[end[w][:, None] + np.arange(2)]
    sign = (after == ord(":")) | (after == ord("="))
    out[worded] |= (start[w] == solid[at[worded]]) & (sign[:, 0] | (sign[:, 1] & (after[:, 0] == 32)))
    return out


def field_key(text: str) -> str | None:
    """Of a text made of at least two named fields (JSON object, "name: value" lines, "name=value;" list) its canonical fields in sorted order, else None."""
    parts: list[str] = []
    if text.lstrip().startswith("{"):
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if isinstance(found, dict):
            parts = [f"{k}{v if isinstance(v, str) else json.dumps(v, sort_keys=True)}" for k, v in found.items()]
    else:
        parts = FIELD_BREAK.split(text)
    return "\u0001".join(sorted(map(plain, parts))) if len(parts) >= 2 else None


def _keys(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in cp.passes(b.column("text")):
                text = b.column("text").slice(p.i, p.j - p.i)
                rows = np.flatnonzero((cp.space_counts(p) >= least_words) & text.is_valid().to_numpy(zero_copy_only=False))
                key = cp.canonical(p).take(pa.array(rows))
                text = text.take(pa.array(rows))
                more = np.full(len(rows), None, object)
                for i in np.flatnonzero(maybe_fields(p)[rows]):
                    more[i] = field_key(text[int(i)].as_py())
                yield pa.RecordBatch.from_arrays([key, b.column("id").slice(p.i, p.j - p.i).take(pa.array(rows)), pa.array(more, pa.string())], names=["k", "id", "more"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans one sorted partition (key, id, more) for runs of equal keys; the last row out describes the partition's edges."""
    part = TaskContext.get().partitionId()
    last_key: str | None = None
    head, at_edge = None, True
    first_key = None
    single = True
    more_type = pa.string()
    for b in batches:
        if not b.num_rows:
            continue
        key, ids = b.column("k"), b.column("id").to_numpy(zero_copy_only=False)
        differs = pc.not_equal(key.slice(1), key.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) if b.num_rows > 1 else []
        if first_key is None:
            first_key, head = key[0].as_py(), int(ids[0])
            begins_new = False
        else:
            begins_new = key[0].as_py() != last_key
        # Index of the row where each row's run starts, -1 for the run carried over from the batch before.
        new = np.concatenate([[begins_new], differs]).astype(bool)
        run = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))
        heads = np.where(run < 0, head, ids[run])
        edges = (run < 0) & at_edge
        head, at_edge, single = int(heads[-1]), at_edge and not new.any(), single and not new.any()
        last_key = key[b.num_rows - 1].as_py()
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(heads, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(edges, pa.bool_()), b.column("more").cast(more_type), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())],
            names=_NAMES,
        )
    if first_key is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([head], pa.int64()), pa.array([part], pa.int32()), pa.array([True]), pa.nulls(1, pa.string()), pa.array([first_key]), pa.array([last_key]), pa.array([single])],
            names=_NAMES,
        )


_NAMES = ["id", "head", "part", "edge", "more", "first_key", "last_key", "single"]
_SCHEMA = "id long, head long, part int, edge boolean, more string, first_key string, last_key string, single boolean"


def runs_of(df: DataFrame) -> DataFrame:
    """Of rows (k, id, more): ``id``, ``head`` (the smallest id with the same ``k``) and ``more``. Keys are not null."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written first: the bounds of the ranges are found by reading the hashes, without making the keys again.
    hashed = written(df.select("k", "id", "more", F.xxhash64("k").alias("h1"), F.hash("k").alias("h2")))
    ranged = hashed.repartitionByRange(n, "h1", "h2", "id").sortWithinPartitions("h1", "h2", "k", "id").select("k", "id", "more")
    scanned = written(ranged.mapInArrow(_scan, _SCHEMA))
    # One row a partition: as many as the shuffle is wide, whatever the data.
    order = W.Window.orderBy("part")
    edges = scanned.filter("id is null").select("part", "head", "first_key", "last_key", "single")
    edges = edges.withColumn("open", F.coalesce(F.col("first_key") == F.lag("last_key").over(order), F.lit(False)))
    edges = edges.withColumn("chain", F.sum(F.when(F.col("open") & F.col("single"), 0).otherwise(1)).over(order))
    edges = edges.withColumn("carried", F.first("head").over(W.Window.partitionBy("chain").orderBy("part")))
    edges = edges.withColumn("from_left", F.lag("carried").over(order))
    open_edges = edges.filter("open").select("part", F.lit(True).alias("edge"), "from_left")
    return scanned.filter("id is not null").join(F.broadcast(open_edges), ["part", "edge"], "left").select("id", F.coalesce("from_left", "head").alias("head"), "more")


def collapse_copies(df: DataFrame, id_col: str, text_col: str, least_words: int = 0) -> DataFrame:
    """``row_id`` and ``keep_id`` (the smallest id of its copies) of every row of ``df`` whose text is not null and has at least ``least_words`` words."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    first = runs_of(rows.mapInArrow(_keys(least_words), "k string, id long, more string"))
    # Runs of texts with fields, collapsed once more by their sorted fields; a run may have several such readings.
    fields = written(first.filter("more is not null").select(F.col("more").alias("k"), F.col("head").alias("id")).distinct())
    second = runs_of(fields.withColumn("more", F.lit(None).cast("string"))).filter("head <> id")
    if fields.groupBy("id").count().filter("count > 1").limit(1).count():
        merged = connected(second.select(F.col("id").alias("u"), F.col("head").alias("v")))
        merged = merged.filter("id <> root").select(F.col("id").alias("head"), F.col("root").alias("merged"))
    else:
        merged = second.select(F.col("id").alias("head"), F.col("head").alias("merged"))
    joined = first.join(merged, "head", "left")
    return joined.select(F.col("id").alias("row_id"), F.coalesce("merged", "head").alias("keep_id"))


def copies_found(df: DataFrame, id_col: str = "row_id", text_col: str = "text", least_words: int = 20) -> DataFrame:
    """Pairs (keep_id, row_id) of each copy with the record kept for it."""
    return collapse_copies(df, id_col, text_col, least_words).filter("keep_id <> row_id").select("keep_id", "row_id").distinct()


def copy_counts(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """One row for each content: ``keep_id`` and ``copies``, the exact number of rows that hold it."""
    return collapse_copies(df, id_col, text_col).groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))
