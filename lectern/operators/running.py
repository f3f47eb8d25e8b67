"""Running sums and exact ranks within groups of any size.

A window over a group sorts the whole group in one task. Here rows are range-partitioned on (group, order), so a
group takes as many tasks as its size asks for; each task sums its own sorted rows, and what the tasks before it
summed up for the same group is added from a table of one row for each partition and group.

Defined results: null groups are a group of their own; rows of equal order are summed in the order of the
tie-breaking columns given; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from lectern.plans.stage import partitions, written


def _scan(values: list[str]):
    """Adds to a sorted partition the running sums of its own rows, and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, {v: 0.0 for v in values}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = b.column("_key").dictionary_encode()
            names, code = key.dictionary, key.indices.to_numpy(zero_copy_only=False)
            new = np.concatenate([[names[code[0]].as_py() != last], code[1:] != code[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = list(b.columns)
            for v in values:
                x = b.column(v).to_numpy(zero_copy_only=False).astype(np.float64)
                c = np.cumsum(x)
                before = np.where(start > 0, c[start - 1], 0.0)
                upto = c - before + np.where(start < 0, carried[v], 0.0)
                carried[v] = float(upto[-1])
                out.append(pa.array(upto))
            last = names[code[-1]].as_py()
            out.append(pa.array(np.full(n, part, np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, *(f"{v}_upto" for v in values), "_part"])

    return run


def group_key(groups: list[str]) -> Column:
    """One string for the values of the grouping columns, nulls apart from every value."""
    return F.to_json(F.struct(*(F.col(f"`{g}`") for g in groups)), {"ignoreNullFields": "false"}) if groups else F.lit("")


def running_sums(
    df: DataFrame, groups: list[str], order: list[Column], values: list[str], totals: bool = False
) -> DataFrame:
    """``df`` with ``<value>_upto``: the sum of each value, which is not negative, over the group's rows up to and with
    this one in the given order; with ``totals`` also ``<value>_all``, the group's sum."""
    keyed = df.withColumn("_key", group_key(groups))
    by = [F.col("_key"), *order]
    ranged = keyed.repartitionByRange(partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    extra = [T.StructField(f"{v}_upto", T.DoubleType()) for v in values] + [T.StructField("_part", T.IntegerType())]
    scanned = written(ranged.mapInArrow(_scan(values), T.StructType([*keyed.schema.fields, *extra])))
    # One row for each partition and group in it: at most partitions plus groups.
    ends = scanned.groupBy("_key", "_part").agg(*(F.max(f"{v}_upto").alias(f"_{v}") for v in values))
    before = W.Window.partitionBy("_key").orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.partitionBy("_key")
    offsets = ends.select(
        "_key", "_part", *(F.coalesce(F.sum(f"_{v}").over(before), F.lit(0.0)).alias(f"_{v}_before") for v in values),
        *(F.sum(f"_{v}").over(whole).alias(f"_{v}_all") for v in values),
    )
    joined = scanned.join(offsets, ["_key", "_part"])
    sums = [(F.col(f"{v}_upto") + F.col(f"_{v}_before")).alias(f"{v}_upto") for v in values]
    sums += [F.col(f"_{v}_all").alias(f"{v}_all") for v in values] if totals else []
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *sums)


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "_rank", size: str | None = None) -> DataFrame:
    """``df`` with each row's rank in its group, from 1, and on demand the group's ``size``."""
    out = running_sums(df.withColumn("_one", F.lit(1)), groups, order, ["_one"], size is not None)
    extra = [F.col("_one_upto").cast("long").alias(name)]
    extra += [F.col("_one_all").cast("long").alias(size)] if size else []
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *extra)


def quantiles(df: DataFrame, groups: list[str], value: str, levels: list[float]) -> DataFrame:
    """(groups, values): exact quantiles, linearly interpolated, as an array in the order of ``levels``.

    Equal values are counted first, so a group costs as much as it has distinct values. Nulls take no part.
    """
    v = F.col(f"`{value}`").cast("double")
    counted = df.filter(v.isNotNull()).groupBy(*groups, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sums(counted, groups, [F.col("_v")], ["_n"], totals=True)
    level = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("q")) for i, x in enumerate(levels))))
    at = (F.col("_n_all") - 1) * F.col("_l.q")
    # A value is at 0-based places from _n_upto - _n to _n_upto - 1.
    first, last = F.col("_n_upto") - F.col("_n"), F.col("_n_upto") - 1
    each = upto.withColumn("_l", level).withColumn("_at", at)
    low, high = F.floor("_at"), F.ceil("_at")
    near = each.filter((first <= high) & (last >= low))
    picked = near.groupBy(*groups, "_l").agg(
        F.max(F.when((first <= low) & (last >= low), F.col("_v"))).alias("_a"),
        F.max(F.when((first <= high) & (last >= high), F.col("_v"))).alias("_b"),
        F.max("_at").alias("_at"),
    )
    found = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    whole = picked.select(*groups, F.struct(F.col("_l.i").alias("i"), found.alias("v")).alias("_s"))
    # As many rows a group as there are levels.
    sorted_ = F.array_sort(F.collect_list("_s"))
    return whole.groupBy(*groups).agg(F.transform(sorted_, lambda x: x["v"]).alias("values"))
