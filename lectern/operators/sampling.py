"""Deterministic samples: by hash order within groups, matched by length, folds and splits.

Where at most a fixed number of rows of a group counts, Spark's group limit keeps no more than that many of a group
in each task before the shuffle. Where every row's rank counts, ranks come from range-partitioned running sums, so a
group of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.operators import running
from lectern.operators.corpus import hash_order


def ranked(df: DataFrame, groups: list[str], id_col: str, seed: str = "42", size: str | None = None) -> DataFrame:
    """Every row's rank (``_rank``) in its group by hash order."""
    return running.ranked(df, groups, [hash_order(F.col(id_col), seed), F.col(id_col)], size=size)


def first_ranks(df: DataFrame, groups: list[str], id_col: str, most: int, seed: str = "42") -> DataFrame:
    """The first ``most`` rows of each group by hash order, with their ranks."""
    order = W.Window.partitionBy(*groups).orderBy(hash_order(F.col(id_col), seed), F.col(id_col))
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)


def capped(df: DataFrame, groups: list[str], id_col: str, most: int, seed: str = "42") -> DataFrame:
    """At most ``most`` rows of each group."""
    return first_ranks(df, groups, id_col, most, seed).drop("_rank")


def _rarer(label: str) -> Column:
    return F.least(*(F.count(F.when(F.col(label) == k, 1)) for k in (0, 1)))


def equal_sizes(
    df: DataFrame, group: str, label: str, id_col: str, most: int, seed: str = "42", replace: bool = False
) -> DataFrame:
    """Of each group as many rows of either label as the rarer one has, at most ``most``.

    ``replace``: as many as the commoner one has, at most ``most``; rows of the rarer one are repeated in turn.
    """
    labelled = df.filter(F.col(label).isin(0, 1))
    first = first_ranks(labelled, [group, label], id_col, most, seed)
    size = F.least(_rarer(label), F.lit(most))
    if not replace:
        counts = labelled.groupBy(group).agg(size.alias("_n"))
        return first.join(F.broadcast(counts), group).filter("_rank <= _n").drop("_rank", "_n")
    both = F.greatest(*(F.count(F.when(F.col(label) == k, 1)) for k in (0, 1)))
    counts = labelled.groupBy(group).agg(
        F.when(_rarer(label) > 0, F.least(both, F.lit(most))).otherwise(0).alias("_n"), *(
            F.count(F.when(F.col(label) == k, 1)).alias(f"_n{k}") for k in (0, 1)
        )
    )
    own = F.when(F.col(label) == 0, F.col("_n0")).otherwise(F.col("_n1"))
    joined = first.join(F.broadcast(counts), group).filter("_rank <= _n")
    # Row r of m stands for places r, r + m, r + 2 m, ... up to the size.
    times = F.floor((F.col("_n") - F.col("_rank")) / F.least(own, F.lit(most))) + 1
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return repeated.select(*df.columns, F.col("_copy").alias("copy"))


def bin_edges(df: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """Exact quantile edges of a value by group."""
    found = running.quantiles(df, [group], value, [i / bins for i in range(bins + 1)])
    return found.select(group, F.col("values").alias("edges"))


def length_matched(
    df: DataFrame, group: str, label: str, value: str, id_col: str, bins: int = 20, least: int = 5, seed: str = "42"
) -> DataFrame:
    """Rows matched on a value: in each quantile bin of a group as many of either label, bins with fewer than ``least``
    of one left out. Equal edges are one; the first bin starts at 0, the last is open."""
    edges = bin_edges(df, group, value, bins).select(group, F.array_sort(F.array_distinct("edges")).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    placed = df.join(F.broadcast(edges), group)
    placed = placed.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(value)))).drop("edges")
    counts = placed.groupBy(group, "bin").agg(_rarer(label).alias("_n")).filter(F.col("_n") >= least)
    joined = ranked(placed, [group, "bin", label], id_col, seed).join(F.broadcast(counts), [group, "bin"])
    return joined.filter("_rank <= _n").drop("_rank", "_n")


def folds(df: DataFrame, strata: list[str], id_col: str, k: int = 5, seed: str = "42") -> DataFrame:
    """Stratified folds 0 to k - 1, sizes within a stratum differing by one at most."""
    return ranked(df, strata, id_col, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def split(df: DataFrame, strata: list[str], id_col: str, share: float, seed: str = "42") -> DataFrame:
    """A column ``is_test``: the first share of each stratum by hash order."""
    placed = ranked(df, strata, id_col, seed, size="_size")
    return placed.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_size") * F.lit(share))).drop("_rank", "_size")


def perturbed(column: Column, id_: Column, low: float, high: float, seed: str = "42") -> Column:
    """A value times a factor between ``low`` and ``high`` that depends on the id only."""
    unit = F.conv(F.substring(F.md5(F.concat(id_.cast("string"), F.lit(f"*{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return column * (low + (high - low) * unit)


def sample(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """The first n rows by hash order; each task keeps at most n."""
    return df.orderBy(hash_order(F.col(id_col), seed), F.col(id_col)).limit(n)


# Means and deviations of noun_verb_ratio, adj_adv_ratio, pos_transition_entropy, sent_length_std.
PROFILES = {
    "reasoning": ((1.00, 0.15), (2.50, 0.35), (5.23, 0.08), (2.19, 0.30)),
    "model": ((0.76, 0.12), (1.33, 0.25), (5.49, 0.06), (3.15, 0.35)),
    "human": ((0.64, 0.10), (0.71, 0.18), (5.60, 0.05), (3.25, 0.40)),
}
PROFILE_FEATURES = ("noun_verb_ratio", "adj_adv_ratio", "pos_transition_entropy", "sent_length_std")


def synthetic_profiles(spark, n: int = 1000, seed: int = 42) -> DataFrame:
    """n rows of each profile with normally distributed features; ``label`` is 1 for reasoning models."""
    out = None
    for k, (name, moments) in enumerate(PROFILES.items()):
        rows = spark.range(n, numPartitions=4).select(
            F.lit(name).alias("profile"), F.lit(int(name == "reasoning")).alias("label"),
            *(
                (F.randn(seed + 10 * k + i) * sd + mean).alias(f)
                for i, (f, (mean, sd)) in enumerate(zip(PROFILE_FEATURES, moments))
            ),
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def synthetic_calibration(spark, n: int = 2000, seed: int = 42) -> DataFrame:
    """n probabilities from Beta(2, 2), which is the middle one of three uniform draws, and labels with noise around 0.5."""
    draws = F.array_sort(F.array(*(F.rand(seed + i) for i in range(3))))
    rows = spark.range(n, numPartitions=4).select(F.get(draws, 1).alias("p"), F.randn(seed + 3).alias("_e"))
    return rows.select("p", (F.col("p") + 0.15 * F.col("_e") > 0.5).cast("int").alias("label"))
