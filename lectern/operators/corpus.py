"""Corpus operators: register maps, filters, deduplication, anti-joins, quotas, reshaping.

Where one row of several is kept, it is the first by the order given, so results do not depend on
partitioning. Null keys form a group of their own in deduplication and never match in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions import text as X
from lectern.functions import wordlists as L


def register_of_source(source: Column) -> Column:
    """Register by the first listed substring of the lower-case source; "other" if none; for null, as for the word none."""
    low = F.coalesce(F.lower(source), F.lit("none"))
    out = None
    for key, register in L.SOURCE_REGISTERS:
        out = F.when(low.contains(key), register) if out is None else out.when(low.contains(key), register)
    return out.otherwise("other")


def register_of_domain(domain: Column) -> Column:
    """Register of an exactly named domain; null for any other."""
    pairs = [x for kv in L.DOMAIN_REGISTERS.items() for x in map(F.lit, kv)]
    return F.try_element_at(F.create_map(*pairs), domain)


def model_group(model: Column) -> Column:
    """Family of a model by the first listed substring; null counts as human."""
    low = F.lower(model)
    out = F.when(model.isNull(), "human")
    for group, keys in L.MODEL_GROUPS:
        hit = low.contains(keys[0])
        for k in keys[1:]:
            hit = hit | low.contains(k)
        out = out.when(hit, group)
    return out.otherwise("other")


def long_enough(df: DataFrame, register: Column, text: Column, default: int = 50) -> DataFrame:
    """Rows with the least words of their register."""
    pairs = [x for k, v in L.LEAST_WORDS.items() for x in (F.lit(k), F.lit(v))]
    return df.filter(F.size(X.space_words(text)) >= F.coalesce(F.try_element_at(F.create_map(*pairs), register), F.lit(default)))


def before_year(df: DataFrame, date: Column, year: int = 2022) -> DataFrame:
    """Rows dated before the year; those without a readable year are kept."""
    return df.filter(F.coalesce(F.expr("try_cast(substr({d}, 1, 4) as int)".format(d=date._jc.toString())), F.lit(0)) < year)


def first_of_each(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key: the smallest row, by an aggregate with map-side combine, not a window, so what is
    sent of a hot key is one row a task."""
    rest = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in df.columns])
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min(rest).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def without_known(df: DataFrame, known: DataFrame, key: Column, known_key: Column, order: list[Column]) -> DataFrame:
    """Rows whose key is not among the known ones, one of each new key."""
    new = df.withColumn("_key", key).join(known.select(known_key.alias("_key")).distinct(), "_key", "left_anti")
    return first_of_each(new, [F.col("_key")], order).drop("_key")


def quota(df: DataFrame, group: str, id_col: str, existing: DataFrame, target: int, seed: str = "42") -> DataFrame:
    """Of each group as many rows as are missing to the target, by hash order. ``existing``: (group, n)."""
    need = existing.select(F.col(group), F.greatest(F.lit(0), F.lit(target) - F.col("n")).alias("_need"))
    order = W.Window.partitionBy(group).orderBy(hash_order(F.col(id_col), seed), F.col(id_col))
    # No group needs more than the target: each task keeps so many rows of it before the shuffle.
    ranked = df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= target)
    return ranked.join(F.broadcast(need), group).filter("_rank <= _need").drop("_rank", "_need")


def hash_order(id_: Column, seed: str = "42") -> Column:
    """A fixed pseudo-random order that any engine reproduces: md5 of id and seed."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f"-{seed}")))


def wide_to_long(df: DataFrame, id_col: str, human: str, machine: str) -> DataFrame:
    """One row a text with label 0 or 1 from a row with both texts; null texts are left out."""
    return df.unpivot([id_col], [human, machine], "kind", "text").filter("text is not null").select(id_col, "text", F.when(F.col("kind") == machine, 1).otherwise(0).alias("label"))


def answers_to_rows(df: DataFrame, id_col: str, human: str, machine: str) -> DataFrame:
    """One row an answer from two columns of answer arrays."""
    side = lambda c, label: df.select(id_col, F.posexplode(c).alias("place", "text"), F.lit(label).alias("label"))
    return side(human, 0).unionAll(side(machine, 1))
