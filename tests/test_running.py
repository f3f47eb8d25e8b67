"""Running sums, ranks and quantiles over range partitions against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import running, sampling, stats
from lectern.plans import stage


def rows(n: int = 3000, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    # One group holds most rows; nulls are a group of their own.
    return [(i, r.choice(["a"] * 8 + ["b", None]), r.randrange(50), r.randrange(4)) for i in range(n)]


def test_running_sums_and_ranks(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, x int, w int").repartition(7)
    want, total = {}, defaultdict(int)
    for i, g, x, w in sorted(data, key=lambda t: (t[2], t[0])):
        total[g] += w
        want[i] = total[g]
    out = running.running_sums(df.selectExpr("*", "1 as _keys"), ["g"], [F.col("x"), F.col("id")], ["w"], totals=True).collect()
    assert {r.id: r.w_upto for r in out} == want and all(r.w_all == total[r.g] for r in out) and len(out) == len(data)
    place = defaultdict(int)
    ranks = {}
    for i, g, x, _ in sorted(data, key=lambda t: (-t[2], t[0])):
        place[g] += 1
        ranks[i] = place[g]
    got = running.ranked(df, ["g"], [F.col("x").desc(), F.col("id")], size="n").collect()
    assert {r.id: r._rank for r in got} == ranks and all(r.n == place[r.g] for r in got)
    assert running.running_sums(df.limit(0), ["g"], [F.col("x")], ["w"]).count() == 0
    assert {r.id: r._rank for r in running.ranked(df.filter("id < 3"), [], [F.col("id")]).collect()} == {0: 1, 1: 2, 2: 3}


def test_quantiles(spark):
    data = rows()
    df = spark.createDataFrame([*data, (9999, "c", None, 0)], "id long, g string, x int, w int")
    got = {r.g: r["values"] for r in running.quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 1.0]).collect()}
    for g in ("a", "b", None):
        assert got[g] == pytest.approx(np.quantile([x for _, k, x, _ in data if k == g], [0.0, 0.1, 0.5, 1.0]))
    assert "c" not in got


def test_wide_effect_sizes_equal_long_ones(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.choice([0, 1, None]), r.gauss(0, 1), None if i % 5 == 0 else r.gauss(3, 2)) for i in range(400)]
    data += [("one", 0, 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, label int, u double, v double")
    long = stats.effect_sizes(stats.long_form(df.filter("label is not null"), ["g", "label"], ["u", "v"]), "g")
    wide = stats.effect_sizes_wide(df, "g", ["u", "v"])
    key = lambda x: {(r.g, r.feature): r for r in x.collect()}
    a, b = key(long), key(wide)
    assert set(a) == set(b)
    for k in a:
        assert [v is None for v in a[k]] == [v is None for v in b[k]]
        assert [v for v in a[k][2:] if v is not None] == pytest.approx([v for v in b[k][2:] if v is not None])


def test_equal_sizes_with_replacement(spark):
    df = spark.createDataFrame([(i, "a", int(i < 3)) for i in range(20)] + [(90, "b", 1)], "id long, g string, y int")
    got = sampling.equal_sizes(df, "g", "y", "id", 10, replace=True).groupBy("g", "y").count().collect()
    assert {(r.g, r.y): r["count"] for r in got} == {("a", 0): 10, ("a", 1): 10}
    got = sampling.equal_sizes(df, "g", "y", "id", 10).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 3, 1: 3}


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "a", float(i % 10)) for i in range(500)], "id long, g string, v double")
    one = stats.bootstrap_mean(df.repartition(1), ["g"], "v", "id").first()
    many = stats.bootstrap_mean(df.repartition(9), ["g"], "v", "id").first()
    assert one.low == pytest.approx(many.low) and one.high == pytest.approx(many.high) and one.low < 4.5 < one.high
    assert 0.1 < one.high - one.low < 1.0


def test_stage_tables_are_cleared(spark):
    t = stage.written(spark.range(5))
    assert t.count() == 5 and stage.clear(spark) >= 1
    assert stage.clear(spark) == 0
