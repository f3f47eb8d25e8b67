"""Corpus, sample, statistics, window, scoring and state operators on small fixtures with brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, sampling, scoring, stats, training, windows
from lectern.sources import readers, sinks
from lectern.streaming import stateful


def scored(spark, n=200, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), i % 2, round(r.random(), 1)) for i in range(n)] + [(900, "a", None, 0.5), (901, None, 1, 0.5), (902, "a", 1, None)]
    return spark.createDataFrame(rows, "id long, g string, y int, s double"), rows


def test_auc_by_pairs(spark):
    df, rows = scored(spark)
    got = {r.g: r.auc for r in stats.auc(df, ["g"], "s", "y").collect()}
    for g in "ab":
        pos = [s for _, k, y, s in rows if k == g and y == 1 and s is not None]
        neg = [s for _, k, y, s in rows if k == g and y == 0 and s is not None]
        want = sum((p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)) / len(pos) / len(neg)
        assert got[g] == pytest.approx(want)
    flipped = stats.auc(df.withColumn("s", -F.col("s")), [], "s", "y").first().auc
    assert flipped == pytest.approx(1 - stats.auc(df, [], "s", "y").first().auc)
    assert stats.auc(df.limit(0), ["g"], "s", "y").count() == 0


def test_operating_points(spark):
    df, _ = scored(spark)
    for r in stats.tpr_at_fpr(df, ["g"], "s", "y").collect():
        assert 0 <= r.tpr <= 1
    assert {r.threshold for r in stats.exact_fpr_threshold(df, "g", "s", "y", 0.0001).collect() if r.g} == {1.0}
    c = stats.confusion(df, [], "s", "y").first()
    assert c.tp + c.fp + c.fn + c.tn == 201
    assert stats.probability_losses(df, [], "s", "y").first().brier > 0


def test_conformal_quantile(spark):
    df = spark.createDataFrame([(1, 0, x / 100) for x in range(101)], "g int, y int, p double")
    r = stats.conformal_quantile(df, ["g"], "p", "y", 0.1).first()
    assert r.quantile == pytest.approx(100 * 0.9 * (1 + 1 / 101) / 100) and r.coverage >= 0.9


def test_effect_sizes_edge_cases(spark):
    rows = [("a", y, "f", v) for y, v in ((0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0))] + [("b", 0, "f", 1.0), ("b", 1, "f", 1.0), (None, 1, "f", 2.0)]
    got = {r.register: r for r in stats.effect_sizes(spark.createDataFrame(rows, "register string, label int, feature string, value double")).collect()}
    assert got["a"].cohens_d == pytest.approx(4 / 2**0.5) and got["b"].cohens_d is None and got["all"].n_ai == 4


def test_sampling(spark):
    df, _ = scored(spark)
    assert max(r["count"] for r in sampling.capped(df, ["g", "y"], "id", 5).groupBy("g", "y").count().collect()) <= 5
    sizes = [r["count"] for r in sampling.folds(df.dropna(), ["y"], "id", 5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2
    matched = sampling.length_matched(df.dropna(), "g", "y", "s", "id", bins=4, least=2)
    by = {(r.g, r.bin, r.y): r["count"] for r in matched.groupBy("g", "bin", "y").count().collect()}
    assert by and all(by[g, b, 0] == by[g, b, 1] for g, b, _ in by)


def test_first_of_each_and_anti_join(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "z")], "id long, t string")
    assert {r.id for r in corpus.first_of_each(df, [F.col("t")], [F.col("id")]).collect()} == {1, 3, 5}
    known = spark.createDataFrame([("z",), (None,)], "t string")
    assert {r.id for r in corpus.without_known(df, known, F.col("t"), F.col("t"), [F.col("id")]).collect()} == {1, 3}


def test_interpolation_and_steps(spark):
    rows = [(1, i, v) for i, v in enumerate([None, 0.2, None, 0.6, None])] + [(2, i, v) for i, v in enumerate([0.2, 0.2, 0.4, 0.7])] + [(3, 0, None)]
    df = spark.createDataFrame(rows, "d long, idx int, s double")
    filled = windows.interpolated(df, "d", "s").orderBy("d", "idx").collect()
    assert [round(r.filled, 6) for r in filled if r.d == 1] == [0.2, 0.2, 0.4, 0.6, 0.6] and filled[-1].filled is None
    steps = windows.transitions(df, "d", "s").collect()
    assert [(r.d, r.idx, r.direction, round(r.delta, 3)) for r in steps] == [(1, 3, "human_to_ai", 0.4), (2, 3, "human_to_ai", 0.3)]
    assert {r.d: r.mean_score for r in windows.spans(df, "d", "s").collect()}[3] == 0.5


def test_scoring(spark):
    df = spark.createDataFrame([(1, 0.9, 10), (2, 0.5, 100), (3, 0.05, 30), (4, None, 5)], "id long, p double, n int")
    got = {r.id: r for r in df.select("id", scoring.damped(F.col("p"), F.col("n")).alias("d"), scoring.interval(F.col("p")).alias("i"), scoring.threshold_of(F.lit("xyz")).alias("t")).collect()}
    assert got[1].d == pytest.approx(0.541151, abs=1e-5) and got[2].i.lower == 0.25 and got[2].i.upper == 0.75 and got[2].i.uncertain and got[1].t == 0.5 and got[4].d is None
    c = {r.id: (r.level, r.probability) for r in scoring.cascade(df, "p", lambda d: d.withColumn("second", F.when(F.col("id") == 2, 0.7))).collect()}
    assert c[1][0] == c[3][0] == "level_1" and c[2] == ("level_2", 0.7) and c[4] == ("level_1", None)
    green = spark.range(1).select(scoring.is_green(F.lit("tok"), "42", 0.5).alias("a"), scoring.is_green(F.lit("tok"), "42", 0.99).alias("b")).first()
    assert not green.a and green.b


def test_token_bucket(spark):
    rows = [(1, i, f"2024-01-01 00:00:{i // 10:02d}") for i in range(100)] + [(2, 500, "2024-01-01 00:00:00"), (None, 501, "2024-01-01 00:00:00"), (3, 502, None)]
    df = spark.createDataFrame(rows, "u long, e long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.allowed for r in stateful.limited(df, "u", "e", "ts").collect()}
    assert sum(got[i] for i in range(100)) == 70
    assert got[0] and got[500] and not got[99] and len(got) == 101


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 1000 + i) for i in range(70)], "u long, e long, s long").select("u", "e", F.timestamp_seconds(F.col("s") / 100).alias("ts"), F.lit("k").alias("event_type"), F.lit(1.0).alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful.limited_stream(stream, "u", "e", "ts").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.event_id: r.allowed for r in stateful.limited(df, "u", "e", "ts").collect()}
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == batch
    q = stateful.first_of_key_stream(stream, ["event_type"], "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 1


def test_cache(spark):
    df = spark.createDataFrame([(1, "t", None, 0), (2, "t", None, 100), (3, "t", None, 3700), (4, "t", "news", 3701), (5, None, None, 0)], "i long, t string, r string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.event_id: r.hit for r in stateful.cache_hits(df, "i", "t", "r", "ts").collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_sources_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    sinks.append_new(a, str(tmp_path / "t"), "text", "id")
    assert sinks.append_new(spark.createDataFrame([(3, "y"), (4, "z"), (5, "z")], "id long, text string"), str(tmp_path / "t"), "text", "id") == 3
    assert {r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1, 2, 4}
    s = readers.shards(spark, [str(tmp_path / "t"), str(tmp_path / "none")], {"model": "m"})
    assert {r.model for r in s.collect()} == {"m"}
    sinks.save_csv(a, str(tmp_path / "c"))
    assert readers.csv_rows(spark, str(tmp_path / "c"), "id long, text string").count() == 2
    (tmp_path / "l.txt").write_text("a\n\n  b \n")
    assert [r.text for r in readers.lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    sums = readers.checksums(spark, str(tmp_path / "l.txt"))
    manifest = sums.select(F.lit("l.txt").alias("name"), "sha256").unionAll(spark.createDataFrame([("no", "x")], "name string, sha256 string"))
    assert {r.name: r.state for r in readers.verified(sums, manifest).collect()} == {"l.txt": "ok", "no": "missing"}
    assert readers.first_available([lambda: spark.read.parquet(str(tmp_path / "none")), lambda: a]).count() == 2
    assert readers.until_filled([a, a], 3).count() == 3
    assert sinks.markdown(a.orderBy("id")).splitlines()[2] == "| 1 | x |"
    with pytest.raises(FileNotFoundError):
        readers.shards(spark, [str(tmp_path / "none")], {})


def test_training(spark):
    df, _ = scored(spark, 300)
    df = df.dropna().withColumn("x", F.col("s") + F.col("y") * 0.5).withColumnRenamed("y", "label")
    cv = training.cross_validated(df, "lr", ["x", "s"], "id", k=3)
    assert training.fold_metrics(cv.withColumn("m", F.lit("lr")), ["m"]).first().auc_mean > 0.9
    model = training.classifier("lr", ["x", "s"]).fit(df)
    imp = {r.feature: r.importance_mean for r in training.permutation_importance(model, df, ["x", "s"], "id", repeats=1).collect()}
    assert imp["x"] > 0.05
