"""Models by register, hybrid vectors, shapes, checks, sources and SQL names on small fixtures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import register as names
from lectern.functions.kernel import ORIGINAL
from lectern.operators import modeling, sampling, shape, stats, training, windows
from lectern.plans import detect
from lectern.sources import readers, sinks


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    rows = []
    for i in range(240):
        y, reg = i % 2, ["news", "social", None][i % 3]
        rows.append((i, reg, y, y + r.gauss(0, 0.6), (1 if reg == "news" else -1) + r.gauss(0, 0.2)))
    return spark.createDataFrame(rows, "id long, register string, label int, a double, b double").cache()


def test_models_by_register_are_saved_and_routed(spark, labelled, tmp_path):
    models = modeling.fitted_by_register(labelled, ["a", "b"], kind="lr", least=50)
    assert set(models) == {"all", "news", "social"}
    path = str(tmp_path / "models")
    modeling.save_models(models, path, spark)
    modeling.save_models(models, path, spark)
    assert (tmp_path / "models.bak").exists()
    loaded = modeling.load_models(path, spark)
    new = labelled.withColumn("register", F.coalesce("register", F.lit("poetry")))
    a = {r.id: (r.scored_as, r.p) for r in modeling.scored_by_register(new, loaded).collect()}
    b = {r.id: (r.scored_as, r.p) for r in modeling.scored_by_register(new, models).collect()}
    assert len(a) == 240 and a == b and {x for x, _ in a.values()} == {"all", "news", "social"}
    fast = labelled.withColumn("q", training.logistic_expression(models["all"]))
    both = training.probabilities(models["all"], fast).collect()
    assert all(r.p == pytest.approx(r.q) for r in both)


def test_register_classifier(spark, labelled):
    model = modeling.register_classifier(labelled, ["a", "b"], trees=10)
    got = modeling.with_register(labelled.drop("register"), model).collect()
    assert sum(r.register_found == "news" for r in got) > 60 and all(0 <= r.register_confidence <= 1 for r in got)
    forced = modeling.with_register(labelled, model, F.lit("social")).first()
    assert (forced.register_found, forced.register_confidence) == ("social", None)
    none = modeling.with_register(labelled, None).first()
    assert (none.register_found, none.register_confidence) == ("all", None)


def test_hybrid_vectors(spark, labelled):
    wide = labelled.select("id", "register", "label", *(F.col("a").alias(f) for f in ORIGINAL), "b")
    df, columns = modeling.hybrid_columns(wide, {"semantic": "b"})
    assert len(columns) == 15 and df.first()["_h_perplexity"] == 50.0
    models = modeling.fitted_by_register(df, columns, kind="lr")
    short = wide.withColumn("mtld", F.when(F.col("id") > 0, F.col("mtld")))
    got = {r.id: r.second for r in modeling.hybrid_scored(short, models, {"semantic": "b"}).collect()}
    assert got[0] == 0.5 and len(got) == 240
    with pytest.raises(ValueError):
        narrow = modeling.fitted_by_register(labelled, ["a", "b"], kind="lr")
        modeling.hybrid_scored(wide, narrow, {})


def test_reductions_of_token_scores(spark):
    df = spark.createDataFrame([([-1.0, -3.0], [1.0, 3.0]), ([], []), (None, None)], "lp array<double>, ce array<double>")
    of = lambda c: [r[0] for r in df.select(c).collect()]
    assert of(modeling.perplexity(F.col("lp"))) == [pytest.approx(7.389056), None, None]
    assert of(modeling.burstiness(F.col("lp")))[0] == 1.0
    assert of(modeling.binoculars(F.col("lp"), F.col("ce")))[0] == pytest.approx(1.0)
    said = spark.createDataFrame([("about 0.75.",), ("7",), ("none",), (None,)], "t string")
    assert [r[0] for r in said.select(modeling.probability_in(F.col("t"))).collect()] == [0.75, 1.0, None, None]


def test_search_selection_and_comparison(spark, labelled):
    found = modeling.random_search(labelled, ["a", "b"], "id", draws=2, space={"numTrees": [5], "maxDepth": [3]}).collect()
    assert len(found) == 3 and sum(r.best for r in found) >= 1
    kinds = modeling.selected_models(labelled, ["a", "b"], "id", least=70, kinds=("lr",)).collect()
    assert {r.register for r in kinds} == {"all", "news", "social"} and all(r.chosen for r in kinds)
    sweep = modeling.regularisation(labelled, labelled, ["a", "b"], strengths=(1.0, 0.001)).collect()
    assert [r.c for r in sweep] == [1.0, 0.001] and all(r.test_auc > 0.7 for r in sweep)
    plans = {r.strategy: r.auc for r in modeling.ensembler_strategies(labelled, labelled, ["a"], ["b"]).collect()}
    assert plans["features_and_neural"] > plans["neural"] and len(plans) == 4
    weights = {r.feature: r.coefficient for r in modeling.coefficients(labelled, ["a", "b"]).collect()}
    assert weights["a"] > abs(weights["b"])


def test_labels_and_requests(spark):
    df = spark.createDataFrame([("human",), ("0",), ("gpt",), ("1",), (None,)], "m string")
    of = lambda s: [r[0] for r in df.select(shape.label_of(F.col("m"), s)).collect()]
    assert of("plain") == [0, 0, 1, 1, None] and of("lenient") == [0, 0, 0, 1, None] and of("named") == [0, 1, 1, 1, None]
    assert of("flipped") == [None, 1, None, 0, None]
    with pytest.raises(ValueError):
        shape.label_of(F.col("m"), "other")
    good = "word " * 40
    texts = [(1, good, "News "), (2, None, "news"), (3, " ", None), (4, "short", None), (5, good, "law"), (6, "x" * 10_001, None), (7, good, None)]
    got = {r.i: r.error for r in shape.checked_requests(spark.createDataFrame(texts, "i int, text string, register string")).collect()}
    assert got == {1: None, 2: "no text", 3: "no text", 4: "text under 30 words", 5: "unknown register", 6: "text over 10000 characters", 7: None}


def test_shapes(spark):
    a = spark.createDataFrame([(3, "x"), (1, "y"), (2, None)], "k int, v string")
    b = spark.createDataFrame([("p", 9), ("q", 8)], "v string, o int")
    assert [tuple(r) for r in shape.zipped(a, ["k"], b, ["o"]).orderBy("k").collect()] == [(1, "y", "q", 8), (2, None, "p", 9)]
    assert sorted(r.v for r in shape.key_union([a, b], "v").collect()) == ["p", "q", "x", "y"]
    assert [r.k for r in shape.reindexed(a, "v", ["y", "none", "x"]).orderBy("place").collect()] == [1, None, 3]
    assert {r.column: (r.x, r.y) for r in shape.transposed(a, "v", ["k"]).collect()} == {"k": (3, 1)}
    assert {r.k for r in shape.shuffled(a, "k").collect()} == {1, 2, 3}
    tags = spark.createDataFrame([(["NN", "VB", "NN", "VB"],), (["JJ"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in tags.select(shape.bigram_entropy(F.col("t"))).collect()] == [pytest.approx(0.918296, abs=1e-6), 0.0, 0.0, 0.0]
    ratio = tags.select(shape.tag_ratios(F.col("t")).alias("r")).first().r
    assert (ratio.noun_verb_ratio, ratio.adj_adv_ratio) == (1.0, 0.0)
    rows = [(i, "none" if i < 10 else "upper", int(i % 2)) for i in range(20)]
    quota = shape.attack_quota(spark.createDataFrame(rows, "i int, attack string, y int"), "attack", "y", ["i"], 2, 3).collect()
    assert {r.i for r in quota} == {1, 3, 0, 2, 4, 11, 13}
    rates = stats.detection_rates(spark.createDataFrame([("none", 1, 0.9), ("none", 0, 0.1), ("up", 1, 0.2), ("up", 1, 0.95)], "a string, y int, s double"), "a", "s", "y")
    assert {r.a: r.detection_rate for r in rates.collect()} == {"none": 1.0, "up": 0.5}


def test_synthetic_sets(spark):
    p = {r.profile: r for r in sampling.synthetic_profiles(spark, 2000).groupBy("profile").agg(F.avg("adj_adv_ratio").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    assert p["reasoning"].m == pytest.approx(2.5, abs=0.05) and p["human"].n == 2000
    c = sampling.synthetic_calibration(spark).agg(F.avg("p").alias("m"), F.stddev("p").alias("s"), F.avg("label").alias("y")).first()
    assert c.m == pytest.approx(0.5, abs=0.03) and c.s == pytest.approx(0.2236, abs=0.02) and c.y == pytest.approx(0.5, abs=0.06)


def test_sql_names(spark):
    names.register(spark)
    spark.createDataFrame([(1, "It is here. We saw it go."), (2, None), (3, "x")], "i int, t string").createOrReplaceTempView("texts")
    assert spark.sql("SELECT i, s.sentence FROM texts, LATERAL sentences(t) s").count() == 3
    r = {x.i: x for x in spark.sql("SELECT i, stylo_features(t) AS f, mtld(t) AS m, nfkc('ｘ') AS k, nfc(t) AS c, erfc(0.0D) AS e FROM texts").collect()}
    assert r[1].f.n_words == 7 and r[2].f.mtld is None and r[3].m is None and r[1].k == "x" and r[1].e == 1.0 and r[2].c is None


def test_window_fallbacks(spark):
    t = "One two three four five six. Two. Three."
    df = spark.createDataFrame([(1, t), (2, "Hi."), (3, None)], "i int, text string")
    shifted = windows.shifted_windows(windows.sentence_rows(df, "i"), "i").collect()
    assert {r.window for r in shifted if r.i == 1} == {t}
    got = {(r.id, r.idx): r.score for r in detect.analysed_sentences(df, "i").collect()}
    assert got[2, 0] == 0.5 and len({got[1, k] for k in range(3)}) == 1


def test_cursor_pages_and_waiting(spark):
    class Feed(readers.CursorPages):
        def fetch(self, feed, cursor):
            at = int(cursor or 0)
            return [f"{feed}{at + i}" for i in range(2)], str(at + 2) if at < 6 else None

    waits, tries = [], []

    def fetch(cursor):
        tries.append(cursor)
        if len(tries) < 3:
            raise readers.TooMany(0.5)
        return ["t"], None

    assert readers.fetched(fetch, "c", 5, waits.append) == (["t"], None) and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        readers.fetched(lambda c: (_ for _ in ()).throw(OSError("gone")), None, 1, waits.append)
    spark.dataSource.register(Feed)
    rows = spark.read.format("cursor_pages").option("feeds", "a,b").option("need", "5").load().collect()
    assert sorted(r.text for r in rows) == sorted(f"{f}{i}" for f in "ab" for i in range(5))


def test_files(spark, tmp_path):
    whole = b"one two three"
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        (folder / f"big.bin.part{i}").write_bytes(whole[5 * i : 5 * i + 5])
    sha = hashlib.sha256(whole).hexdigest()
    manifest = spark.createDataFrame([("big.bin", 13, sha), ("big.bin2", 1, sha)], "name string, length long, sha256 string")
    parts = spark.read.format("binaryFile").load(str(folder))
    assert {r.name: r.state for r in readers.reassembled(parts, manifest).collect()} == {"big.bin": "ok", "big.bin2": "missing"}
    for i in range(7):
        (tmp_path / f"c{i}.csv").write_text("a\n1\n2\n3\n")
    got = readers.csv_sample(spark, f"{tmp_path}/c*.csv", "a int", per_file=2)
    assert got.count() == 10 and got.select("file").distinct().count() == 5
    spark.range(3).write.parquet(str(tmp_path / "hub/set/train"))
    assert readers.hub_table(spark, str(tmp_path / "hub"), "set").count() == 3
    with pytest.raises(FileNotFoundError):
        readers.hub_table(spark, str(tmp_path / "hub"), "set", "test")
    text = sinks.latex(spark.createDataFrame([("a_b", 0.5), (None, 2.0)], "n string, v double"), "50 % more")
    assert r"a\_b & 0.5000 \\" in text and r"\caption{50 \% more}" in text


def test_stream_ends_when_filled(spark, tmp_path):
    for i in range(5):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = readers.ingested(spark, str(tmp_path / "in"), "id long", lambda df: df.filter("id % 2 = 0"), 8, str(tmp_path / "out"))
    assert held == 8 and spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_margins_become_probabilities(spark):
    r = random.Random(2)
    rows = [(i, i % 2, i % 5, (i % 2) + r.gauss(0, 0.5), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, fold int, margin double, prediction double")
    got = training.calibrated_margins(df, "margin", "label").collect()
    assert len(got) == 200 and all(0 <= x.p <= 1 for x in got) and got[0].prediction in (0.0, 1.0)
    assert sum(x.p for x in got if x.label) > sum(x.p for x in got if not x.label) + 40
    grams = spark.createDataFrame([(["ab", "c"],), (None,)], "w array<string>").select(training.word_grams(F.col("w")).alias("g")).collect()
    assert grams[0].g == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "] and grams[1].g is None
