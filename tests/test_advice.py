"""Whole jobs of queries: strategies, features, words and terms that none may leave out."""

import pytest
from pyspark.sql import functions as F

from lectern import catalog
from lectern.operators import perturb, training

SMALL = "/root/testdata/sf0.001"


def test_every_strategy_has_an_auc(spark):
    rows = {r.strategy: r for r in catalog.QUERIES["h7_auc_by_strategy"](spark, SMALL).collect()}
    assert set(rows) == {"clean", "combined", *perturb.STRATEGIES}
    assert rows["clean"].auc_delta == 0 and len({r.n_neg for r in rows.values()}) == 1
    assert rows["combined"].auc_delta == pytest.approx(rows["combined"].auc - rows["clean"].auc, abs=2e-6)


def test_all_original_features_are_explained(spark):
    norms = {r.feature for r in spark.read.parquet(f"{SMALL}/effect_sizes.parquet").select("feature").distinct().collect()}
    assert len(norms) == 11
    assert {r.feature for r in catalog.QUERIES["m9_explained"](spark, SMALL).select("feature").distinct().collect()} == norms
    assert {r.feature for r in catalog.QUERIES["effect_sizes_original"](spark, SMALL).select("feature").distinct().collect()} == norms


def test_calibration_reads_the_words_of_the_texts(spark, tmp_path):
    from shutil import copytree

    copytree(SMALL, tmp_path / "d")
    run = lambda: {r.kind: r for r in catalog.QUERIES["m7_calibrated"](spark, str(tmp_path / "d")).collect()}
    a = run()
    assert set(a) == {"p", "platt", "isotonic"} and {"brier", "log_loss", "ece"} <= set(a["p"].asDict())
    c = spark.read.parquet(f"{SMALL}/corpus_raw.parquet")
    c.withColumn("text", F.when(F.col("text").isNotNull(), F.repeat(F.lit("w "), (F.col("label") * 500 + 5).cast("int")))).write.parquet(str(tmp_path / "c"))
    (tmp_path / "d/corpus_raw.parquet").unlink()
    (tmp_path / "c").rename(tmp_path / "d/corpus_raw.parquet")
    b = run()
    assert b["platt"].brier < a["platt"].brier / 2 and b["isotonic"].brier == pytest.approx(a["isotonic"].brier, abs=0.05)


def test_text_classifier_predicts_held_out_folds(spark, monkeypatch):
    fits = []
    of = training.text_classifier
    monkeypatch.setattr(training, "text_classifier", lambda label="label", words="words", size=10_000: fits.append(size) or of(label, words, size))
    df = spark.createDataFrame([(i, i % 2, ["a" if i % 2 else "b", f"only{i}", "c"]) for i in range(40)], "doc_id long, label int, words array<string>")
    got = training.text_cross_validated(df, "doc_id", k=2).collect()
    assert fits == [10_000, 10_000] and len(got) == 40 and {r.fold for r in got} == {0, 1}
    assert all(r.prediction == r.label for r in got)
