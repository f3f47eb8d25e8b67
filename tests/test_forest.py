"""Random search over forests grown from counted cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import forest, modeling, sampling

SETTINGS = [
    {}, {"numTrees": 60, "maxDepth": 4, "minInstancesPerNode": 4, "featureSubsetStrategy": "log2"},
    {"numTrees": 60, "maxDepth": 12, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"},
]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    made = [(i, i % 2, i % 2 + r.gauss(0, 0.9), float(r.choice([0, 0, 0, 0, 1, i % 2 + 2])), r.gauss(0, 1)) for i in range(1200)]
    return spark.createDataFrame(made, "id long, label int, a double, b double, c double").cache()


def test_random_search_fits_no_forest_by_jobs(rows, monkeypatch):
    # 21 forests of three folds by Spark ML were thousands of jobs: 288 s on 2,354 rows.
    monkeypatch.setattr(modeling, "classifier", lambda *a, **s: pytest.fail("a forest of its own jobs"))
    found = modeling.random_search(rows, ["a", "b", "c"], "id").collect()
    assert [r.draw for r in found] == list(range(21)) and all(0.7 < r.auc < 0.95 for r in found)
    assert {r.auc for r in found if r.best} == {max(r.auc for r in found)}
    same = {}
    assert all(same.setdefault(r.parameters, r.auc) == r.auc for r in found)
    assert [tuple(r) for r in found] == [tuple(r) for r in modeling.random_search(rows.repartition(3), ["a", "b", "c"], "id").collect()]


def test_aucs_are_those_of_sparks_forests(rows):
    features = ["a", "b", "c"]
    folded = sampling.folds(rows, ["label"], "id", 3).cache()
    ours = forest.cv_aucs(folded, features, SETTINGS, "label", 3)
    theirs = [modeling._cv_auc(folded, "rf", features, "label", 3, s) for s in SETTINGS]
    assert ours == pytest.approx(theirs, abs=0.012)


def test_one_tree_without_chance_is_the_best_tree():
    # Every cell has so many rows that their Poisson weights keep the shares.
    bins = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    pos, neg = np.array([9, 1, 1, 9]) * 10**6, np.array([1, 9, 9, 1]) * 10**6
    p = forest.grown(bins, pos, neg + np.array([1, 0, 0, 0]) * 10**6, {"numTrees": 1, "maxDepth": 2})
    assert p == pytest.approx([9 / 11, 0.1, 0.1, 0.9], abs=0.01)
    # Leaves of one parent that predict the same are one leaf.
    p = forest.grown(np.array([[0], [1], [2]]), np.array([9, 6, 1]) * 10**6, np.array([1, 4, 9]) * 10**6, {"numTrees": 1})
    assert p == pytest.approx([0.75, 0.75, 0.1], abs=0.01)
    # A split leaves enough rows on either side.
    p = forest.grown(np.array([[0], [1]]), np.array([5, 0]), np.array([0, 5]), {"numTrees": 9, "minInstancesPerNode": 50})
    assert p[0] == p[1]


def test_bins_are_quantiles_and_all_values_of_few(spark):
    repeated = [0.0] * 900 + [1.0] * 60 + [2.0, 2.0, 3.0, 3.0, 4.0, 4.0, 5.0, 5.0] * 5
    made = [(i % 2, float(i), repeated[i]) for i in range(1000)]
    folded = spark.createDataFrame(made, "fold int, a double, b double")
    ends = forest.thresholds(folded, ["a", "b"], 2)
    for f in (0, 1):
        a, b = ends[f]
        inside = np.arange(1 - f, 1000, 2)
        sizes = np.bincount(np.searchsorted(a, inside), minlength=32)
        assert len(a) == 31 and set(sizes) <= {15, 16}
        assert set(b) == {x[2] for x in made if x[0] != f} - {max(x[2] for x in made if x[0] != f)}


def test_tables_beyond_the_cells_and_other_parameters_take_sparks_forests(rows, monkeypatch):
    few = {"numTrees": [3], "maxDepth": [2]}
    monkeypatch.setattr(forest, "CELLS", 10)
    assert all(r.auc > 0.6 for r in modeling.random_search(rows, ["a", "b"], "id", draws=1, space=few).collect())
    monkeypatch.undo()
    monkeypatch.setattr(forest, "cv_aucs", lambda *a: pytest.fail("not covered"))
    assert len(modeling.random_search(rows, ["a"], "id", draws=1, space=few | {"impurity": ["entropy"]}).collect()) == 2


def test_odd_tables(spark, rows):
    few = {"numTrees": [5], "maxDepth": [3]}
    run = lambda df, c: [r.auc for r in modeling.random_search(df, c, "id", draws=1, space=few).collect()]
    assert run(rows.limit(0), ["a"]) == [None, None]
    assert run(rows.filter("label = 1"), ["a", "b"]) == [None, None]
    assert run(rows.withColumn("k", F.lit(7)), ["k"]) == [0.5, 0.5]
    holes = rows.withColumn("a", F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("a")))
    assert run(holes, ["a"]) == run(rows.filter("id % 5 > 1"), ["a"])
    wide = rows.withColumn("a", F.when(F.col("a") > 2, F.lit(float("inf"))).when(F.col("a") < -1, F.lit(float("-inf"))).otherwise(F.col("a")))
    assert all(x > 0.6 for x in run(wide, ["a"]))
