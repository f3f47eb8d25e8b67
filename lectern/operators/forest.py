"""Held-out AUC of many forests from counted cells.

A forest sees of a feature only the bin it falls into, so rows of equal bins and label are one cell with a count. One
pass counts the cells of every fold, exactly and whatever the number of rows; each forest is then grown from the cells in
a task of its own. A bootstrap that gives every row a Poisson weight of mean 1 gives a cell a Poisson weight of its
count. Bins, splits, features for each node, pruning and votes are those of Spark's RandomForestClassifier, except that
bins come from all values in place of a sample of them, and that random numbers are others.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import running
from lectern.plans.stage import written

BINS = 32
#: Cells a fold up to which a task holds them; tables with more are left to Spark's own forests.
CELLS = 100_000
#: Cells times trees that are grown at once.
AT_ONCE = 50_000
SETTINGS = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy"}
STRATEGIES = {
    "auto": lambda d, trees: d if trees == 1 else ceil(d**0.5), "all": lambda d, trees: d,
    "sqrt": lambda d, trees: ceil(d**0.5), "log2": lambda d, trees: max(1, ceil(log2(d))),
    "onethird": lambda d, trees: ceil(d / 3),
}
COUNTS = ["train_pos", "train_neg", "held_pos", "held_neg"]


def covers(settings: dict) -> bool:
    """Whether forests of these settings can be grown here."""
    return set(settings) <= SETTINGS and settings.get("featureSubsetStrategy", "auto") in STRATEGIES


# ---- bins and cells --------------------------------------------------------------------------------------------------
def thresholds(folded: DataFrame, features: list[str], k: int) -> list[list[np.ndarray]]:
    """Of each fold and feature at most 31 values of the rows outside the fold; a bin ends with its value. They are
    quantiles; what values repeated over several bins leave free goes to quantiles of the values not yet chosen."""
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    each = folded.select("fold", F.posexplode(values).alias("feature", "value")).groupBy("feature", "value")
    counted = written(each.agg(*(F.sum((F.col("fold") != f).cast("long")).alias(f"n{f}") for f in range(k))))

    def crossing(gone: dict, bins: dict) -> list[tuple]:
        """(fold, feature, value, is_last) of the values at which a bin is full, values ``gone`` counting nothing."""
        left = counted
        for f in range(k):
            done = [(F.col("feature") == i) & F.col("value").isin(*v) for (g, i), v in gone.items() if g == f and v]
            for d in done:
                left = left.withColumn(f"n{f}", F.when(d, F.lit(0)).otherwise(F.col(f"n{f}")))
        upto = running.running_sums(left, ["feature"], [F.col("value")], [f"n{f}" for f in range(k)], totals=True)
        hits = []
        for f in range(k):
            n, at, total = (F.col(f"n{f}{x}") for x in ("", "_upto", "_all"))
            most = F.get(F.array(*(F.lit(bins.get((f, i), 0)) for i in range(len(features)))), F.col("feature"))
            full = F.floor(at * most / total) > F.floor((at - n) * most / total)
            hits.append(F.when((n > 0) & full, F.struct(F.lit(f).alias("fold"), (at == total).alias("is_last"))))
        found = upto.select("feature", "value", F.explode(F.array_compact(F.array(*hits))).alias("h"))
        return [(r.h.fold, r.feature, r.value, r.h.is_last) for r in found.collect()]

    keys = [(f, i) for f in range(k) for i in range(len(features))]
    chosen: dict[tuple, set[float]] = {key: set() for key in keys}
    largest: dict[tuple, set[float]] = {key: set() for key in keys}
    # The largest value ends no bin: nothing is beyond it.
    for f, i, value, is_last in crossing({}, dict.fromkeys(keys, BINS)):
        (largest if is_last else chosen)[f, i].add(value)
    open_ = {key for key in keys if largest[key] and len(chosen[key]) < BINS - 1}
    while open_:
        gone = {key: chosen[key] | largest[key] for key in open_}
        hits = crossing(gone, {key: BINS - 1 - len(chosen[key]) for key in open_})
        for f, i, value, _ in hits:
            chosen[f, i].add(value)
        open_ = {(f, i) for f, i, _, _ in hits if len(chosen[f, i]) < BINS - 1}
    return [[np.array(sorted(chosen[f, i])) for i in range(len(features))] for f in range(k)]


def counted_cells(folded: DataFrame, features: list[str], label: str, ends: list[list[np.ndarray]], k: int) -> DataFrame:
    """(out, cell, counts): of each fold left out, the rows of either label inside and outside it by their bins, which
    are the bytes of ``cell``."""
    wide = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(wide)]
            y, fold = (b.column(wide + i).to_numpy(zero_copy_only=False) for i in range(2))
            for f in range(k if b.num_rows else 0):
                bins = np.stack([np.searchsorted(e, v) for e, v in zip(ends[f], x)], axis=1).astype(np.uint8)
                kinds, at = np.unique(bins.view(f"V{wide}").ravel(), return_inverse=True)
                kind = 2 * (fold == f) + (y == 0)
                n = np.bincount(at * 4 + kind, minlength=4 * len(kinds)).reshape(-1, 4)
                cells = pa.array([v.tobytes() for v in kinds], pa.binary())
                out = pa.array(np.full(len(kinds), f, np.int32))
                yield pa.RecordBatch.from_arrays([out, cells, *map(pa.array, n.T.astype(np.int64))], names=["out", "cell", *COUNTS])

    rows = folded.select(*(F.col(f"`{c}`").cast("double") for c in features), F.col(label).cast("int"), F.col("fold").cast("int"))
    parts = rows.mapInArrow(run, ", ".join(["out int, cell binary", *(f"{c} long" for c in COUNTS)]))
    return parts.groupBy("out", "cell").agg(*(F.sum(c).alias(c) for c in COUNTS))


# ---- forests ---------------------------------------------------------------------------------------------------------
def _trees(bins: np.ndarray, pos: np.ndarray, neg: np.ndarray, t: int, depth: int, least: int, tried: int, rng) -> np.ndarray:
    """Share of label 1 in the leaf of each cell, by tree; NaN for a tree without rows."""
    n, d = bins.shape
    w_pos = rng.poisson(pos, (t, n)).ravel().astype(np.float64)
    w_all = w_pos + rng.poisson(neg, (t, n)).ravel()
    cell = np.tile(np.arange(n), t)
    node = np.repeat(np.arange(t), n)
    # Of the nodes of each level: first number, rows of label 1, rows, parent's number.
    levels = [(0, np.bincount(node, w_pos, t), np.bincount(node, w_all, t), np.full(t, -1))]
    for _ in range(depth):
        first, p, a, _ = levels[-1]
        open_ = np.flatnonzero((p > 0) & (p < a) & (a >= 2 * least))
        if not len(open_):
            break
        m = len(open_)
        place = np.full(len(p), -1)
        place[open_] = np.arange(m)
        own = np.where(node >= first, place[np.maximum(node - first, 0)], -1)
        rows = np.flatnonzero(own >= 0)
        local = own[rows]
        p, a = p[open_], a[open_]
        # The features of each node are a random choice without replacement.
        among = np.argsort(rng.random((m, d)), axis=1)[:, :tried]
        takes = np.zeros((m, d), bool)
        np.put_along_axis(takes, among, True, axis=1)
        best, feature, bin_ = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        left_p, left_a = np.zeros(m), np.zeros(m)
        impurity = 2 * p * (a - p) / a
        for j in range(d):
            some = np.flatnonzero(takes[:, j])
            if not len(some):
                continue
            index = np.full(m, -1)
            index[some] = np.arange(len(some))
            at = index[local]
            inside = at >= 0
            key = at[inside] * BINS + bins[cell[rows[inside]], j]
            shape = (len(some), BINS)
            lp = np.cumsum(np.bincount(key, w_pos[rows[inside]], len(some) * BINS).reshape(shape), axis=1)[:, :-1]
            la = np.cumsum(np.bincount(key, w_all[rows[inside]], len(some) * BINS).reshape(shape), axis=1)[:, :-1]
            rp, ra = p[some, None] - lp, a[some, None] - la
            valid = (la >= least) & (ra >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = impurity[some, None] - 2 * lp * (la - lp) / la - 2 * rp * (ra - rp) / ra
                gain = np.where(valid, gain / a[some, None], -np.inf)
            top = gain.argmax(axis=1)
            line = np.arange(len(some))
            better = gain[line, top] > best[some]
            to = some[better]
            best[to], feature[to], bin_[to] = gain[line, top][better], j, top[better]
            left_p[to], left_a[to] = lp[line, top][better], la[line, top][better]
        # What rounding leaves is no gain.
        split = np.flatnonzero(best > 1e-15)
        if not len(split):
            break
        start = first + len(levels[-1][1])
        child = np.full(m, -1)
        child[split] = start + 2 * np.arange(len(split))
        moves = child[local] >= 0
        rows, local = rows[moves], local[moves]
        node[rows] = child[local] + (bins[cell[rows], feature[local]] > bin_[local])
        both = lambda left, whole: np.stack([left[split], whole[split] - left[split]], axis=1).ravel()
        levels.append((start, both(left_p, p), both(left_a, a), np.repeat(first + open_[split], 2)))
    p, a, parent = (np.concatenate([level[i] for level in levels]) for i in (1, 2, 3))
    # Two leaves of one parent that predict the same label are one leaf, from the lowest level up.
    leaf = np.ones(len(p), bool)
    leaf[parent[parent >= 0]] = False
    says, stands = p > a - p, np.arange(len(p))
    for start, x, _, up in reversed(levels[1:]):
        lefts = np.arange(start, start + len(x), 2)
        same = leaf[lefts] & leaf[lefts + 1] & (says[lefts] == says[lefts + 1])
        leaf[up[::2][same]] = True
        for side in (0, 1):
            stands[lefts[same] + side] = up[::2][same]
    for start, x, _, _ in levels[1:]:
        # A pruned parent may itself be pruned.
        own = slice(start, start + len(x))
        stands[own] = np.where(stands[own] != np.arange(start, start + len(x)), stands[stands[own]], stands[own])
    with np.errstate(divide="ignore", invalid="ignore"):
        return (p / a)[stands[node]].reshape(t, n)


def grown(bins: np.ndarray, pos: np.ndarray, neg: np.ndarray, settings: dict, seed: tuple[int, ...] = (42,)) -> np.ndarray:
    """The probability of label 1 in each cell, by a forest on the counts of either label."""
    trees, depth = settings.get("numTrees", 100), settings.get("maxDepth", 10)
    least = settings.get("minInstancesPerNode", 1)
    tried = STRATEGIES[settings.get("featureSubsetStrategy", "auto")](bins.shape[1], trees)
    rng = np.random.default_rng(seed)
    total, voting = np.zeros(len(bins)), np.zeros(len(bins))
    step = max(1, AT_ONCE // max(1, len(bins)))
    for s in range(0, trees, step):
        votes = _trees(bins, pos, neg, min(step, trees - s), depth, least, tried, rng)
        total += np.nansum(votes, axis=0)
        voting += (~np.isnan(votes)).sum(axis=0)
    return total / np.maximum(voting, 1)


def cell_auc(p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float | None:
    """Area under the ROC curve by rank sums, ties by half; null without rows of both labels."""
    if not pos.sum() or not neg.sum():
        return None
    _, at = np.unique(p, return_inverse=True)
    y, n = np.bincount(at, pos), np.bincount(at, neg)
    return float((y * (np.cumsum(n) - n / 2)).sum() / (pos.sum() * neg.sum()))


def cv_aucs(folded: DataFrame, features: list[str], tried: list[dict], label: str, k: int) -> list[float | None] | None:
    """The mean AUC over k folds (column ``fold``) of a forest of each of the settings; null if the features have too many
    cells to be held by a task. Labels are 0 and 1, features without nulls and NaN."""
    spark = folded.sparkSession
    table = written(counted_cells(folded, features, label, thresholds(folded, features, k), k))
    sizes = [r["count"] for r in table.groupBy("out").count().collect()]
    if max(sizes, default=0) > CELLS:
        return None
    # A few thousand rows, at most CELLS a fold.
    cells = table.orderBy("out", "cell").toArrow()
    out = cells.column("out").to_numpy()
    bins = np.frombuffer(b"".join(cells.column("cell").to_pylist()), np.uint8).reshape(len(out), len(features)).astype(np.int64)
    counts = np.stack([cells.column(c).to_numpy() for c in COUNTS], axis=1)
    held = spark.sparkContext.broadcast([(bins[out == f], *counts[out == f].T) for f in range(k)])
    kinds = [dict(x) for x in dict.fromkeys(tuple(sorted(s.items())) for s in tried)]
    jobs = [(s, f) for s in range(len(kinds)) for f in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                s, f = jobs[i]
                x, train_pos, train_neg, held_pos, held_neg = held.value[f]
                p = grown(x, train_pos, train_neg, kinds[s], (42, f))
                yield pd.DataFrame({"s": [s], "f": [f], "auc": [cell_auc(p, held_pos, held_neg)]}).astype({"auc": "float64"})

    found = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, "s int, f int, auc double").toPandas()
    held.unpersist()
    mean = found.sort_values(["s", "f"]).groupby("s")["auc"].mean()
    return [None if np.isnan(a) else float(a) for a in (mean[kinds.index(s)] for s in tried)]
