"""Statistics of labelled scores and features.

Rank-based figures work on distinct scores: rows are first counted by (group, score), which combines map
side, and running sums over those counts are range-partitioned (``operators.running``), so no group is sorted in
one task. Null scores or labels take part in nothing. Figures without both
labels, or with a zero divisor, are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.operators.running import group_key, running_sums
from lectern.plans.stage import written


def div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(keys, features, "feature", "value").filter("value is not null")


def with_all(df: DataFrame, group: str) -> DataFrame:
    """Rows once under their group and once under "all"; null groups only under "all"."""
    return df.withColumn(group, F.explode(F.when(F.col(group).isNull(), F.array(F.lit("all"))).otherwise(F.array(F.col(group), F.lit("all")))))


def _effects(g: DataFrame, group: str) -> DataFrame:
    """Effect sizes from (group, feature) with n, mean and var of either label."""
    squares = (F.col("n_human") - 1) * F.col("var_human") + (F.col("n_ai") - 1) * F.col("var_ai")
    pooled = F.sqrt(squares / F.nullif(F.col("n_human") + F.col("n_ai") - 2, F.lit(0)))
    d = F.when((F.col("n_human") < 2) | (F.col("n_ai") < 2), None).when(pooled == 0, 0.0)
    d = d.otherwise(div(F.col("mean_ai") - F.col("mean_human"), pooled))
    return g.select(
        group, "feature", "n_human", "n_ai", F.col("mean_human").alias("human_mean"),
        F.sqrt("var_human").alias("human_sd"), F.col("mean_ai").alias("ai_mean"), F.sqrt("var_ai").alias("ai_sd"),
        d.alias("cohens_d"),
    )


def effect_sizes(long: DataFrame, group: str = "register", label: str = "label") -> DataFrame:
    """Of each group and feature, and over all: counts, means, sample deviations by label and Cohen's d with pooled
    deviation (0 if that is 0, null with fewer than two of a label). ``long`` has a row for each feature's value."""
    on = lambda k: F.when(F.col(label) == k, F.col("value"))
    kinds = ((0, "human"), (1, "ai"))
    figures = (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    moments = [f(on(k)).alias(f"{n}_{who}") for k, who in kinds for n, f in figures]
    return _effects(with_all(long, group).groupBy(group, "feature").agg(*moments), group)


def effect_sizes_wide(df: DataFrame, group: str, features: list[str], label: str = "label") -> DataFrame:
    """The same from one column for each feature: rows are neither unpivoted nor repeated for the whole. Moments are
    taken by group and label in one pass, and those of all rows are put together from them."""
    figures = (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    columns = [f(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in figures]
    wide = df.filter(F.col(label).isin(0, 1)).groupBy(group, F.col(label).alias("_y")).agg(*columns)
    each = F.array(
        *(
            F.struct(F.lit(c).alias("feature"), *(F.col(f"{n}_{i}").alias(n) for n, _ in figures))
            for i, c in enumerate(features)
        )
    )
    part = wide.select(group, "_y", F.explode(each).alias("m")).select(group, "_y", "m.*").filter("n > 0")
    n, mean = F.col("n"), F.col("mean")
    total = F.sum("n")
    centre = F.sum(n * mean) / total
    spread = F.sum(F.when(n > 1, (n - 1) * F.col("var")).otherwise(0.0)) + F.sum(n * mean * mean) - total * centre * centre
    merged = part.groupBy("feature", "_y").agg(
        total.alias("n"), centre.alias("mean"), F.when(total > 1, F.greatest(spread, F.lit(0.0)) / (total - 1)).alias("var")
    )
    both = part.filter(F.col(group).isNotNull()).unionByName(merged.withColumn(group, F.lit("all")).select(*part.columns))
    on = lambda c, k: F.max(F.when(F.col("_y") == k, F.col(c)))
    kinds = ((0, "human"), (1, "ai"))
    g = both.groupBy(group, "feature").agg(*(on(c, k).alias(f"{c}_{who}") for k, who in kinds for c, _ in figures))
    return _effects(g.fillna(0, ["n_human", "n_ai"]), group)


def score_counts(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """(groups, score, pos, neg): the counts all rank figures start from."""
    return df.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(*groups, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def auc(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties by half, with the Mann-Whitney U of the positives and its variance with tie correction."""
    c = running_sums(score_counts(df, groups, score, label), groups, [F.col("score")], ["neg"])
    below = F.col("neg_upto") - F.col("neg")
    t = (F.col("pos") + F.col("neg")).cast("double")
    placed = c.withColumn("_u", F.col("pos") * (below + F.col("neg") / 2.0)).withColumn("_t", t * t * t - t)
    g = placed.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("_u").alias("u"), F.sum("_t").alias("_tie")
    )
    n = F.col("n_pos") + F.col("n_neg")
    both = F.col("n_pos").cast("double") * F.col("n_neg")
    var = both / 12.0 * ((n + 1) - div(F.col("_tie"), n * (n - 1)))
    return g.select(*groups, "n_pos", "n_neg", "u", var.alias("u_var"), div(F.col("u"), both).alias("auc"))


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value. Spark has no error function, so this is an Arrow UDF over a result table."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else erfc(abs(v) / sqrt(2)))

    return F.pandas_udf(run, "double")(z)


def mann_whitney(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """U, z with continuity correction, and two-sided p."""
    a = auc(df, groups, score, label)
    mid = F.col("n_pos").cast("double") * F.col("n_neg") / 2.0
    z = div(F.greatest(F.abs(F.col("u") - mid) - 0.5, F.lit(0.0)), F.sqrt("u_var"))
    return a.select(*groups, "n_pos", "n_neg", "u", z.alias("z"), two_sided(z).alias("p_value"))


def roc(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Points of the curve at each distinct score from the top: counts at or above it."""
    c = score_counts(df, groups, score, label)
    c = running_sums(c, groups, [F.col("score").desc()], ["pos", "neg"], totals=True)
    whole = lambda x: F.col(x).cast("long")
    return c.select(
        *groups, "score", whole("pos_upto").alias("tp"), whole("neg_upto").alias("fp"),
        whole("pos_all").alias("n_pos"), whole("neg_all").alias("n_neg"),
    )


def tpr_at_fpr(df: DataFrame, groups: list[str], score: str, label: str, targets: tuple[float, ...] = (0.0001, 0.001, 0.01, 0.05, 0.1)) -> DataFrame:
    """At each target the first point of the curve whose false-positive rate exceeds it."""
    points = roc(df, groups, score, label).filter("n_pos > 0 and n_neg > 0").select(*groups, "score", (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("fp") / F.col("n_neg")).alias("fpr"))
    each = points.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).filter("fpr > target")
    return each.groupBy(*groups, "target").agg(F.max_by(F.struct("tpr", "score"), "score").alias("p")).select(*groups, "target", F.col("p.tpr").alias("tpr"), F.col("p.score").alias("threshold"))


def exact_fpr_threshold(df: DataFrame, group: str, score: str, label: str, rate: float = 0.001) -> DataFrame:
    """The k-th largest human score, k the whole part of rate times humans (1.0 for k = 0), and the share of positives above it."""
    p = roc(df, [group], score, label).withColumn("_k", F.floor(F.col("n_neg") * F.lit(rate)))
    cut = p.groupBy(group, "n_pos", "n_neg", "_k").agg(F.max(F.when(F.col("fp") >= F.col("_k"), F.col("score"))).alias("_at")).select(group, "n_pos", "n_neg", F.when(F.col("_k") == 0, 1.0).otherwise(F.col("_at")).alias("threshold"))
    hits = df.filter(F.col(label) == 1).join(F.broadcast(cut.select(group, "threshold")), group).groupBy(group).agg(F.count(F.when(F.col(score) > F.col("threshold"), 1)).alias("_tp"))
    return cut.join(hits, group, "left").select(group, "threshold", F.lit(rate).alias("target_fpr"), div(F.coalesce("_tp", F.lit(0)), F.col("n_pos")).alias("tpr"), F.col("n_neg").alias("n_human"), F.col("n_pos").alias("n_ai"))


def detection_rates(
    df: DataFrame, attack: str, score: str, label: str, clean: str = "none", recall: float = 0.9
) -> DataFrame:
    """(attack, n, threshold, detection_rate): the share of machine texts of each attack at or above the threshold whose
    recall on clean texts is nearest to the wanted one (0.5 where there are no clean machine texts)."""
    on_clean = precision_at_recall(df.filter(F.col(attack) == clean), [], score, label, (recall,))
    found = on_clean.select("score").first()
    threshold = float(found[0]) if found else 0.5
    rows = df.filter((F.col(label) == 1) & F.col(score).isNotNull())
    hit = (F.col(score) >= threshold).cast("double")
    rates = rows.groupBy(attack).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("detection_rate"))
    return rates.select(attack, "n", F.lit(threshold).alias("threshold"), "detection_rate")


def confusion(df: DataFrame, groups: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Counts and rates of a threshold: accuracy, precision, recall, F1 (0 for a zero divisor), error rates and the accuracy of always naming the commoner label."""
    hit = F.col(score) >= threshold
    y = F.col(label)
    n = lambda c: F.count(F.when(c, 1))
    g = df.filter(F.col(score).isNotNull() & y.isin(0, 1)).groupBy(*groups).agg(n(hit & (y == 1)).alias("tp"), n(hit & (y == 0)).alias("fp"), n(~hit & (y == 1)).alias("fn"), n(~hit & (y == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select(*groups, "tp", "fp", "fn", "tn", div(tp + tn, total).alias("accuracy"), zero(div(tp, tp + fp)).alias("precision"), zero(div(tp, tp + fn)).alias("recall"), zero(div(2 * tp, 2 * tp + fp + fn)).alias("f1"), div(fp, fp + tn).alias("fp_rate"), div(fn, fn + tp).alias("fn_rate"), div(F.greatest(tp + fn, fp + tn), total).alias("baseline_accuracy"))


def precision_at_recall(df: DataFrame, groups: list[str], score: str, label: str, targets: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    """The point of the precision-recall curve with recall nearest to each target; of equals the one with the higher threshold."""
    p = roc(df, groups, score, label).filter("n_pos > 0").select(*groups, "score", (F.col("tp") / F.col("n_pos")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), "tp", "fp", "n_pos", "n_neg")
    each = p.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    best = each.groupBy(*groups, "target").agg(F.min_by(F.struct("score", "recall", "precision", "tp", "fp", "n_pos", "n_neg"), F.struct(F.round(F.abs(F.col("recall") - F.col("target")), 12), -F.col("score"))).alias("p"))
    return best.select(*groups, "target", *[F.col(f"p.{c}").alias(c) for c in ("score", "recall", "precision", "tp", "fp", "n_pos", "n_neg")])


def at_deployment(df: DataFrame, groups: list[str], score: str, label: str, ratios: tuple[int, ...] = (1, 10, 100, 1000)) -> DataFrame:
    """Precision and F1 at the 90 % recall threshold, were positives one in ratio + 1."""
    p = precision_at_recall(df, groups, score, label, (0.9,)).withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    share = 1.0 / (F.col("ratio") + 1)
    fpr = div(F.col("fp"), F.col("n_neg"))
    precision = div(F.col("recall") * share, F.col("recall") * share + fpr * (1 - share))
    return p.select(*groups, "ratio", share.alias("ai_fraction"), F.col("score").alias("threshold"), precision.alias("deployment_precision"), div(2 * precision * F.col("recall"), precision + F.col("recall")).alias("deployment_f1"))


def calibration(df: DataFrame, groups: list[str], probability: str, label: str, bins: int = 10) -> DataFrame:
    """Rows, mean probability and share of positives in equal bins of the probability; empty bins are absent."""
    p = F.col(probability)
    rows = df.filter(p.isNotNull() & F.col(label).isin(0, 1)).withColumn("bin", F.least(F.floor(p * bins), F.lit(bins - 1)))
    return rows.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_pred_prob"), F.avg(F.col(label).cast("double")).alias("frac_positive"))


def probability_losses(df: DataFrame, groups: list[str], probability: str, label: str, bins: int = 10, clip: float = 1e-6) -> DataFrame:
    """Brier score, log loss with clipped probabilities, and expected calibration error over right-closed bins."""
    p, y = F.col(probability), F.col(label).cast("double")
    rows = df.filter(p.isNotNull() & F.col(label).isin(0, 1))
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    binned = rows.withColumn("bin", F.greatest(F.ceil(p * bins), F.lit(1)))
    b = binned.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"), F.sum((p - y) * (p - y)).alias("_b"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("_l"))
    return b.groupBy(*groups).agg(F.sum("_n").alias("rows"), (F.sum("_b") / F.sum("_n")).alias("brier"), (F.sum("_l") / F.sum("_n")).alias("log_loss"), (F.sum(F.abs(F.col("_p") - F.col("_y")) * F.col("_n")) / F.sum("_n")).alias("ece"))


def conformal_quantile(df: DataFrame, groups: list[str], probability: str, label: str, alpha: float = 0.1) -> DataFrame:
    """Quantile of the absolute error at min(1, (1 - alpha)(1 + 1 / n)), linearly interpolated, and the share of rows within it."""
    e = df.filter(F.col(probability).isNotNull() & F.col(label).isin(0, 1)).select(*groups, F.abs(F.col(label) - F.col(probability)).alias("_e"))
    counts = e.groupBy(*groups, "_e").agg(F.count(F.lit(1)).alias("_c"))
    c = written(running_sums(counts, groups, [F.col("_e")], ["_c"], totals=True))
    n = F.col("_c_all")
    at = (n - 1) * F.least(F.lit(1.0), (1 - alpha) * (1 + 1 / n))
    low = F.min(F.when(F.col("_c_upto") > F.floor(at), F.col("_e"))).alias("_lo")
    high = F.min(F.when(F.col("_c_upto") > F.ceil(at), F.col("_e"))).alias("_hi")
    found = c.groupBy(*groups, "_c_all").agg(low, high)
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))
    q = found.select(group_key(groups).alias("_k"), *groups, n.cast("long").alias("n"), value.alias("quantile"))
    inside = c.withColumn("_k", group_key(groups)).join(q.select("_k", "quantile"), "_k").filter(F.col("_e") <= F.col("quantile"))
    within = inside.groupBy("_k").agg(F.max("_c_upto").alias("_in"))
    return q.join(within, "_k").select(*groups, "n", "quantile", (F.col("_in") / F.col("n")).alias("coverage"))


def off_diagonal(cells: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Of a square of cells: mean off the diagonal by row, by column and over all, the diagonal's mean and the difference."""
    c = cells.withColumns({"_a": F.col(a), "_b": F.col(b)})
    off = F.avg(F.when(F.col("_a") != F.col("_b"), F.col(value)))
    on = F.avg(F.when(F.col("_a") == F.col("_b"), F.col(value)))
    g = c.groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b))
    return g.agg(off.alias("off_diagonal"), on.alias("diagonal"), (on - off).alias("cost"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """``q_value`` of each p: the smallest p * m / rank from its rank on. The table of tests is small by nature: one row a test."""
    up = W.Window.orderBy(p)
    m = F.count(F.lit(1)).over(W.Window.partitionBy())
    raw = df.withColumn("_q", F.col(p) * m / F.rank().over(up))
    return raw.withColumn("q_value", F.least(F.lit(1.0), F.min("_q").over(W.Window.orderBy(p).rangeBetween(W.Window.currentRow, W.Window.unboundedFollowing)))).drop("_q")


def z_scores(df: DataFrame, group: str, value: str) -> DataFrame:
    """Value less its group's mean over its sample deviation, from a joined aggregate instead of a window over whole groups."""
    m = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(F.broadcast(m), group).withColumn("z", div(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def paired_t(folds: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """Paired t statistic of two metrics over folds."""
    d = F.col(b) - F.col(a)
    return folds.groupBy(*groups).agg(F.count(d).alias("folds"), F.avg(d).alias("delta"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0))).alias("t"))


#: Modulus of the draws below, and the borders of a Poisson variable of mean 1.
DRAWS = 2147483647
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)


def _resampled(groups: list[str], rounds: int, seed: int):
    """Weighted sums of each batch by group and resample; the weight is a Poisson variable that depends on the id, the
    resample and the seed only, through two squarings modulo a prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_no = np.arange(rounds, dtype=np.int64)
        for b in batches:
            key = b.column("_key").dictionary_encode()
            code = key.indices.to_numpy(zero_copy_only=False)
            ids, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_v"))
            size = len(key.dictionary)
            weights, sums = np.zeros((size, rounds)), np.zeros((size, rounds))
            for a in range(0, b.num_rows, 2048):
                x = (ids[a : a + 2048, None] % DRAWS * 48271 + b_no * 40692 + seed) % DRAWS
                for _ in range(2):
                    x = (x * x + 12345) % DRAWS
                w = np.searchsorted(np.array(POISSON), x / DRAWS, "right").astype(float)
                np.add.at(weights, code[a : a + 2048], w)
                np.add.at(sums, code[a : a + 2048], w * value[a : a + 2048, None])
            yield pa.RecordBatch.from_arrays(
                [
                    key.dictionary.take(pa.array(np.repeat(np.arange(size), rounds))),
                    pa.array(np.tile(b_no, size).astype(np.int32)),
                    pa.array(weights.ravel()),
                    pa.array(sums.ravel()),
                ],
                names=["_key", "_b", "_w", "_s"],
            )

    return run


def bootstrap_mean(df: DataFrame, groups: list[str], value: str, id_col: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling, with the number of rows. Each batch sums its rows for all
    resamples at once; no row is repeated, and the draws do not depend on partitions. Ids are whole numbers from 0."""
    rows = df.select(*groups, group_key(groups).alias("_key"), F.col(id_col).cast("long").alias("_id"), F.col(value).cast("double").alias("_v"))
    rows = rows.filter("_id is not null and _v is not null")
    each = rows.select("_key", "_id", "_v").mapInArrow(_resampled(groups, rounds, seed), "_key string, _b int, _w double, _s double")
    means = each.groupBy("_key", "_b").agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_m"))
    # As many values a group as there are resamples.
    ends = means.groupBy("_key").agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    names = rows.groupBy(*groups, "_key").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    return names.join(ends, "_key").select(*groups, "n", "mean", "low", "high")
