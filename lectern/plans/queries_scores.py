"""Queries over labelled scores: ranks, operating points, calibration, routing, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import SCORES, query, scores, table
from lectern.operators import running, scoring, stats

#: Distinct scores of each register with counts, and running counts from the top.
CURVE = f"""{SCORES}, c AS (SELECT register, stylometric_score AS score, sum(label) AS pos, sum(1 - label) AS neg FROM s WHERE stylometric_score IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY register) AS n_pos, sum(neg) OVER (PARTITION BY register) AS n_neg,
      coalesce(sum(neg) OVER (PARTITION BY register ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c WINDOW d AS (PARTITION BY register ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {CURVE} SELECT register, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(sum(pos * (below + neg / 2.0)), 6)::DOUBLE AS u, round(sum(pos * (below + neg / 2.0)) / nullif(n_pos * n_neg, 0), 6)::DOUBLE AS auc FROM r GROUP BY register, n_pos, n_neg")
def a9_auc(spark, d):
    return stats.auc(scores(spark, d), ["register"], "stylometric_score", "label").drop("u_var")


@query()
def a7_mann_whitney(spark, d):
    return stats.mann_whitney(scores(spark, d), ["register"], "binoculars_score", "label")


@query(
    f"""WITH {CURVE}, t AS (SELECT register, unnest([0.0001, 0.001, 0.01, 0.05, 0.1]::DOUBLE[]) AS target, score, tp / n_pos AS tpr, fp / n_neg AS fpr FROM r WHERE n_pos > 0 AND n_neg > 0)
    SELECT register, round(target, 6)::DOUBLE AS target, round(arg_max(tpr, score), 6)::DOUBLE AS tpr, round(max(score), 6)::DOUBLE AS threshold FROM t WHERE fpr > target GROUP BY register, target"""
)
def a10_tpr_at_fpr(spark, d):
    return stats.tpr_at_fpr(scores(spark, d), ["register"], "stylometric_score", "label")


@query(
    f"""WITH {CURVE}, k AS (SELECT *, floor(n_neg * 0.01) AS k FROM r), cut AS (SELECT register, n_pos, n_neg, CASE WHEN k = 0 THEN 1.0 ELSE max(CASE WHEN fp >= k THEN score END) END AS threshold FROM k GROUP BY register, n_pos, n_neg, k),
    h AS (SELECT s.register, count(*) AS tp FROM s JOIN cut USING (register) WHERE label = 1 AND stylometric_score > threshold GROUP BY 1)
    SELECT register, round(threshold, 6)::DOUBLE AS threshold, 0.01::DOUBLE AS target_fpr, round(coalesce(tp, 0) / nullif(n_pos, 0), 6)::DOUBLE AS tpr, n_neg::BIGINT AS n_human, n_pos::BIGINT AS n_ai FROM cut LEFT JOIN h USING (register)"""
)
def a11_exact_fpr(spark, d):
    return stats.exact_fpr_threshold(scores(spark, d), "register", "stylometric_score", "label", 0.01)


@query(
    f"""WITH {SCORES}, g AS (SELECT register, count(*) FILTER (WHERE h AND label = 1) AS tp, count(*) FILTER (WHERE h AND label = 0) AS fp, count(*) FILTER (WHERE NOT h AND label = 1) AS fn, count(*) FILTER (WHERE NOT h AND label = 0) AS tn FROM (SELECT *, stylometric_score >= 0.5 AS h FROM s WHERE stylometric_score IS NOT NULL) GROUP BY 1)
    SELECT register, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn), 6)::DOUBLE AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1, round(fp / nullif(fp + tn, 0), 6)::DOUBLE AS fp_rate, round(fn / nullif(fn + tp, 0), 6)::DOUBLE AS fn_rate, round(greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 6)::DOUBLE AS baseline_accuracy FROM g"""
)
def a12_a13_confusion(spark, d):
    return stats.confusion(scores(spark, d), ["register"], "stylometric_score", "label")


PR = f"""{CURVE}, t AS (SELECT register, unnest([0.9, 0.95]::DOUBLE[]) AS target, score, tp, fp, n_pos, n_neg, tp / n_pos AS recall, tp / (tp + fp) AS precision FROM r WHERE n_pos > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY register, target ORDER BY round(abs(recall - target), 12), score DESC) AS k FROM t)"""


@query(f"WITH {PR} SELECT register, round(target, 6)::DOUBLE AS target, round(score, 6)::DOUBLE AS score, round(recall, 6)::DOUBLE AS recall, round(precision, 6)::DOUBLE AS precision FROM b WHERE k = 1")
def a14_precision_at_recall(spark, d):
    return stats.precision_at_recall(scores(spark, d), ["register"], "stylometric_score", "label").select("register", "target", "score", "recall", "precision")


@query(
    f"""WITH {PR}, x AS (SELECT register, unnest([1, 10, 100, 1000]) AS ratio, recall, fp / nullif(n_neg, 0) AS fpr FROM b WHERE k = 1 AND target = 0.9), y AS (SELECT *, 1.0 / (ratio + 1) AS f, recall * (1.0 / (ratio + 1)) / nullif(recall * (1.0 / (ratio + 1)) + fpr * (1 - 1.0 / (ratio + 1)), 0) AS p FROM x)
    SELECT register, ratio::BIGINT AS ratio, round(f, 6)::DOUBLE AS ai_fraction, round(p, 6)::DOUBLE AS deployment_precision, round(2 * p * recall / nullif(p + recall, 0), 6)::DOUBLE AS deployment_f1 FROM y"""
)
def a15_at_deployment(spark, d):
    return stats.at_deployment(scores(spark, d), ["register"], "stylometric_score", "label").drop("threshold")


@query(f"WITH {SCORES} SELECT register, least(floor(stylometric_score * 10), 9)::BIGINT AS bin, count(*)::BIGINT AS rows, round(avg(stylometric_score), 6)::DOUBLE AS mean_pred_prob, round(avg(label), 6)::DOUBLE AS frac_positive FROM s WHERE stylometric_score IS NOT NULL GROUP BY 1, 2")
def a17_calibration(spark, d):
    return stats.calibration(scores(spark, d), ["register"], "stylometric_score", "label")


@query(
    f"""WITH {SCORES}, b AS (SELECT register, greatest(ceil(stylometric_score * 10), 1) AS bin, count(*) AS n, avg(stylometric_score) AS p, avg(label) AS y, sum((stylometric_score - label) ** 2) AS b,
      sum(-(label * ln(least(greatest(stylometric_score, 1e-6), 1 - 1e-6)) + (1 - label) * ln(1 - least(greatest(stylometric_score, 1e-6), 1 - 1e-6)))) AS l FROM s WHERE stylometric_score IS NOT NULL GROUP BY 1, 2)
    SELECT register, sum(n)::BIGINT AS rows, round(sum(b) / sum(n), 6)::DOUBLE AS brier, round(sum(l) / sum(n), 6)::DOUBLE AS log_loss, round(sum(abs(p - y) * n) / sum(n), 6)::DOUBLE AS ece FROM b GROUP BY 1"""
)
def a18_a19_losses(spark, d):
    return stats.probability_losses(scores(spark, d), ["register"], "stylometric_score", "label")


@query(
    f"""WITH {SCORES}, e AS (SELECT register, abs(label - stylometric_score) AS e FROM s WHERE stylometric_score IS NOT NULL), o AS (SELECT register, list_sort(list(e)) AS v, count(*) AS n FROM e GROUP BY 1),
    a AS (SELECT *, (n - 1) * least(1.0, 0.9::DOUBLE * (1 + 1 / n)) AS pos FROM o), q AS (SELECT register, n, v, list_extract(v, CAST(floor(pos) AS BIGINT) + 1) + (list_extract(v, CAST(ceil(pos) AS BIGINT) + 1) - list_extract(v, CAST(floor(pos) AS BIGINT) + 1)) * (pos - floor(pos)) AS quantile FROM a)
    SELECT register, n::BIGINT AS n, round(quantile, 6)::DOUBLE AS quantile, round(len(list_filter(v, lambda x: x <= quantile)) / n, 6)::DOUBLE AS coverage FROM q"""
)
def a31_conformal(spark, d):
    return stats.conformal_quantile(scores(spark, d), ["register"], "stylometric_score", "label")


@query(f"WITH {SCORES} SELECT register, label::BIGINT AS label, count(stylometric_score)::BIGINT AS n, round(avg(stylometric_score), 6)::DOUBLE AS mean, round(median(stylometric_score), 6)::DOUBLE AS median, round(min(stylometric_score), 6)::DOUBLE AS least, round(max(stylometric_score), 6)::DOUBLE AS most FROM s GROUP BY ALL")
def a4_described(spark, d):
    c = "stylometric_score"
    s = scores(spark, d)
    median = running.quantiles(s, ["register", "label"], c, [0.5]).select("register", "label", F.get("values", 0).alias("median"))
    figures = F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most")
    return s.groupBy("register", "label").agg(*figures).join(median, ["register", "label"], "left")


@query(f"WITH {SCORES}, m AS (SELECT register, avg(binoculars_score) AS m, stddev_samp(binoculars_score) AS d FROM s GROUP BY 1) SELECT row_id, round((binoculars_score - m) / nullif(d, 0), 6)::DOUBLE AS z FROM s JOIN m USING (register)")
def a35_z_scores(spark, d):
    return stats.z_scores(scores(spark, d), "register", "binoculars_score").select("row_id", "z")


@query(
    """WITH t AS (SELECT register, feature, mwu_pval AS p FROM effect_sizes WHERE mwu_pval IS NOT NULL), r AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS q FROM t)
    SELECT register, feature, round(least(1.0, min(q) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS q_value FROM r"""
)
def a35_benjamini_hochberg(spark, d):
    return stats.benjamini_hochberg(table(spark, d, "effect_sizes", "register", "feature", F.col("mwu_pval").alias("p")).filter("p is not null"), "p").select("register", "feature", "q_value")


CELLS = f"""{SCORES}, both_ AS (SELECT a.register AS train, b.register AS test, b.label, b.stylometric_score - a.mid AS v FROM (SELECT register, median(stylometric_score) AS mid FROM s GROUP BY 1) a, s b WHERE b.stylometric_score IS NOT NULL),
    cells AS (SELECT train, test, avg(CASE WHEN (v >= 0) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM both_ GROUP BY 1, 2)"""


def threshold_cells(spark, d):
    """Accuracy on each register of a threshold at each register's median score. The left side has one row a register."""
    s = scores(spark, d)
    mids = running.quantiles(s, ["register"], "stylometric_score", [0.5])
    mids = mids.select(F.col("register").alias("train"), F.get("values", 0).alias("mid"))
    # One row a register on the left: every score is tried against each.
    rows = s.filter("stylometric_score is not null").withColumnRenamed("register", "test").crossJoin(F.broadcast(mids))
    right = (F.col("stylometric_score") - F.col("mid") >= 0) == (F.col("label") == 1)
    return rows.groupBy("train", "test").agg(F.avg(right.cast("double")).alias("accuracy"))


@query(f"WITH {CELLS} SELECT train, test, round(avg(CASE WHEN train <> test THEN accuracy END), 6)::DOUBLE AS off_diagonal, round(avg(CASE WHEN train = test THEN accuracy END), 6)::DOUBLE AS diagonal FROM (SELECT train AS t1, test AS t2, * FROM cells) GROUP BY GROUPING SETS ((train), (test), ())")
def a24_off_diagonal(spark, d):
    return stats.off_diagonal(threshold_cells(spark, d), "train", "test", "accuracy").drop("cost")


@query("SELECT feature, round(max(cohens_d) FILTER (WHERE register = 'academic'), 6)::DOUBLE AS academic, round(max(cohens_d) FILTER (WHERE register = 'news'), 6)::DOUBLE AS news, round(max(cohens_d) FILTER (WHERE register = 'social'), 6)::DOUBLE AS social, round(max(cohens_d) FILTER (WHERE register = 'creative'), 6)::DOUBLE AS creative, round(avg(abs(cohens_d)), 6)::DOUBLE AS mean_abs FROM effect_sizes GROUP BY 1")
def a23_a25_effects_pivot(spark, d):
    e = table(spark, d, "effect_sizes", "register", "feature", "cohens_d")
    wide = e.groupBy("feature").pivot("register", ["academic", "news", "social", "creative"]).agg(F.max("cohens_d"))
    return wide.join(e.groupBy("feature").agg(F.avg(F.abs("cohens_d")).alias("mean_abs")), "feature")


@query("SELECT register, feature, place::BIGINT AS place FROM (SELECT register, feature, row_number() OVER (PARTITION BY register ORDER BY abs(cohens_d) DESC, feature) AS place FROM effect_sizes) WHERE place <= 6")
def o2_top_features(spark, d):
    from pyspark.sql import window as W

    e = table(spark, d, "effect_sizes", "register", "feature", "cohens_d")
    return e.withColumn("place", F.row_number().over(W.Window.partitionBy("register").orderBy(F.abs("cohens_d").desc(), "feature"))).filter("place <= 6").select("register", "feature", "place")


@query(
    f"""WITH {SCORES}, l AS (SELECT row_id, CASE WHEN stylometric_score <= 0.15 OR stylometric_score >= 0.85 OR stylometric_score IS NULL THEN stylometric_score ELSE coalesce(1 / (1 + exp(-binoculars_score_neg)), stylometric_score) END AS probability,
    CASE WHEN stylometric_score <= 0.15 OR stylometric_score >= 0.85 OR stylometric_score IS NULL OR binoculars_score_neg IS NULL THEN 'level_1' ELSE 'level_2' END AS level FROM s) SELECT row_id, round(probability, 6)::DOUBLE AS probability, level FROM l"""
)
def m3_cascade(spark, d):
    second = lambda df: df.withColumn("second", 1 / (1 + F.exp(-F.col("binoculars_score_neg"))))
    return scoring.cascade(scores(spark, d), "stylometric_score", second).select("row_id", "probability", "level")


@query(
    """WITH r AS (SELECT request_id, received_at, sensitivity, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS n FROM detect_request WHERE text IS NOT NULL),
    p AS (SELECT *, CASE sensitivity WHEN 'high' THEN 0.35 WHEN 'low' THEN 0.70 ELSE 0.50 END AS threshold, (n % 21) / 20.0 AS raw FROM r),
    a AS (SELECT *, CASE WHEN n < 15 THEN 0.5 + (raw - 0.5) * (n / 15.0) ** 2 ELSE raw END AS s FROM p), c AS (SELECT *, CASE WHEN n < 50 THEN 0.5 + (s - 0.5) / (1 + exp(-0.08 * (n - 25))) ELSE s END AS p FROM a)
    SELECT request_id, received_at, round(threshold, 6)::DOUBLE AS threshold, round(p, 6)::DOUBLE AS p, p >= threshold AS is_ai, CASE WHEN p >= 0.7 THEN 'ai' WHEN p >= 0.35 THEN 'mixed' ELSE 'human' END AS verdict,
      round(greatest(0.0, p - (0.05 + 0.2 * (1 - 2 * abs(p - 0.5)))), 6)::DOUBLE AS lower, round(least(1.0, p + (0.05 + 0.2 * (1 - 2 * abs(p - 0.5)))), 6)::DOUBLE AS upper FROM c"""
)
def m6_m12_damped_requests(spark, d):
    r = table(spark, d, "detect_request", "request_id", "received_at", "sensitivity", "text").filter("text is not null")
    r = r.withColumn("n", F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))).withColumn("p", scoring.damped((F.col("n") % 21) / 20.0, F.col("n"))).withColumn("threshold", scoring.threshold_of(F.col("sensitivity")))
    i = scoring.interval(F.col("p"))
    return r.select("request_id", "received_at", "threshold", "p", (F.col("p") >= F.col("threshold")).alias("is_ai"), scoring.verdict(F.col("p")).alias("verdict"), i["lower"].alias("lower"), i["upper"].alias("upper"))


@query(f"WITH {SCORES}, r AS (SELECT min(stylometric_score) AS a0, max(stylometric_score) AS a1, min(binoculars_score_neg) AS b0, max(binoculars_score_neg) AS b1 FROM s) SELECT row_id, round(((stylometric_score - a0) / nullif(a1 - a0, 0) + (binoculars_score_neg - b0) / nullif(b1 - b0, 0)) / 2, 6)::DOUBLE AS fused FROM s, r")
def m17_fused(spark, d):
    return scoring.fused_min_max(scores(spark, d), ["stylometric_score", "binoculars_score_neg"]).select("row_id", "fused")


@query(f"WITH {SCORES} SELECT row_id, round((0.7 * coalesce(stylometric_score, 0.5) + 0.3 * coalesce(binoculars_score, 0.5)) / 1.0, 6)::DOUBLE AS soft, round(CASE register WHEN 'news' THEN binoculars_score WHEN 'social' THEN binoculars_score_neg ELSE stylometric_score END, 6)::DOUBLE AS hard FROM s")
def m16_routed(spark, d):
    c = F.col
    soft = scoring.soft_routed([F.lit(0.7), F.lit(0.3)], [c("stylometric_score"), c("binoculars_score")])
    hard = scoring.routed(c("register"), {"news": c("binoculars_score"), "social": c("binoculars_score_neg")}, c("stylometric_score"))
    return scores(spark, d).select("row_id", soft.alias("soft"), hard.alias("hard"))


@query(f"WITH {SCORES}, t AS (SELECT row_id, stylometric_score AS p, stylometric_score AS p_m, 1 - stylometric_score AS p_h, 0.5::DOUBLE AS p_o FROM s WHERE stylometric_score IS NOT NULL) SELECT row_id, CASE WHEN p < 0.25 THEN 'human' WHEN p_h >= p_m AND p_h >= p_o THEN CASE WHEN p > 0.6 THEN CASE WHEN p_m >= p_o THEN 'machine' ELSE 'other' END ELSE 'human' END WHEN p_m >= p_o THEN 'machine' ELSE 'other' END AS source FROM t")
def m11_attributed(spark, d):
    p = F.col("stylometric_score")
    return scores(spark, d).filter("stylometric_score is not null").select("row_id", scoring.attributed(p, {"human": 1 - p, "machine": p, "other": F.lit(0.5)}).alias("source"))


def _bootstrap_sql(rounds: int = 200, seed: int = 42) -> str:
    m = stats.DRAWS
    weight = " ".join(f"WHEN u < {border!r} THEN {k}" for k, border in enumerate(stats.POISSON))
    return f"""WITH {SCORES}, d AS (SELECT register, label, stylometric_score AS v, row_id, unnest(range({rounds})) AS b FROM s WHERE stylometric_score IS NOT NULL),
    x0 AS (SELECT register, label, v, b, (row_id % {m} * 48271 + b * 40692 + {seed}) % {m} AS x FROM d),
    x1 AS (SELECT * REPLACE ((x * x + 12345) % {m} AS x) FROM x0), x2 AS (SELECT * REPLACE ((x * x + 12345) % {m} AS x) FROM x1),
    w AS (SELECT *, CASE {weight} ELSE {len(stats.POISSON)} END AS w FROM (SELECT *, x / {m} AS u FROM x2)),
    means AS (SELECT register, label, b, sum(w * v) / nullif(sum(w), 0) AS mean FROM w GROUP BY ALL),
    ends AS (SELECT register, label, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means GROUP BY ALL)
    SELECT register, label::BIGINT AS label, count(*)::BIGINT AS n, round(avg(stylometric_score), 6)::DOUBLE AS mean,
      round(any_value(low), 6)::DOUBLE AS low, round(any_value(high), 6)::DOUBLE AS high
    FROM s JOIN ends USING (register, label) WHERE stylometric_score IS NOT NULL GROUP BY ALL"""


@query(_bootstrap_sql())
def a8_bootstrap(spark, d):
    """Mean score and its bootstrap interval over 200 resamples."""
    return stats.bootstrap_mean(scores(spark, d), ["register", "label"], "stylometric_score", "row_id")


TIES = f"""{CURVE}, u AS (SELECT register, n_pos, n_neg, sum(pos * (below + neg / 2.0)) AS u, sum(((pos + neg)::DOUBLE) ** 3 - (pos + neg)) AS ties FROM r GROUP BY ALL)"""


@query(
    f"""WITH {TIES}, v AS (SELECT *, n_pos + n_neg AS n, n_pos::DOUBLE * n_neg AS both_ FROM u),
    z AS (SELECT *, sqrt(both_ / 12 * ((n + 1) - ties / nullif(n * (n - 1), 0))) AS sd FROM v)
    SELECT register, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(u, 6)::DOUBLE AS u,
      round(greatest(abs(u - both_ / 2) - 0.5, 0) / nullif(sd, 0), 6)::DOUBLE AS z FROM z"""
)
def a7_rank_sums(spark, d):
    """Mann-Whitney U and z with tie and continuity correction; the p-value is in a7_mann_whitney."""
    return stats.mann_whitney(scores(spark, d), ["register"], "stylometric_score", "label").drop("p_value")


@query(f"WITH {SCORES}, m AS (SELECT avg(stylometric_score) + 2 * stddev_samp(stylometric_score) AS high FROM s WHERE label = 0) SELECT row_id FROM s, m WHERE stylometric_score > high")
def f15_outliers(spark, d):
    s = scores(spark, d)
    high = s.filter("label = 0").agg((F.avg("stylometric_score") + 2 * F.stddev_samp("stylometric_score")).alias("high"))
    return s.join(F.broadcast(high)).filter("stylometric_score > high").select("row_id")


@query(
    f"""WITH {SCORES}, h AS (SELECT stylometric_score AS v FROM s WHERE label = 0 AND stylometric_score IS NOT NULL), a AS (SELECT register, stylometric_score AS v FROM s WHERE label = 1 AND stylometric_score IS NOT NULL),
    u AS (SELECT register, 1 AS y, v FROM a UNION ALL SELECT g.register, 0, h.v FROM (SELECT DISTINCT register FROM a) g, h), k AS (SELECT register, y, rank() OVER (PARTITION BY register ORDER BY v) + (count(*) OVER (PARTITION BY register, v) - 1) / 2.0 AS r FROM u)
    SELECT register, count(*) FILTER (WHERE y = 1)::BIGINT AS n_ai, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6)::DOUBLE AS auc FROM k GROUP BY 1"""
)
def j8_group_against_all_humans(spark, d):
    """AUC of each register's AI rows against all humans. Humans are counted by score once and only those counts are repeated by register."""
    s = scores(spark, d).filter("stylometric_score is not null")
    human = s.filter("label = 0").groupBy(F.col("stylometric_score").alias("score")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(0))
    ai = s.filter("label = 1").groupBy("register", F.col("stylometric_score").alias("score")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(1))
    names = F.broadcast(ai.select("register").distinct())
    c = ai.unionByName(human.crossJoin(names).select("register", "score", "n", "label")).groupBy("register", "score").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))
    c = running.running_sums(c, ["register"], [F.col("score")], ["neg"])
    u = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)
    g = c.groupBy("register").agg(F.sum("pos").alias("n_ai"), F.sum("neg").alias("n_human"), F.sum(u).alias("u"))
    return g.select("register", "n_ai", (F.col("u") / (F.col("n_ai") * F.col("n_human"))).alias("auc"))


@query("SELECT example_id, error_type, e.register, length(text)::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(register)), error_type ORDER BY score DESC NULLS LAST, example_id, run_at) AS k FROM error_examples) e WHERE k <= 3")
def r6_worst_errors(spark, d):
    from pyspark.sql import window as W

    e = table(spark, d, "error_examples", "example_id", "register", "error_type", "score", "text", "run_at")
    w = W.Window.partitionBy(F.lower(F.trim("register")), "error_type").orderBy(F.col("score").desc_nulls_last(), "example_id", "run_at")
    return e.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("example_id", "error_type", "register", F.length("text").alias("n_chars"))
