"""Queries over event and request streams, sources, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import documents, query, scores, table
from lectern.functions import text as X
from lectern.operators import sampling, stats, training
from lectern.plans.stage import written
from lectern.sources import readers
from lectern.streaming import stateful


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    f AS (SELECT key, event_id, sec, k, 60.0::DOUBLE AS tokens, true AS allowed FROM e WHERE k = 1 UNION ALL SELECT e.key, e.event_id, e.sec, e.k, least(60.0, f.tokens + greatest(0.0, e.sec - f.sec)) - CASE WHEN least(60.0, f.tokens + greatest(0.0, e.sec - f.sec)) >= 1 THEN 1 ELSE 0 END, least(60.0, f.tokens + greatest(0.0, e.sec - f.sec)) >= 1 FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)
    SELECT key::BIGINT AS key, event_id::BIGINT AS event_id, round(tokens, 6)::DOUBLE AS tokens, allowed FROM f"""
)
def z4_rate_limit(spark, d):
    return stateful.limited(table(spark, d, "events", "user_id", "event_id", "ts"), "user_id", "event_id", "ts").drop("at")


@query(
    """WITH RECURSIVE e AS (SELECT md5(coalesce(text, '') || '||' || coalesce(register, '')) AS key, request_id AS event_id,
      epoch_us(received_at) / 1e6 AS sec FROM detect_request WHERE received_at IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec, event_id) AS k FROM e),
    f AS (SELECT key, event_id, sec, k, sec AS stored, false AS hit FROM k WHERE k = 1
      UNION ALL SELECT k.key, k.event_id, k.sec, k.k, CASE WHEN k.sec - f.stored <= 3600 THEN f.stored ELSE k.sec END, k.sec - f.stored <= 3600
      FROM f JOIN k ON k.key = f.key AND k.k = f.k + 1)
    SELECT event_id::BIGINT AS event_id, key, hit FROM f"""
)
def z3_cache_hits(spark, d):
    requests = table(spark, d, "detect_request", "request_id", "text", "register", "received_at")
    return stateful.cache_hits(requests, "request_id", "text", "register", "received_at").drop("at")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def z_windowed_counts(spark, d):
    w = stateful.windowed_counts(table(spark, d, "events", "ts", "event_type", "value"), "ts", "event_type")
    return w.withColumn("total", F.round("total", 4))


@query("SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS field, count(*)::BIGINT AS n FROM events GROUP BY 1")
def s12_json_field(spark, d):
    return readers.json_field(table(spark, d, "events", "props"), "props", "$.k").groupBy(F.col("field").cast("bigint").alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(model, 'human_source') AS model, count(*)::BIGINT AS n FROM corpus_raw GROUP BY 1")
def s3_shards(spark, d):
    return readers.shards(spark, [f"{d}/corpus_raw.parquet", f"{d}/no_such_shard.parquet"], {"model": "human_source", "label": 0}).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM (SELECT event_type FROM events EXCEPT SELECT register FROM effect_sizes)")
def o10_except(spark, d):
    a = table(spark, d, "events", "event_type")
    return a.subtract(table(spark, d, "effect_sizes", "register")).agg(F.count(F.lit(1)).alias("n"))


def halves(spark, d, df, label="label", id_col="row_id"):
    """Rows to fit on, and held-out ones."""
    rows = written(sampling.split(df, [label], id_col, 0.3))
    return rows.filter("not is_test"), rows.filter("is_test")


@query()
def m18_stacked(spark, d):
    """Stacked probability of held-out rows."""
    train, test = halves(spark, d, scores(spark, d).dropna())
    model = training.classifier("lr", ["stylometric_score", "binoculars_score_neg"]).fit(train)
    return training.probabilities(model, test).select("row_id", "label", "p")


SIGNALS = ["stylometric_score", "binoculars_score", "binoculars_score_neg"]


@query()
def m19_forest_cv(spark, d):
    """Forests of 100 trees over three folds."""
    held = training.cross_validated(written(scores(spark, d).dropna()), "rf", SIGNALS, "row_id", k=3)
    return training.fold_metrics(held.withColumn("model", F.lit("rf")), ["model"])


@query()
def m25_cross_domain(spark, d):
    """AUC of a model of each register on each other: on all scores together, and of each score by itself, which needs
    no model."""
    s = written(scores(spark, d).dropna())
    out = training.cross_domain(s, "register", SIGNALS).withColumn("features", F.lit("all"))
    for c in SIGNALS:
        own = stats.auc(s, ["register"], c, "label").select(F.lit(None).cast("string").alias("train"), F.col("register").alias("test"), "auc")
        out = out.unionByName(own.withColumn("features", F.lit(c)))
    return out


@query()
def m29_embedding_probe(spark, d):
    """Predicted labels of held-out embeddings."""
    train, test = halves(spark, d, table(spark, d, "embeddings", "vec_id", "embedding", "label"), id_col="vec_id")
    return training.embedding_probe(train, test=test).select("vec_id", "label", "prediction")


@query()
def m27_text_classifier(spark, d):
    """Predictions and calibrated probabilities of every labelled document by a text classifier fitted on the other folds."""
    docs = documents(spark, d, "label").filter("label in (0, 1)").select("doc_id", "label", X.words("text").alias("words"))
    held = written(training.text_cross_validated(docs, "doc_id").select("doc_id", "label", "fold", "prediction", "margin"))
    return training.calibrated_margins(held, "margin", "label").select("doc_id", "label", "fold", "prediction", "p")
