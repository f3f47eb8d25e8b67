"""Queries of assembled pipelines, packing, calibration and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import documents, query, scores, spread, table
from lectern.functions import features as FX
from lectern.functions import text as X
from lectern.functions.unicode import nfkc
from lectern.operators import packing, perturb, sampling, stats, training, windows
from lectern.plans import detect
from lectern.plans.stage import written
from lectern.plans.queries_text import DOCS, STYLE, sentences_sql, space_words_sql


def _packed_sql(least: int = 150) -> str:
    """A fold over each source's sentences in order: documents done, sentences held, words held."""
    words = f"len({space_words_sql('t')})"
    start = "{'done': []::VARCHAR[], 'held': ''::VARCHAR, 'n': 0::BIGINT}"
    return f"""WITH s AS (SELECT doc_id, source, unnest(range(len(s))) AS idx, unnest(s) AS t FROM (SELECT doc_id, source, {sentences_sql('text')} AS s FROM {DOCS})),
    w AS (SELECT source, doc_id, idx, t, {words}::BIGINT AS w FROM s WHERE t <> ''),
    g AS (SELECT source, list({{'t': t, 'w': w}} ORDER BY doc_id, idx) AS x FROM w GROUP BY 1),
    r AS (SELECT source, list_reduce(list_transform(x, lambda e: {{'done': []::VARCHAR[], 'held': e.t, 'n': e.w}}), lambda a, e: CASE WHEN a.n + e.n >= {least}
      THEN {{'done': list_append(a.done, trim(CASE WHEN a.held = '' THEN e.held ELSE a.held || ' ' || e.held END)), 'held': ''::VARCHAR, 'n': 0::BIGINT}}
      ELSE {{'done': a.done, 'held': CASE WHEN a.held = '' THEN e.held ELSE a.held || ' ' || e.held END, 'n': a.n + e.n}} END, {start}) AS r FROM g)
    SELECT source AS "group", (unnest(range(len(r.done))))::BIGINT AS part, unnest(r.done) AS text FROM r"""


@query(_packed_sql())
def t15_packed(spark, d):
    """Sentences of a source, in the order of documents, joined until a text has 150 words."""
    s = windows.sentence_rows(documents(spark, d, "source"), "doc_id", keep=["source"])
    return packing.packed(s, "source", ["doc_id", "idx"], "sentence")


@query()
def t18_plain_look_alikes(spark, d):
    return table(spark, d, "detect_request", "request_id", "received_at", "text").select("request_id", "received_at", X.plain_look_alikes(nfkc("text")).alias("plain"))


@query()
def detect_requests(spark, d):
    """The batch detection of every request."""
    r = table(spark, d, "detect_request", "request_id", "text", "register", "sensitivity")
    return detect.detected(spread(r), "request_id", sensitivity_col="sensitivity")


@query()
def detect_spans(spark, d):
    """Sentence scores of every document."""
    return detect.detected_spans(documents(spark, d), "doc_id")


@query()
def h7_auc_by_strategy(spark, d):
    """AUC of a fixed score of labelled documents as they are and after each rewrite of the AI ones, and all in turn, with the difference."""
    docs = documents(spark, d, "label").filter("label in (0, 1)")
    names = ["clean", *perturb.STRATEGIES, "combined"]
    # No rewrite touches the human documents: they are scored once and count under each strategy.
    out = docs.filter("label = 0").select("label", F.lit(None).cast("string").alias("strategy"), "text")
    for name in names:
        text = F.col("text") if name == "clean" else perturb.humanized("text", name)
        out = out.unionAll(docs.filter("label = 1").select("label", F.lit(name).alias("strategy"), text.alias("text")))
    # Written first: a rewrite would else be worked out again for every feature that reads its text.
    rewritten = spread(written(out))
    each = F.explode(F.when(F.col("strategy").isNull(), F.array(*map(F.lit, names))).otherwise(F.array("strategy")))
    # A filter on the score must not be pushed below the features, where they would be worked out twice.
    scored = written(detect.default_scorer(FX.native(rewritten)).select("label", "p", "strategy")).withColumn("strategy", each)
    a = written(stats.auc(scored, ["strategy"], "p", "label").select("strategy", "auc", "n_pos", "n_neg"))
    clean = a.filter("strategy = 'clean'").select(F.col("auc").alias("clean_auc"), F.lit(1).alias("one"))
    return a.withColumn("one", F.lit(1)).join(clean, "one").select("strategy", "auc", (F.col("auc") - F.col("clean_auc")).alias("auc_delta"), "n_pos", "n_neg")


@query()
def m7_calibrated(spark, d):
    """Brier score, log loss and calibration error of raw, Platt and isotonic probabilities on a held-out 30 % of either label, fitted on the rest. Rows without a text have no word count and take no part, in all three alike."""
    words = table(spark, d, "corpus_raw", "row_id", "text").select("row_id", F.size(X.space_words("text")).cast("double").alias("n_words")).filter("n_words >= 0")
    # Written first: the fits would else count the words of every text at each pass.
    s = written(sampling.split(scores(spark, d).dropna().withColumnRenamed("stylometric_score", "p").join(words, "row_id"), ["label"], "row_id", 0.3))
    train, test = s.filter("not is_test"), s.filter("is_test")
    platt = training.platt(train, "p", "n_words").transform(test.withColumn("_pn", F.col("p") * F.col("n_words")))
    from pyspark.ml.functions import vector_to_array

    both = training.isotonic(train, "p").transform(platt.select("label", "p", vector_to_array("probability")[1].alias("platt")).withColumn("label", F.col("label").cast("double"))).withColumnRenamed("prediction", "isotonic")
    long = both.unpivot(["label"], ["p", "platt", "isotonic"], "kind", "value")
    losses = written(stats.probability_losses(long, ["kind"], "value", "label"))
    # The calibration with the lower Brier score is chosen.
    best = losses.filter("kind <> 'p'").agg(F.min_by("kind", "brier").alias("_best"))
    return losses.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("kind") == F.col("_best")).drop("_best")


@query()
def m26_attribution(spark, d):
    """True and predicted families of held-out documents by a multinomial model on style features: counts, with the
    precision and recall of each family."""
    docs = documents(spark, d, "source").filter("source is not null").withColumn("source", F.when(F.col("source").startswith("gen_"), "generated").when(F.col("source").contains("feed"), "feed").otherwise("other"))
    f = written(FX.native(docs).select("doc_id", "source", *STYLE)).dropna(subset=STYLE)
    f = written(sampling.split(f, ["source"], "doc_id", 0.3))
    model = training.attribution(f.filter("not is_test"), STYLE, "source")
    return training.attribution_report(model, f.filter("is_test"), "source")


@query()
def a28_paired_t(spark, d):
    """Paired t of fold AUCs of one and two scores."""
    s = scores(spark, d).dropna()
    one = stats.auc(training.cross_validated(s, "lr", ["stylometric_score"], "row_id"), ["fold"], "p", "label").select("fold", F.col("auc").alias("one"))
    two = stats.auc(training.cross_validated(s, "lr", ["stylometric_score", "binoculars_score_neg"], "row_id"), ["fold"], "p", "label").select("fold", F.col("auc").alias("two"))
    return stats.paired_t(one.join(two, "fold").withColumn("g", F.lit("1 to 2")), ["g"], "one", "two")


@query()
def a20_importance(spark, d):
    s = scores(spark, d).dropna()
    features = ["stylometric_score", "binoculars_score_neg"]
    return training.permutation_importance(training.classifier("lr", features).fit(s), s, features, "row_id")
