"""Assembled detection of documents: one record a document, and one row a sentence.

The scorer is a parameter: any function that adds a column ``p`` to a frame of features. The default is a
logistic score with fixed weights, so results are reproducible without a trained artefact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import features as FX
from lectern.functions import text as X
from lectern.functions.unicode import nfc
from lectern.operators import scoring, windows
from lectern.plans.stage import written

WEIGHTS = {"mean_sent_len": 0.03, "sent_cv": -1.2, "self_mention_density": -0.02, "connector_density": 0.05, "hedge_density": -0.02, "punct_entropy": -0.4}
BIAS = 0.6


def default_scorer(df: DataFrame) -> DataFrame:
    return scoring.linear_score(df, WEIGHTS, BIAS)


def model_scorer(models: dict) -> Callable[[DataFrame], DataFrame]:
    """A scorer by fitted models of registers (``modeling.fitted_by_register``): a row's register names its model, any
    other or none takes that of all; rows without features keep a null score."""
    from lectern.operators import modeling

    def score(df: DataFrame) -> DataFrame:
        names = models["all"].stages[0].getInputCols()
        complete = F.greatest(*(F.col(f).isNull().cast("int") for f in names), F.lit(0)) == 0
        rows = df if "register" in df.columns else df.withColumn("register", F.lit(None).cast("string"))
        scored = modeling.scored_by_register(rows.filter(complete), models).drop("scored_as")
        return scored.unionByName(rows.filter(~complete).withColumn("p", F.lit(None).cast("double")))

    return score


def detected(df: DataFrame, id_col: str, text_col: str = "text", register_col: str = "register", sensitivity_col: str | None = None, scorer: Callable[[DataFrame], DataFrame] = default_scorer) -> DataFrame:
    """(id, register, probability, is_ai, verdict, lower, upper, uncertain, error) of every document. Texts too short for features give the default record: probability 0, register "unknown", an error; no row is lost."""
    clean = df.select(F.col(id_col).alias("id"), F.lower(F.trim(register_col)).alias("register"), (F.col(sensitivity_col) if sensitivity_col else F.lit("normal")).alias("sensitivity"), X.defensive(text_col, nfc(text_col)).alias("text"))
    scored = scorer(FX.native(clean))
    enough = F.col("n_words") >= 5
    p = scoring.damped(F.col("p"), F.size(X.space_words("text")))
    out = scored.select("id", F.when(enough, F.coalesce("register", F.lit("all"))).otherwise("unknown").alias("register"), "sensitivity", F.when(enough, p).otherwise(0.0).alias("probability"), F.when(~F.coalesce(enough, F.lit(False)), "text too short").alias("error"))
    i = scoring.interval(F.col("probability"))
    return out.select("id", "register", "probability", (F.col("probability") >= scoring.threshold_of(F.col("sensitivity"))).alias("is_ai"), scoring.verdict(F.col("probability")).alias("verdict"), i["lower"].alias("lower"), i["upper"].alias("upper"), i["uncertain"].alias("uncertain"), "error")


def analysed_sentences(df: DataFrame, id_col: str, text_col: str = "text", scorer: Callable[[DataFrame], DataFrame] = default_scorer) -> DataFrame:
    """(id, idx, sentence, score): the mean score of the three-sentence windows a sentence is in, each moved inward at the
    edges; a window too short for features takes the score of its middle sentence alone, or else 0.5."""
    sentences = windows.sentence_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    texts = windows.shifted_windows(sentences, "id")
    enough = F.col("n_words") >= 5
    scored = scorer(FX.native(texts, "window")).withColumn("_window", F.when(enough, F.col("p")))
    scored = scored.select("id", "idx", "sentence", "_window")
    alone = scorer(FX.native(scored, "sentence")).withColumn("_alone", F.when(enough, F.col("p")))
    chain = alone.select("id", "idx", F.coalesce("_window", "_alone", F.lit(0.5)).alias("score"))
    means = windows.shifted_window_means(written(chain), "id", "score")
    return sentences.join(means, ["id", "idx"]).select("id", "idx", "sentence", F.col("mean_score").alias("score"))


def detected_spans(df: DataFrame, id_col: str, text_col: str = "text", scorer: Callable[[DataFrame], DataFrame] = default_scorer) -> DataFrame:
    """(id, idx, sentence, score, is_ai, uncertain): each sentence scored by the window around it; windows that are too short take the line between their neighbours. Documents of fewer than 30 words give no rows."""
    clean = df.select(F.col(id_col).alias("id"), X.defensive(text_col, nfc(text_col)).alias("text")).filter(F.size(X.space_words("text")) >= 30)
    rows = windows.centred_windows(windows.sentence_rows(clean, "id"), "id")
    scored = scorer(FX.native(rows, "window")).withColumn("score", F.when(F.col("n_words") >= 5, F.col("p")))
    filled = windows.interpolated(scored.select("id", "idx", "sentence", "score"), "id", "score")
    s = F.coalesce("filled", F.lit(0.5))
    return filled.select("id", "idx", "sentence", s.alias("score"), (s >= 0.5).alias("is_ai"), ((s > 0.35) & (s < 0.65)).alias("uncertain"))
