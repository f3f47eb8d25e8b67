"""Training and evaluation with Spark ML: classifiers, cross-validation, stacking, importance, ablation, calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import running, sampling, stats
from lectern.plans.stage import written


def classifier(kind: str, features: list[str], label: str = "label", weight: str | None = None, **settings) -> Pipeline:
    """A pipeline of assembled (and for linear kinds scaled) features and a classifier: rf, lr, gbt or svc."""
    steps = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip")]
    of = "_raw"
    if kind in ("lr", "svc"):
        steps.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True))
        of = "_scaled"
    make = {"rf": RandomForestClassifier, "lr": LogisticRegression, "gbt": GBTClassifier, "svc": LinearSVC}[kind]
    defaults = {"rf": {"numTrees": 100, "maxDepth": 10, "seed": 42}, "gbt": {"maxIter": 30, "seed": 42}}.get(kind, {})
    model = make(featuresCol=of, labelCol=label, **(defaults | settings))
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[*steps, model])


def probabilities(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """``df`` with the probability of label 1; of a margin classifier, its logistic."""
    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn(name, p).select(*df.columns, name)


def logistic_expression(model: PipelineModel) -> Column:
    """The probability of a fitted logistic pipeline as one arithmetic expression of its feature columns, which stays in
    generated code; null where a feature is null."""
    assembler, *scaled, last = model.stages
    names, weights = assembler.getInputCols(), last.coefficients.toArray()
    mean, sd = np.zeros(len(names)), np.ones(len(names))
    for s in scaled:
        sd = np.where(s.std.toArray() > 0, s.std.toArray(), 1.0)
        mean = s.mean.toArray() if s.getWithMean() else mean
        weights = np.where(s.std.toArray() > 0, weights, 0.0)
    total = F.lit(float(last.intercept - (weights * mean / sd).sum()))
    for c, w in zip(names, weights / sd):
        total = total + F.col(c) * F.lit(float(w))
    return 1 / (1 + F.exp(-total))


def cross_validated(df: DataFrame, kind: str, features: list[str], id_col: str, label: str = "label", k: int = 5, **settings) -> DataFrame:
    """Held-out probabilities of every row by stratified folds: (columns, fold, p)."""
    folded = written(sampling.folds(df.dropna(subset=[*features, label]), [label], id_col, k))
    out = None
    for f in range(k):
        model = classifier(kind, features, label, **settings).fit(folded.filter(F.col("fold") != f))
        part = probabilities(model, folded.filter(F.col("fold") == f))
        out = part if out is None else out.unionAll(part)
    return out


def fold_metrics(scored: DataFrame, groups: list[str], label: str = "label") -> DataFrame:
    """Mean and population deviation over folds of AUC and accuracy."""
    auc = stats.auc(scored, [*groups, "fold"], "p", label)
    acc = stats.confusion(scored, [*groups, "fold"], "p", label)
    keys = [*groups, "fold"]
    return auc.join(acc, keys).groupBy(*groups).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_sd"), F.avg("accuracy").alias("acc_mean"), F.stddev_pop("accuracy").alias("acc_sd"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], id_col: str, label: str = "label", repeats: int = 3) -> DataFrame:
    """Loss of AUC where a feature's values are exchanged among rows by a hash order; mean and population deviation over repeats."""
    spark = df.sparkSession
    base = stats.auc(probabilities(model, df), [], "p", label).first()["auc"]
    rows = []
    numbered = running.ranked(df, [], [F.col(id_col)], name="_i")
    for r in range(repeats):
        # One order of the rows a repeat; each feature takes its values from there.
        order = [F.xxhash64(F.col(id_col), F.lit(r)), F.col(id_col)]
        mixed = running.ranked(df.select(id_col, *features), [], order, name="_i")
        mixed = mixed.select("_i", *(F.col(f).alias(f"_v{i}") for i, f in enumerate(features)))
        both = written(numbered.join(mixed, "_i"))
        for i, f in enumerate(features):
            swapped = both.withColumn(f, F.col(f"_v{i}")).select(*df.columns)
            rows.append((f, base - stats.auc(probabilities(model, swapped), [], "p", label).first()["auc"]))
    drops = spark.createDataFrame(rows, "feature string, drop double").groupBy("feature")
    return drops.agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_sd"))


def ablation(df: DataFrame, ranked_features: list[str], sizes: tuple[int, ...], id_col: str, label: str = "label", k: int = 3) -> DataFrame:
    """Cross-validated AUC with the first features of a ranking."""
    out = None
    for n in sizes:
        part = fold_metrics(cross_validated(df, "lr", ranked_features[:n], id_col, label, k).withColumn("n_features", F.lit(n)), ["n_features"], label)
        out = part if out is None else out.unionAll(part)
    return out


def cross_domain(df: DataFrame, group: str, features: list[str], label: str = "label", kind: str = "lr") -> DataFrame:
    """AUC of a model of each group on each other: (train, test, auc). Groups are few by nature."""
    names = [r[0] for r in df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(label).alias("n")).filter("n = 2").select(group).orderBy(group).collect()]
    out = None
    for train in names:
        model = classifier(kind, features, label).fit(df.filter(F.col(group) == train))
        part = stats.auc(probabilities(model, df.filter(F.col(group).isin(names))), [group], "p", label).select(F.lit(train).alias("train"), F.col(group).alias("test"), "auc")
        out = part if out is None else out.unionAll(part)
    return out


def platt(df: DataFrame, p: str, n_words: str, label: str = "label") -> PipelineModel:
    """A logistic calibration on probability, length and their product."""
    return Pipeline(stages=[VectorAssembler(inputCols=[p, n_words, "_pn"], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label)]).fit(df.withColumn("_pn", F.col(p) * F.col(n_words)))


def isotonic(df: DataFrame, p: str, label: str = "label"):
    """A monotone calibration of a probability."""
    return IsotonicRegression(featuresCol=p, labelCol=label).fit(df.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).select(p, F.col(label).cast("double").alias(label)))


def attribution(df: DataFrame, features: list[str], source: str) -> PipelineModel:
    """A multinomial model of the source class."""
    return Pipeline(stages=[StringIndexer(inputCol=source, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial")]).fit(df)


def attribution_report(model: PipelineModel, df: DataFrame, source: str) -> DataFrame:
    """(source, predicted, n, precision, recall): the confusion matrix, with the precision of the predicted class and the
    recall of the true one."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    found = model.transform(df).withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
    cells = found.groupBy(source, "predicted").agg(F.count(F.lit(1)).alias("n"))
    true = cells.groupBy(F.col(source).alias("_s")).agg(F.sum("n").alias("_true"))
    said = cells.groupBy(F.col("predicted").alias("_p")).agg(F.sum("n").alias("_said"))
    right = cells.filter(F.col(source) == F.col("predicted")).select(F.col(source).alias("_r"), F.col("n").alias("_right"))
    joined = cells.join(true, F.col(source) == F.col("_s")).join(said, F.col("predicted") == F.col("_p"))
    of = lambda c, name: right.select(F.col("_r").alias(f"_k{name}"), F.col("_right").alias(name))
    joined = joined.join(of("p", "_hit_p"), F.col("predicted") == F.col("_k_hit_p"), "left")
    joined = joined.join(of("s", "_hit_s"), F.col(source) == F.col("_k_hit_s"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        source, "predicted", "n", (zero("_hit_p") / F.col("_said")).alias("precision"),
        (zero("_hit_s") / F.col("_true")).alias("recall"),
    )


def word_grams(words: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams within words, each word framed by blanks."""

    def grams(lists: pd.Series) -> pd.Series:
        def of(w: str) -> list[str]:
            framed = f" {w} "
            return [framed[i : i + n] for n in range(low, high + 1) for i in range(len(framed) - n + 1)]

        return lists.map(lambda ws: None if ws is None else [g for w in ws for g in of(w)])

    return F.pandas_udf(grams, "array<string>")(words)


def text_classifier(label: str = "label", words: str = "words", size: int = 10_000, grams: str | None = None) -> Pipeline:
    """TF-IDF of words and word pairs, and of character n-grams where a column of them is named, with a linear margin
    classifier; ``size`` terms of each."""
    steps = [
        NGram(n=2, inputCol=words, outputCol="_pairs"),
        CountVectorizer(inputCol=words, outputCol="_c1", vocabSize=size),
        CountVectorizer(inputCol="_pairs", outputCol="_c2", vocabSize=size),
    ]
    parts = ["_c1", "_c2"]
    if grams:
        steps.append(CountVectorizer(inputCol=grams, outputCol="_c3", vocabSize=size))
        parts.append("_c3")
    steps += [
        VectorAssembler(inputCols=parts, outputCol="_counts"),
        IDF(inputCol="_counts", outputCol="_tfidf"),
        LinearSVC(featuresCol="_tfidf", labelCol=label),
    ]
    return Pipeline(stages=steps)


def calibrated_margins(scored: DataFrame, margin: str, label: str, k: int = 5) -> DataFrame:
    """``p``: a logistic map of margins to probabilities, fitted on the other folds (column ``fold``)."""
    # A column named prediction would clash with the model's own.
    rows = scored.withColumnRenamed("prediction", "_said") if "prediction" in scored.columns else scored
    out = None
    for f in range(k):
        model = classifier("lr", [margin], label).fit(rows.filter(F.col("fold") != f))
        part = probabilities(model, rows.filter(F.col("fold") == f))
        out = part if out is None else out.unionAll(part)
    return out.withColumnRenamed("_said", "prediction")


def text_cross_validated(df: DataFrame, id_col: str, label: str = "label", words: str = "words", k: int = 5, size: int = 10_000) -> DataFrame:
    """Held-out predictions of the text classifier for every row by stratified folds, vocabulary and weights from the other folds: (columns, fold, prediction)."""
    folded = written(sampling.folds(df, [label], id_col, k))
    out = None
    for f in range(k):
        model = text_classifier(label, words, size).fit(folded.filter(F.col("fold") != f))
        held = model.transform(folded.filter(F.col("fold") == f))
        part = held.select(*folded.columns, "prediction", vector_to_array("rawPrediction")[1].alias("margin"))
        out = part if out is None else out.unionAll(part)
    return out


def embedding_probe(
    df: DataFrame, vector: str = "embedding", label: str = "label", test: DataFrame | None = None
) -> DataFrame:
    """The top class (``prediction``) of a logistic model on an embedding column, for the rows of ``test`` or of ``df``."""
    of = lambda x: x.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=30, regParam=0.01).fit(of(df))
    test = df if test is None else test
    return model.transform(of(test)).select(*test.columns, "prediction")
