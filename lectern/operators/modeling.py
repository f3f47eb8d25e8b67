"""Models by register: fitting, saving, routing, hybrid vectors, search, selection and comparison.

Registers are few by nature, so there is one fit for each; fits that don't depend on each other are started side by
side from a small thread pool, and Spark runs their jobs at once. Probabilities in comparisons are held out.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.kernel import ORIGINAL
from lectern.operators import forest, sampling, stats
from lectern.operators.training import classifier, cross_validated, fold_metrics, probabilities
from lectern.plans.stage import written

#: Fits that run side by side.
AT_ONCE = 4
#: What stands for a neural score that is missing, and the order of the hybrid vector's last columns.
NEURAL = {"perplexity": 50.0, "burstiness": 1.0, "binoculars": 0.95, "semantic": 0.5}


def side_by_side(jobs: list[Callable]) -> list:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda job: job(), jobs))


# ---- models by register --------------------------------------------------------------------------------------------
def eligible(df: DataFrame, group: str, label: str, least: int) -> list[str]:
    """Groups with rows of both labels and at least ``least`` rows, in order."""
    sizes = df.filter(F.col(group).isNotNull() & F.col(label).isin(0, 1)).groupBy(group)
    sizes = sizes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("labels"))
    return sorted(r[0] for r in sizes.filter((F.col("labels") == 2) & (F.col("n") >= least)).collect())


def fitted_by_register(
    df: DataFrame, features: list[str], register: str = "register", label: str = "label", kind: str = "rf",
    least: int = 50, **settings,
) -> dict[str, PipelineModel]:
    """A model for each register with enough rows of both labels, and one named "all"."""
    rows = df.filter(F.col(label).isin(0, 1)).dropna(subset=features)
    names = eligible(rows, register, label, least)
    make = lambda part: classifier(kind, features, label, **settings).fit(part)
    parts = [rows, *(rows.filter(F.col(register) == n) for n in names)]
    return dict(zip(["all", *names], side_by_side([lambda p=p: make(p) for p in parts])))


def scored_by_register(df: DataFrame, models: dict[str, PipelineModel], register: str = "register") -> DataFrame:
    """``df`` with ``p`` and ``scored_as``: the probability by the model of the row's register, else by that of all."""
    named = F.col(register).isin(*(n for n in models if n != "all"))
    known = F.when(named, F.col(register)).otherwise("all")
    routed = df.withColumn("scored_as", F.coalesce(known, F.lit("all")))
    out = None
    for name, model in models.items():
        part = probabilities(model, routed.filter(F.col("scored_as") == name))
        out = part if out is None else out.unionByName(part)
    return out


def save_models(models: dict[str, PipelineModel], path: str, spark: SparkSession) -> None:
    """Writes the models under a folder; what is there becomes the folder's ``.bak``, replacing an older one."""
    jvm = spark.sparkContext._jvm
    now, before = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.bak"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(before, True)
        fs.rename(now, before)
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, spark: SparkSession) -> dict[str, PipelineModel]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return {name: PipelineModel.load(f"{path}/{name}") for name in sorted(found)}


def register_classifier(df: DataFrame, features: list[str], register: str = "register", trees: int = 100) -> PipelineModel:
    """A forest that names a text's register."""
    steps = [
        StringIndexer(inputCol=register, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"),
        RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=10, seed=42),
    ]
    rows = df.filter(F.col(register).isNotNull()).dropna(subset=features)
    fitted = Pipeline(stages=steps).fit(rows)
    # Scoring needs no register in the rows.
    return PipelineModel(stages=fitted.stages)


def with_register(df: DataFrame, model: PipelineModel | None, override: Column | None = None) -> DataFrame:
    """``df`` with ``register_found`` and ``register_confidence``: the override where there is one, without confidence;
    else the likeliest register; "all" without a model."""
    if model is None:
        found = df.withColumns({"_r": F.lit("all"), "_c": F.lit(None).cast("double")})
    else:
        names, *rest = model.stages
        out = PipelineModel(stages=rest).transform(df)
        p = vector_to_array("probability")
        table = F.array(*map(F.lit, names.labels))
        found = out.withColumns({"_r": F.get(table, F.col("prediction").cast("int")), "_c": F.array_max(p)})
        found = found.select(*df.columns, "_r", "_c")
    if override is None:
        override = F.lit(None).cast("string")
    named = F.coalesce(override, F.col("_r")).alias("register_found")
    sure = F.when(override.isNull(), F.col("_c")).alias("register_confidence")
    return found.select(*df.columns, named, sure)


# ---- hybrid vectors ------------------------------------------------------------------------------------------------
def hybrid_columns(df: DataFrame, neural: dict[str, str], binoculars: bool = True) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns of the hybrid vector, and their names in order: the eleven features, perplexity,
    burstiness, on demand the binoculars score, and the semantic score. ``neural`` names the columns that hold them;
    one that is not named or null gets its fixed value."""
    wanted = [n for n in NEURAL if binoculars or n != "binoculars"]
    given = {n: F.col(neural[n]) if n in neural else F.lit(None).cast("double") for n in wanted}
    out = df.withColumns({f"_h_{n}": F.coalesce(c, F.lit(NEURAL[n])) for n, c in given.items()})
    return out, [*ORIGINAL, *(f"_h_{n}" for n in wanted)]


def hybrid_scored(df: DataFrame, models: dict[str, PipelineModel], neural: dict[str, str], register: str = "register") -> DataFrame:
    """``df`` with ``second``: the hybrid probability by the register's model; 0.5 where the text is too short. Whether the
    vector has the binoculars score is read off the models."""
    width = len(models["all"].stages[0].getInputCols())
    wide, names = hybrid_columns(df, neural, width == len(ORIGINAL) + len(NEURAL))
    if width != len(names):
        raise ValueError(f"a model of {width} features; hybrid vectors have {len(names)}")
    short = F.greatest(*(F.col(f).isNull().cast("int") for f in ORIGINAL)) == 1
    scored = scored_by_register(wide.filter(~short), models, register).withColumnRenamed("p", "second")
    rest = wide.filter(short).withColumns({"second": F.lit(0.5), "scored_as": F.lit("all")})
    return scored.unionByName(rest).select(*df.columns, "second")


def probability_in(reply: Column) -> Column:
    """The first number in a model's reply, held to 0 and 1; null if there is none."""
    found = F.regexp_extract(reply, r"[-+]?\d*\.\d+|\d+", 0)
    return F.when(found != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), found.cast("double"))))


def perplexity(log_probabilities: Column) -> Column:
    """exp of the mean negative log probability of an array of token log probabilities; null for none."""
    n = F.nullif(F.size(log_probabilities), F.lit(0))
    return F.exp(-F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + x) / n)


def burstiness(log_probabilities: Column) -> Column:
    """Population deviation of the token losses; null for none."""
    n = F.nullif(F.size(log_probabilities), F.lit(0))
    mean = F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def binoculars(log_probabilities: Column, cross_entropies: Column) -> Column:
    """Log perplexity over the mean cross entropy of the two models; null for none or a zero divisor."""
    n = F.nullif(F.size(cross_entropies), F.lit(0))
    cross = F.aggregate(cross_entropies, F.lit(0.0), lambda a, x: a + x) / n
    return F.ln(perplexity(log_probabilities)) / F.nullif(cross, F.lit(0.0))


# ---- search, selection, comparison ----------------------------------------------------------------------------------
#: What the random search draws from.
SPACE = {
    "numTrees": [100, 150, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2"],
}


def _cv_auc(folded: DataFrame, kind: str, features: list[str], label: str, k: int, settings: dict) -> float | None:
    """AUC of held-out probabilities over all folds, by one union."""
    out = None
    for f in range(k):
        model = classifier(kind, features, label, **settings).fit(folded.filter(F.col("fold") != f))
        part = probabilities(model, folded.filter(F.col("fold") == f)).select(label, "p", "fold")
        out = part if out is None else out.unionAll(part)
    return stats.auc(out, ["fold"], "p", label).agg(F.avg("auc")).first()[0]


def random_search(
    df: DataFrame, features: list[str], id_col: str, label: str = "label", draws: int = 20, k: int = 3, seed: int = 42,
    space: dict[str, list] | None = None,
) -> DataFrame:
    """(draw, parameters, auc, best): forests of drawn parameters by their mean AUC over k folds, and draw 0, the default
    forest, held out like the others. Forests are grown from counted cells where few enough tell the rows apart."""
    spark = df.sparkSession
    rng = random.Random(seed)
    space = space or SPACE
    tried = [{}, *({name: rng.choice(values) for name, values in space.items()} for _ in range(draws))]
    rows = df.filter(F.col(label).isin(0, 1)).dropna(subset=features)
    folded = written(sampling.folds(rows, [label], id_col, k))
    aucs = forest.cv_aucs(folded, features, tried, label, k) if all(map(forest.covers, tried)) else None
    if aucs is None:
        aucs = side_by_side([lambda s=s: _cv_auc(folded, "rf", features, label, k, s) for s in tried])
    top = max((a for a in aucs if a is not None), default=None)
    rows = [(i, str(s), a, a is not None and a == top) for i, (s, a) in enumerate(zip(tried, aucs))]
    return spark.createDataFrame(rows, "draw int, parameters string, auc double, best boolean")


def selected_models(
    df: DataFrame, features: list[str], id_col: str, register: str = "register", label: str = "label", k: int = 3,
    least: int = 50, kinds: tuple[str, ...] = ("lr", "rf", "gbt"),
) -> DataFrame:
    """(register, kind, auc, chosen): of each register and of all, the mean AUC of each kind over k folds and the one
    chosen; a register with too few rows takes the kind chosen for all, without an AUC of its own."""
    spark = df.sparkSession
    rows = df.filter(F.col(label).isin(0, 1)).dropna(subset=features)
    names = [r[0] for r in rows.filter(F.col(register).isNotNull()).select(register).distinct().orderBy(register).collect()]
    enough = set(eligible(rows, register, label, least))
    folded = written(sampling.folds(rows, [label], id_col, k))
    jobs = [(n, kind) for n in ["all", *(x for x in names if x in enough)] for kind in kinds]
    part = lambda n: folded if n == "all" else folded.filter(F.col(register) == n)
    aucs = dict(zip(jobs, side_by_side([lambda j=j: _cv_auc(part(j[0]), j[1], features, label, k, {}) for j in jobs])))
    out = []
    for n in ["all", *names]:
        own = n if n in enough or n == "all" else "all"
        best = max(kinds, key=lambda kind: aucs[own, kind] or 0.0)
        out += [(n, kind, aucs.get((n, kind)), kind == best) for kind in kinds]
    return spark.createDataFrame(out, "register string, kind string, auc double, chosen boolean")


def ensembler_strategies(
    train: DataFrame, test: DataFrame, style: list[str], neural: list[str], register: str = "register",
    label: str = "label", least: int = 50,
) -> DataFrame:
    """(strategy, auc): logistic models on features and neural scores, on neural scores alone, and on neural scores by
    register with a fall-back on the model of all; and the plain mean of the neural scores. Held-out AUC."""
    spark = train.sparkSession
    mean = sum((F.col(c) for c in neural[1:]), F.col(neural[0])) / len(neural)
    test = test.dropna(subset=[*style, *neural, label])

    def of(columns: list[str]) -> DataFrame:
        return probabilities(classifier("lr", columns, label).fit(train.dropna(subset=[*columns, label])), test)

    def by_register() -> DataFrame:
        return scored_by_register(test, fitted_by_register(train, neural, register, label, "lr", least), register)

    tried = {
        "features_and_neural": lambda: of([*style, *neural]),
        "neural": lambda: of(neural),
        "neural_by_register": by_register,
        "mean_of_neural": lambda: test.withColumn("p", mean),
    }
    auc = lambda make: stats.auc(make(), [], "p", label).select("auc").first()
    found = side_by_side([lambda m=m: auc(m) for m in tried.values()])
    rows = [(name, r[0] if r else None) for name, r in zip(tried, found)]
    return spark.createDataFrame(rows, "strategy string, auc double")


def regularisation(
    train: DataFrame, test: DataFrame, features: list[str], label: str = "label",
    strengths: tuple[float, ...] = (100.0, 10.0, 1.0, 0.1, 0.01, 0.001),
) -> DataFrame:
    """(c, train_auc, test_auc) of logistic models with penalty 1 / (c n)."""
    spark = train.sparkSession
    train, test = (x.dropna(subset=[*features, label]) for x in (train, test))
    n = max(train.count(), 1)

    def one(c: float) -> tuple:
        model = classifier("lr", features, label, regParam=1.0 / (c * n)).fit(train)
        found = [stats.auc(probabilities(model, x), [], "p", label).select("auc").first() for x in (train, test)]
        return (c, *(r[0] if r else None for r in found))

    rows = side_by_side([lambda c=c: one(c) for c in strengths])
    return spark.createDataFrame(rows, "c double, train_auc double, test_auc double")


def forest_against_logistic(
    df: DataFrame, features: list[str], id_col: str, group: str, label: str = "label", least: int = 100, k: int = 5
) -> DataFrame:
    """(group, classifier, auc_mean, auc_sd, acc_mean): forests and logistic models over k folds, of each group with
    enough rows of both labels and of all."""
    rows = written(df.filter(F.col(label).isin(0, 1)).dropna(subset=features))
    jobs = [(n, kind) for n in [*eligible(rows, group, label, least), "all"] for kind in ("rf", "lr")]

    def one(name: str, kind: str) -> DataFrame:
        part = rows if name == "all" else rows.filter(F.col(group) == name)
        held = cross_validated(part.drop("fold"), kind, features, id_col, label, k)
        named = held.withColumns({"_g": F.lit(name), "_c": F.lit(kind)})
        return written(fold_metrics(named, ["_g", "_c"], label))

    out = None
    for part in side_by_side([lambda j=j: one(*j) for j in jobs]):
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("_g").alias(group), F.col("_c").alias("classifier"), "auc_mean", "auc_sd", "acc_mean")


def coefficients(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, coefficient, size) of a logistic model on standardised features."""
    model = classifier("lr", features, label).fit(df.filter(F.col(label).isin(0, 1)).dropna(subset=features))
    found = model.stages[-1].coefficients.toArray().tolist()
    rows = [(f, c, abs(c)) for f, c in zip(features, found)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, size double")
