"""Scores of documents: cascade, damping, thresholds, explanation, intervals, routing, fusion, watermarks.

All are column arithmetic; a costly second scorer runs only on the rows that need it, through a split and
a union, because both branches of a conditional expression would be evaluated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

SENSITIVITY = {"high": 0.35, "normal": 0.50, "low": 0.70}


def cascade(df: DataFrame, cheap: str, costly: Callable[[DataFrame], DataFrame] | None, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """``probability`` and ``level``: the cheap score where it is decisive, else that of ``costly`` (which adds a column ``second``), which sees only those rows. A null second score falls back on the cheap one."""
    sure = (F.col(cheap) <= low) | (F.col(cheap) >= high)
    if costly is None:
        return df.select("*", F.col(cheap).alias("probability"), F.lit("level_1").alias("level"))
    first = df.filter(F.coalesce(sure, F.lit(True))).select("*", F.col(cheap).alias("probability"), F.lit("level_1").alias("level"))
    second = costly(df.filter(~F.coalesce(sure, F.lit(True)))).select(*df.columns, F.coalesce("second", F.col(cheap)).alias("probability"), F.when(F.col("second").isNull(), "level_1").otherwise("level_2").alias("level"))
    return first.unionAll(second)


def damped(p: Column, n_words: Column) -> Column:
    """Scores of short texts drawn to 0.5: by (n / 15)^2 below 15 words, then by a logistic weight below 50."""
    short = F.when(n_words < 15, F.lit(0.5) + (p - 0.5) * F.pow(n_words / 15.0, F.lit(2.0))).otherwise(p)
    weight = 1.0 / (1.0 + F.exp(-0.08 * (n_words - 25)))
    return F.when(n_words < 50, F.lit(0.5) + (short - 0.5) * weight).otherwise(short)


def threshold_of(sensitivity: Column) -> Column:
    """The threshold of a named sensitivity; that of "normal" for any other."""
    out = F.when(sensitivity == "high", SENSITIVITY["high"]).when(sensitivity == "low", SENSITIVITY["low"])
    return out.otherwise(SENSITIVITY["normal"])


def interval(p: Column, half_width: Column | None = None) -> Column:
    """Bounds held to 0 and 1, width, and whether 0.5 is inside; without a fitted width 0.05 + 0.2 (1 - 2 |p - 0.5|)."""
    half = half_width if half_width is not None else F.lit(0.05) + 0.2 * (1 - 2 * F.abs(p - 0.5))
    lower, upper = F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)
    return F.struct(lower.alias("lower"), upper.alias("upper"), (upper - lower).alias("width"), ((lower < 0.5) & (upper > 0.5)).alias("uncertain"))


def explained(long: DataFrame, norms: DataFrame) -> DataFrame:
    """Feature values (id, register, feature, value) against the norms of their register, or of "all" for a register without any: z-score and whether it leans to AI."""
    known = norms.select("register").distinct()
    routed = long.join(F.broadcast(known.withColumnRenamed("register", "_known")), F.col("register") == F.col("_known"), "left").withColumn("norm_register", F.coalesce("_known", F.lit("all"))).drop("_known")
    n = norms.select(F.col("register").alias("norm_register"), "feature", "human_mean", "human_sd", "cohens_d")
    z = F.when(F.col("human_sd") > 0, (F.col("value") - F.col("human_mean")) / F.col("human_sd")).otherwise(0.0)
    # An effect of 0 or null leans neither way.
    up, down = F.col("cohens_d") > 0, F.col("cohens_d") < 0
    toward = F.coalesce((up & (F.col("z_score") > 0.5)) | (down & (F.col("z_score") < -0.5)), F.lit(False))
    return routed.join(F.broadcast(n), ["norm_register", "feature"]).withColumn("z_score", z).withColumn("deviation_towards_ai", toward)


def routed(register: Column, by_register: dict[str, Column], default: Column) -> Column:
    """The score column of the row's register, else the default."""
    out = None
    for name, c in by_register.items():
        out = F.when(register == name, c) if out is None else out.when(register == name, c)
    return default if out is None else out.otherwise(default)


def soft_routed(weights: list[Column], scores: list[Column]) -> Column:
    """Scores weighted by register probabilities; a missing score counts as 0.5."""
    total = sum(weights[1:], weights[0])
    mixed = sum((w * F.coalesce(s, F.lit(0.5)) for w, s in zip(weights[1:], scores[1:])), weights[0] * F.coalesce(scores[0], F.lit(0.5)))
    return mixed / F.nullif(total, F.lit(0.0))


def fused_min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """``fused``: the mean of the columns after each is brought to 0..1 over the whole table, by one aggregate of a single row."""
    ranges = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = df.crossJoin(F.broadcast(ranges))
    unit = [(F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0)) for c in columns]
    return joined.withColumn("fused", sum(unit[1:], unit[0]) / len(unit)).drop(*[x for x in joined.columns if x.startswith(("_lo_", "_hi_"))])


def verdict(p: Column) -> Column:
    return F.when(p >= 0.7, "ai").when(p >= 0.35, "mixed").otherwise("human")


def label_and_confidence(p: Column, threshold: float = 0.5) -> Column:
    return F.struct(F.when(p >= threshold, "AI").otherwise("human").alias("label"), F.greatest(p, 1 - p).alias("confidence"))


def attributed(p: Column, classes: dict[str, Column], reasoning: Column | None = None) -> Column:
    """The source of a text: human below 0.25; "reasoning" where that score exceeds 0.6; else the likeliest class, a human one giving way to the best other above 0.6. Ties go to the class listed first."""
    pick = lambda names: F.array_max(F.array(*[F.struct(classes[n].alias("p"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(classes) if n in names]))["name"]
    best, other = pick(set(classes)), pick(set(classes) - {"human"})
    chosen = F.when((best == "human") & (p > 0.6), other).otherwise(best)
    if reasoning is not None:
        chosen = F.when(reasoning > 0.6, "reasoning").otherwise(chosen)
    return F.when(p < 0.25, "human").otherwise(chosen)


def is_green(token: Column, seed: str = "42", gamma: float = 0.5) -> Column:
    """Whether md5("seed:token") modulo 100 lies below 100 gamma: the 128-bit number is folded in four parts of 32 bits, each worth 96 modulo 100 of the part before."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), token))
    rest = F.lit(0)
    for i in range(4):
        rest = (rest * 96 + F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")) % 100
    return rest < int(100 * gamma)


#: Tokens whose colour a worker keeps.
KEPT_TOKENS = 500_000


def green_counts(tokens: Column, seed: str = "42", gamma: float = 0.5) -> Column:
    """How many tokens of an array are green. One digest a distinct token, in an Arrow UDF: array lambdas are not compiled, and took some fifty times as long for each token."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        colour: dict[str, bool] = {}
        limit = int(100 * gamma)
        for part in parts:
            out = []
            for words in part:
                if words is None:
                    out.append(None)
                    continue
                if len(colour) > KEPT_TOKENS:
                    colour.clear()
                n = 0
                for w in words:
                    green = colour.get(w)
                    if green is None:
                        green = colour[w] = int.from_bytes(md5(f"{seed}:{w}".encode()).digest()) % 100 < limit
                    n += green
                out.append(n)
            yield pd.Series(out, dtype="Int64")

    return F.pandas_udf(run, "long")(tokens)


def watermark(df: DataFrame, id_col: str, text_col: str = "text", seed: str = "42", gamma: float = 0.5, z_threshold: float = 4.0, least: int = 20) -> DataFrame:
    """Green tokens of each text against a share of gamma: counts, z, and confidence; texts of fewer than ``least`` tokens have no z."""
    t = df.select(id_col, X.tokens(text_col).alias("_t"))
    t = t.select(id_col, F.size("_t").alias("_n"), green_counts(F.col("_t"), seed, gamma).alias("_green"))
    n, green = F.col("_n"), F.col("_green")
    z = F.when(n >= least, (green - gamma * n) / F.sqrt(n * gamma * (1 - gamma)))
    named = F.when(z >= 1.5 * z_threshold, "high").when(z >= z_threshold, "medium").when(z >= 0.6 * z_threshold, "low").otherwise("none")
    return t.select(id_col, n.alias("tokens"), green.alias("green"), z.alias("z"), named.alias("confidence"))


def upper_tail(z: Column) -> Column:
    """One-sided normal p-value."""
    return F.pandas_udf(lambda v: v.map(lambda x: None if pd.isna(x) else 0.5 * erfc(x / sqrt(2))), "double")(z)


def blind_watermark(df: DataFrame, id_col: str, text_col: str = "text", least: int = 20) -> DataFrame:
    """Entropy of the token distribution of each text, and what it suggests; null and "insufficient_length" below ``least`` tokens."""
    t = df.select(id_col, F.transform(X.tokens(text_col), lambda w: w).alias("_t"))
    counted = t.select(id_col, F.size("_t").alias("tokens"), F.explode_outer("_t").alias("_w")).groupBy(id_col, "tokens", "_w").agg(F.count("_w").alias("_c"))
    h = counted.groupBy(id_col, "tokens").agg(F.sum(F.when(F.col("_c") > 0, F.col("_c") * F.log2("_c")).otherwise(0.0)).alias("_h"))
    entropy = F.when(F.col("tokens") >= least, F.log2("tokens") - F.col("_h") / F.col("tokens"))
    return h.select(id_col, "tokens", entropy.alias("entropy"), F.when(F.col("tokens") < least, "insufficient_length").when(entropy > 7.0, "possible").when(entropy > 6.5, "elevated").otherwise("normal").alias("finding"))


def linear_score(df: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """``p``: a logistic score of feature columns with fixed weights; missing features count as 0."""
    total = F.lit(bias)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * w
    return df.withColumn("p", 1.0 / (1.0 + F.exp(-total)))


def attribution_record(p: Column, classes: dict[str, Column], reasoning: Column | None = None) -> Column:
    """The source of a text by ``attributed``, as (source, confidence): below 0.25 the confidence is that of human text,
    for a reasoning model its score, else the probability of the class named."""
    source = attributed(p, classes, reasoning)
    named = F.create_map(*[x for n, c in classes.items() for x in (F.lit(n), c)])
    sure = F.when(p < 0.25, 1 - p)
    if reasoning is not None:
        sure = sure.when(source == "reasoning", reasoning)
    return F.struct(source.alias("source"), sure.otherwise(F.try_element_at(named, source)).alias("confidence"))
