"""Style features of documents as columns, and word densities by language.

The features come from one Arrow pass (``functions.kernel``). Definitions vary by profile: ``serve``, ``v0``,
``train`` and ``adversarial`` differ in tokens, lists and deviations. A density is a count by thousand words. Null
or too short texts give null features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import kernel
from lectern.functions import text as X
from lectern.functions import wordlists as L

ORIGINAL, EXTENDED, ALL, AGNOSTIC = kernel.ORIGINAL, kernel.EXTENDED, kernel.ALL, kernel.AGNOSTIC
#: Features that need counts of all words or trigrams, or the words' order.
COUNTED = ["mtld", "char_entropy", "rep_rate", "hapax_legomena_ratio", "yules_k", "simpsons_d"]
NATIVE = [f for f in ALL if f not in COUNTED and f not in kernel.UNTAGGED]


def count_in(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*words)))


def native(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the serving profile's features of sentences, lists and patterns, ``n_words`` and ``n_sents``."""
    return kernel.with_features(df, text_col, columns=NATIVE)


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with lexical diversity, trigram entropy, repetition, hapax share, Yule's K and Simpson's D."""
    return kernel.with_features(df, text_col, columns=COUNTED).drop("n_words", "n_sents")


def record(df: DataFrame, text_col: str = "text", lang: str | None = None) -> DataFrame:
    """``df`` with all 39 features of the text in NFKC, lists by the language found in it unless one is given."""
    return kernel.with_features(df, text_col, lang=lang, compose=True)


def agnostic(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the features that depend on no language."""
    return kernel.with_features(df, text_col, columns=AGNOSTIC, lang="unknown", compose=True)


def profile_features(df: DataFrame, profile: str, text_col: str = "text") -> DataFrame:
    """The eleven original features as the profile ``v0``, ``train`` or ``adversarial`` defines them.

    ``v0``: ASCII words, at least 20. ``train``: its own lists, at least 50 words; an opener is followed by space or
    a comma. ``adversarial``: its own lists, words with apostrophes, loose sentences with at least two, population
    deviation, sentences without words kept, an opener is a sentence's first word, trigrams as written, and
    repetition is the share of distinct words said twice or more.
    """
    return kernel.with_features(df, text_col, name=profile)


def lexical_diversity(words: list[str]) -> float:
    """Words by factor, mean of both directions."""
    return kernel.diversity(list(words), "zero", 0)


def by_language(df: DataFrame, text_col: str = "text", lang: Column | None = None) -> DataFrame:
    """Hedge, booster, connector and self-mention densities with the lists of each text's language, found or given."""
    code = lang if lang is not None else X.language(text_col)
    base = df.withColumns({"_w": X.words(text_col), "language": code})
    total = F.greatest(F.size("_w") / 1000.0, F.lit(0.001))

    def listed(kind: str) -> Column:
        pick = None
        for name in L.LANGUAGES:
            c = count_in(F.col("_w"), L.LANGUAGES[name][kind])
            pick = F.when(F.col("language") == name, c) if pick is None else pick.when(F.col("language") == name, c)
        return pick.otherwise(count_in(F.col("_w"), L.lists_of("en")[kind])) / total

    return base.select(*df.columns, "language", F.size("_w").alias("n_words"), *(listed(k).alias(f"{k}_density") for k in ("hedge", "booster", "connector", "self_mention")))
