"""Names for use from SQL: ``register(spark)`` makes the library's functions callable in ``spark.sql``.

``stylo_features(text)`` is a struct of all 39 features, ``mtld(text)`` the lexical diversity, ``nfc(text)`` and
``nfkc(text)`` Unicode forms, ``erfc(x)`` the complementary error function, ``defensive_text(text)`` the defensive
normaliser on a text in NFC, and ``sentences(text)`` a table function with a row (idx, sentence) for each sentence.
Null gives null, or no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import erfc

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions import kernel

NAMES = ("stylo_features", "mtld", "nfc", "nfkc", "erfc", "sentences")


def _struct() -> str:
    return "struct<" + ",".join(f"{c}:double" for c in kernel.ALL) + ",n_words:bigint,n_sents:bigint>"


def _features(texts: pd.Series) -> pd.DataFrame:
    found = kernel.measure(texts.where(texts.notna(), None).tolist(), "serve", None, True)
    out = pd.DataFrame({c: found[c] for c in kernel.ALL})
    out = out.where(pd.Series(found["enough"].astype(bool)), None)
    return out.assign(n_words=found["n_words"].astype("int64"), n_sents=found["n_sents"].astype("int64"))


def _mtld(texts: pd.Series) -> pd.Series:
    found = kernel.measure(texts.where(texts.notna(), None).tolist())
    return pd.Series(found["mtld"]).where(pd.Series(found["enough"].astype(bool)), None)


def _form(form: str):
    return lambda texts: texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))


class Sentences:
    """The sentences of a text in order; the whole text if nothing splits it."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is None:
            return
        parts = [s for s in map(str.strip, re.split(kernel.STRICT, text.strip())) if s]
        yield from enumerate(parts or [text])


def register(spark: SparkSession) -> None:
    """Registers all names in the session."""
    spark.udf.register("stylo_features", F.pandas_udf(_features, _struct()))
    spark.udf.register("mtld", F.pandas_udf(_mtld, "double"))
    spark.udf.register("nfc", F.pandas_udf(_form("NFC"), "string"))
    spark.udf.register("nfkc", F.pandas_udf(_form("NFKC"), "string"))
    spark.udf.register("erfc", F.pandas_udf(lambda x: x.map(lambda v: None if pd.isna(v) else erfc(v)), "double"))
    spark.udtf.register("sentences", F.udtf(Sentences, returnType="idx: int, sentence: string"))


__all__ = ["NAMES", "register"]
