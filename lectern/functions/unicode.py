"""Unicode normal forms, which Spark lacks, as Arrow UDFs. They run only on texts that hold a non-ASCII character."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _form(name: str):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized(name, t) else unicodedata.normalize(name, t))

    return run


def nfc(text: Column | str) -> Column:
    return _form("NFC")(text)


def nfkc(text: Column | str) -> Column:
    return _form("NFKC")(text)
