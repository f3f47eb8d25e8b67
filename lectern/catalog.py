"""All queries of the core library over the tables of a data directory, with DuckDB SQL for those SQL can express.

Results are tidied for comparison: whole numbers as BIGINT, fractions as DOUBLE to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, and the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores where it has fewer, as a small file that is one split has: text
    work is CPU-bound. A table of more splits than cores is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with a text."""
    return spread(table(spark, sf_dir, "documents", "doc_id", *columns, "text").filter("text is not null"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of corpus rows, the last of each row, register and label cleaned; rows without a label left out."""
    from lectern.streaming.stateful import latest

    s = table(spark, sf_dir, "binoculars_scores", "row_id", "label", "register", "stylometric_score", "binoculars_score", "binoculars_score_neg", "scored_at")
    s = latest(s, "row_id", "scored_at").filter("label is not null")
    return s.select("row_id", "label", F.coalesce(F.nullif(F.lower(F.trim("register")), F.lit("")), F.lit("unknown")).alias("register"), "stylometric_score", "binoculars_score", "binoculars_score_neg")


#: The same rows in SQL, as a common table expression named s.
SCORES = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY scored_at DESC NULLS LAST, label DESC NULLS LAST, register DESC NULLS LAST, stylometric_score DESC NULLS LAST, binoculars_score DESC NULLS LAST, binoculars_score_neg DESC NULLS LAST) AS rn FROM binoculars_scores),
    s AS (SELECT row_id, label, coalesce(nullif(lower(trim(register)), ''), 'unknown') AS register, stylometric_score, binoculars_score, binoculars_score_neg FROM ranked WHERE rn = 1 AND label IS NOT NULL)
"""


from lectern.plans import queries_more, queries_rest, queries_scores, queries_state, queries_text  # noqa: E402, F401
