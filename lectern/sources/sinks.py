"""Sinks: parquet, CSV and JSON results, append with deduplication, tables for reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.corpus import first_of_each


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, replacing what is there; partitioned by columns if any are named."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_new(df: DataFrame, path: str, key: str, order: str) -> int:
    """Rows whose key is new are added to a parquet table, the first of each key; the table is written beside the old one and exchanged, since Spark can't overwrite what it reads. Returns the row count."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    both = df
    if fs.exists(old):
        before = spark.read.parquet(path)
        both = before.withColumn("_age", F.lit(0)).unionByName(df.withColumn("_age", F.lit(1)), allowMissingColumns=True)
        both = first_of_each(both, [F.col(key)], [F.col("_age"), F.col(order)]).drop("_age")
    else:
        both = first_of_each(df, [F.col(key)], [F.col(order)])
    both.write.parquet(new.toString())
    if fs.exists(old):
        fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)
    return spark.read.parquet(path).count()


def save_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result table as Markdown, numbers to four places; the first ``most`` rows."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


#: Characters with a meaning in LaTeX.
LATEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(df: DataFrame, caption: str = "", most: int = 1000) -> str:
    """A small result table as a LaTeX table, numbers to four places; the first ``most`` rows."""
    plain = lambda v: "".join(LATEX.get(c, r"\textbackslash{}" if c == "\\" else c) for c in str(v))
    show = lambda v: "--" if v is None else f"{v:.4f}" if isinstance(v, float) else plain(v)
    rows = [" & ".join(map(show, r)) + r" \\" for r in df.limit(most).collect()]
    head = " & ".join(map(plain, df.columns)) + r" \\"
    lines = [r"\begin{table}", r"\centering", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *rows]
    lines += [r"\hline", r"\end{tabular}", *([rf"\caption{{{plain(caption)}}}"] if caption else []), r"\end{table}"]
    return "\n".join(lines)
