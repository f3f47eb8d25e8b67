"""Sentences packed into documents: rows of a group, in order, are joined until a document has enough words; what is left at the group's end is dropped.

The fold is sequential within a group by definition; groups are folded side by side over sorted partitions,
batch by batch, so a task holds one unfinished document, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, group: str, order: str | list[str], text: str, least_words: int = 150) -> DataFrame:
    """(group, part, text): null and empty texts are passed over."""
    by = [order] if isinstance(order, str) else order
    place = F.struct(*(F.col(c) for c in by)).alias("order")
    rows = df.select(F.col(group).cast("string").alias("group"), place, F.col(text).alias("text"))
    rows = rows.filter("text is not null and text <> ''")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, part, words, held = None, 0, 0, []
        for pdf in batches:
            out = []
            for g, t in zip(pdf["group"], pdf["text"]):
                if g != current:
                    current, part, words, held = g, 0, 0, []
                held.append(t)
                words += len(t.split())
                if words >= least_words:
                    out.append((g, part, " ".join(held).strip()))
                    part, words, held = part + 1, 0, []
            yield pd.DataFrame(out, columns=["group", "part", "text"])

    sorted_ = rows.repartition("group").sortWithinPartitions("group", "order").select("group", "text")
    return sorted_.mapInPandas(fold, "group string, part int, text string")
