"""Labelled rows to learn from: which, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are learned from; a bound on what comes to the driver, and the same at every size of the input.
SAMPLE = 8000


def held_out(doc_id: Column) -> Column:
    """One in five ids is kept for testing. A null id is never learned from, so it counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample_labels(labels: DataFrame, value_col: str, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Up to `sample` rows (doc_id, value) that may be learned from, chosen by a hash of the id; rows with null values are left out."""
    rows = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{value_col}`").cast("int").alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "value").limit(sample)


def sampled_texts(docs: DataFrame, labels: DataFrame, value_col: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(doc_id, text, value) of the sample. Its rows are broadcast: there are `sample` of them at most."""
    chosen = F.broadcast(sample_labels(labels, value_col, id_col, sample))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "doc_id")
