"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import ascii_lower, stored

#: Leading characters of the text in the sort key that the splitters are sampled from; a bound on what the driver gets, not on what is compared.
KEY_CHARS = 24


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition: numbers the runs of equal texts, each text compared in full with the one before.

    Only the first and the last run of a partition can go on in another one, so only their texts are kept on.
    """
    run, last, held = -1, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("_norm")
        new = pa.concat_arrays([pa.array([last is None or last != text[0].as_py()]), pc.not_equal(text[1:], text[:-1])])
        number = pc.add(pc.cumulative_sum(pc.cast(new, pa.int64())), run)
        run, last = number[len(number) - 1].as_py(), text[len(text) - 1].as_py()
        edge = pc.if_else(pc.and_(new, pc.equal(number, 0)), text, pa.scalar(None, text.type))
        out = pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_sha"), batch.column("_part"), number, edge], names=["_id", "_sha", "_part", "_run", "_edge"])
        if held is not None:
            yield held
        held = out
    if held is not None:  # the last row carries its run's text
        edges = held.column("_edge").to_pylist()
        edges[-1] = last
        yield held.set_column(4, "_edge", pa.array(edges, pa.string()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z: one row per input row, dropped ones too.

    Returns id_col, keep_id (smallest or, with keep="max", largest id of the group), group_size, kept, text_sha256.

    Rows are range-partitioned by sampled splitters and sorted on disk by (leading characters, a hash, full text, id),
    so equal texts are adjacent; neighbours are compared in full. The id in the key lets a hot text spread over many
    partitions; a group that crosses a border is joined again by the texts of the border runs (two a partition at most).
    Each run is summed up where it is before runs are joined, so a group of any size costs a row per partition, and its
    rows get the result back by partition and run.

    Defined cases: a null text counts as empty; empty texts are equal to each other; a row repeated with the same id stays
    once per repetition, each marked kept if its id is the kept one; a null id is never kept while the group has another;
    an empty table gives an empty result; columns other than the two named are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), ascii_lower(F.col(f"`{text_col}`")).alias("_norm")).withColumn("_sha", F.sha2("_norm", 256))
    # what orders texts that begin alike, so that sampled keys stay small; full texts are compared all the same
    key = [F.substring("_norm", 1, KEY_CHARS), F.xxhash64("_norm"), F.col("_id")]
    id_type = rows.schema["_id"].dataType
    sorted_rows = (
        rows.repartitionByRange(*key)
        .withColumn("_part", F.spark_partition_id())
        .sortWithinPartitions(F.substring("_norm", 1, KEY_CHARS), F.xxhash64("_norm"), "_norm", "_id")
    )
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_sha", T.StringType()), T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_edge", T.StringType())])
    numbered = stored(sorted_rows.mapInArrow(_number_runs, schema))
    pick = {"min": F.min, "max": F.max}[keep]
    runs = stored(numbered.groupBy("_part", "_run").agg(pick("_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("_edge").alias("_edge")))
    # runs at the borders of partitions, two a partition at most, joined by their full text
    edges = runs.where(F.col("_edge").isNotNull())
    whole = edges.groupBy("_edge").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    joined = edges.select("_part", "_run", "_edge").join(whole, "_edge").select("_part", "_run", "keep_id", "group_size")
    groups = runs.where(F.col("_edge").isNull()).select("_part", "_run", "keep_id", "group_size").unionByName(joined)
    return numbered.select("_part", "_run", "_id", "_sha").join(groups, ["_part", "_run"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("_sha").alias("text_sha256")
    )


__all__ = ["exact_dedup"]
