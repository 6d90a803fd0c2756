"""Reading archives and writing exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a folder of this machine does in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet and read back: lineage is cut, and what is computed from it twice is computed from the same rows."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_json_archive(spark: SparkSession, path: str, schema: str, alternatives: dict[str, list[str]] | None = None, whole: bool = False) -> DataFrame:
    """Records of JSON archives with the file they came from (origin), and raw: the item itself where it is a string and no object.

    A line is an array of items, one object or one string; with `whole` that is said of a file, which may then be laid out over many
    lines. Each key of `alternatives` takes the first of its columns that is not null. What is no JSON is left out.
    """
    lines = spark.read.text(path, wholetext=whole).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("origin"), F.trim(F.col("value"), F.lit(" \t\r\n")).alias("value"))
    listed = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    items = lines.select("origin", F.explode(F.from_json(listed, "array<variant>")).alias("item")).where("item IS NOT NULL")
    fields = [F.try_variant_get("item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in spark.createDataFrame([], schema).schema]
    df = items.select("origin", F.when(F.schema_of_variant("item") == "STRING", F.try_variant_get("item", "$", "string")).alias("raw"), *fields)
    for name, columns in (alternatives or {}).items():
        df = df.withColumn(name, F.coalesce(*[F.col(c) for c in columns]))
    return df


def insert_ignore(target: DataFrame, src: DataFrame, key: str) -> DataFrame:
    """target, and those rows of src whose key it does not have."""
    return target.unionByName(src.join(target.select(key), key, "left_anti"))


def write_distinct_json(df: DataFrame, path: str, key: list[str], order: list[Column]) -> None:
    """One JSON line per key: the first row by `order`."""
    first = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    df.withColumn("_n", first).where("_n = 1").drop("_n").write.json(path)


def export_partitioned(df: DataFrame, path: str, by: str, key: str, parts: int = 16) -> None:
    """Parquet partitioned by a column; rows of a value are brought together first, in `parts` tasks by a hash of the key, so that a value makes few files and a frequent one is not one task's."""
    df.repartition(by, F.pmod(F.xxhash64(key), F.lit(parts))).write.partitionBy(by).parquet(path)


def ranged(df: DataFrame, *key: str | Column) -> DataFrame:
    """df dealt into ranges of a key, with _p, the number of the range; stored, so that ranges are the same whenever they are read."""
    return stored(df.repartitionByRange(*key).withColumn("_p", F.spark_partition_id()), "ranges")


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """df with n, the 1-based place of each row by key, without a single-task window: ranges are numbered on their own and shifted by the sizes of those before."""
    rows = ranged(df, key)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    shift = sizes.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(key))
    return rows.join(F.broadcast(shift), "_p").withColumn("n", inside + F.col("_s")).drop("_p", "_s")  # a row per partition is broadcast


def chunk_ids(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with chunk: 1 for the first `size` rows by key, and so on."""
    return number_rows(df, key).withColumn("chunk", F.floor((F.col("n") - 1) / size) + 1).drop("n")


def iso_instant(*values: Column) -> Column:
    """The first of the values that is no empty text, as an instant of ISO 8601 in UTC; null where it is none at all, never the present."""
    first = F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(first).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def address_chunks(df: DataFrame, key: str, slug: Column, changed: Column, size: int = 2000) -> DataFrame:
    """(key, chunk, slug, last_modified) of all rows, in chunks of `size` by key."""
    return chunk_ids(df.select(key, slug.alias("slug"), changed.alias("last_modified")), key, size)


def chunk_list(chunks: DataFrame, key: str) -> DataFrame:
    """A row per chunk: its rows, first and last key, and the latest change in it (null where none is known)."""
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.max("last_modified").alias("last_modified"))
