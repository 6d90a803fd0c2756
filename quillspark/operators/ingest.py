"""Keys, dedup and upserts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.sources.files import number_rows, ranged, stored


def dedup_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def drop_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key, in any case, is not known."""
    return df.withColumn("_k", F.lower(key)).join(known.select(F.lower(key).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def cut_at_known_run(df: DataFrame, part: str, order: list[Column], known: str, run: int = 8) -> DataFrame:
    """Rows of each part before the first `run` consecutive known ones, in order. A null is not known.

    Rows are dealt into ranges of part and order, so that a part with most rows is no task's alone. Ranges are looked at on their own;
    how long the run is that goes into a range, and how many rows stand before it, follow from a row per part and range.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))
    rows = ranged(df.withColumn("_k", key).withColumn("_known", F.coalesce(F.col(known), F.lit(False))), "_k", *order)
    inside = W.partitionBy("_k", "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_i", F.count("*").over(inside)).withColumn("_gap", F.max(F.when(~F.col("_known"), F.col("_i"))).over(inside))
    each = placed.groupBy("_k", "_p").agg(F.count("*").alias("_n"), F.max(F.when(~F.col("_known"), F.col("_i"))).alias("_last"))
    by = W.partitionBy("_k").orderBy("_p")
    # a range with an unknown row begins a new run; ranges that are known all through add to it
    held = each.withColumn("_before", F.coalesce(F.sum("_n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_new", F.count("_last").over(by.rowsBetween(W.unboundedPreceding, 0)))
    upto = F.sum(F.col("_n") - F.coalesce("_last", F.lit(0))).over(W.partitionBy("_k", "_new").orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    ranges = stored(held.withColumn("_run", upto).withColumn("_carry", F.coalesce(F.lag("_run").over(by), F.lit(0))).select("_k", "_p", "_before", "_carry"))
    counted = placed.join(ranges, ["_k", "_p"]).withColumn("_row", F.col("_before") + F.col("_i")).withColumn("_len", F.col("_i") - F.coalesce("_gap", -F.col("_carry")))
    ends = counted.where(F.col("_known") & (F.col("_len") >= run)).groupBy("_k").agg(F.min("_row").alias("_end"))
    return counted.join(ends, "_k", "left").where(F.col("_end").isNull() | (F.col("_row") <= F.col("_end") - run)).select(*df.columns)


def classify(target: DataFrame, src: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, status) of each row of src: inserted, updated or skipped. A key that target has more than once counts by its first row by all columns."""
    old = dedup_first(target, [key], [F.col(c) for c in target.columns]).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in compare])
    changed = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in compare])
    return src.join(old, F.col(key) == F.col("_key"), "left").select(key, F.when(F.col("_key").isNull(), "inserted").when(changed, "updated").otherwise("skipped").alias("status"))


def upsert(target: DataFrame, src: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """target with the rows of src in place of those of the same key. Of rows of one key in src the first by all columns counts.

    Columns in `keep` (where a row comes from, when it was made) are as target has them where the key is there already, null or not;
    of a key that target has more than once the first row by all columns is meant.
    """
    new = dedup_first(src, [key], [F.col(c) for c in src.columns])
    if keep:
        old = dedup_first(target, [key], [F.col(c) for c in target.columns]).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in keep])
        known = F.col("_key").isNotNull()
        new = new.join(old, F.col(key) == F.col("_key"), "left").select(*[F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in src.columns])
    return target.join(new.select(key), key, "left_anti").unionByName(new)


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def sync_pages(df: DataFrame, changed: str, key: str, since: tuple | None, limit: int) -> DataFrame:
    """Rows after a cursor (time, key) with page: 1 for the first `limit` by time and key, and so on, as a client gets them that goes on
    with the cursor of each page. Rows of one time are told apart by key, so none is lost or given twice where a page ends among them.

    Null times are never given. All pages come from one numbering over ranges, whatever their number.
    """
    at, rows = F.col(changed), df.where(F.col(changed).isNotNull())
    if since is not None:
        time, last = F.lit(since[0]).cast(df.schema[changed].dataType), F.lit(since[1])
        rows = rows.where((at > time) | ((at == time) & (F.col(key) > last)))
    numbered = number_rows(rows.withColumn("_order", F.struct(at, F.col(key))), "_order")
    return numbered.select(*df.columns, (F.floor((F.col("n") - 1) / limit) + 1).alias("page"))


def sync_summary(pages: DataFrame, changed: str, key: str) -> DataFrame:
    """(page, n, has_more, next_time, next_id) of sync_pages: what a client is told beside its rows."""
    per = pages.groupBy("page").agg(F.count("*").alias("n"), F.max(F.struct(changed, key)).alias("last"))
    last = per.agg(F.max("page").alias("_end"))
    return per.crossJoin(F.broadcast(last)).select("page", "n", (F.col("page") < F.col("_end")).alias("has_more"), F.col("last")[changed].alias("next_time"), F.col("last")[key].alias("next_id"))  # one row


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern is found."""
    out = None
    for pattern, name in rules:
        out = (F.when if out is None else out.when)(text.rlike(pattern), name)
    return out.otherwise(default)


def canonical_source(source: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = None
    for part, name in rules:
        out = (F.when if out is None else out.when)(F.contains(F.lower(source), F.lit(part)), name)
    return out.otherwise(default)


def split_qa(text: Column) -> dict[str, Column]:
    """First line as the question, the rest as the answer, a date among the last three lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    last = F.filter(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3), lambda x: x.rlike(r"\d{4}"))
    return {
        "question": F.when(F.size(lines) > 0, lines[0]).otherwise(""),
        "answer": F.when(F.size(lines) > 1, F.array_join(F.slice(lines, 2, F.size(lines)), "\n")).otherwise(""),
        "date_line": F.when(F.size(last) > 0, F.element_at(last, -1)),
    }


def fill(value: Column, default: Column) -> Column:
    return F.coalesce(F.when(F.trim(value) != "", F.trim(value)), default)
