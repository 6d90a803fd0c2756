"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of a source's keys for each factor of e. The logarithm of an exponential variable has the same shape at every rate, so
#: whatever the weights are, no range has more than 1 / (e * RANGES) of a source's documents, which is what one task sorts.
RANGES = 512
#: A source is taken at most this many times.
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cleanliness(text: Column, words: Column) -> Column:
    """A document's default quality weight, 0.05 to 1: symbols of markup and shouting, per word, lower it."""
    marks = F.coalesce(F.regexp_count(text, F.lit("[#$%&*|!]")), F.lit(0))
    return F.greatest(F.lit(0.05), F.lit(1.0) - marks / F.greatest(words, F.lit(1)))


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Targets of (source, source_size): weights 1, 2, 3, repeating, by code point, null last; a target stops at `most` times its size.

    Resharing the excess by weight until nothing is above its limit ends where every source that is below its limit has the
    same target per weight; sorted by limit per weight, that level follows from running sums. One row per source goes through
    the global window, never documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("limit", F.lit(most) * F.col("source_size"))
    by_limit = W.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    stepped = ranked.withColumn("level", level).withColumn("capped", F.col("limit") / F.col("weight") <= F.col("level"))
    # the first source below its limit has the highest level of those
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy())
    return stepped.withColumn("final", final).select("source", "source_size", "weight", F.when(F.col("capped") | F.col("final").isNull(), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def _mix(docs: DataFrame, keep: list[str], id_col: str, source_col: str, text_col: str, quality_weight: Column | None, seed: str) -> DataFrame:
    """See mix_sources; the columns of `keep` are returned as _keep_<name>."""
    text, size = F.col(f"`{text_col}`"), F.col("size")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), (quality_weight if quality_weight is not None else cleanliness(text, n_words(text))).cast("double").alias("_w"), *[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep])
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    weight = F.greatest(F.lit(0.001), F.least(F.lit(1000.0), F.coalesce("_w", F.lit(0.05))))
    rows = rows.withColumn("_key", -F.log(u) / weight).drop("_w").withColumn("_range", F.floor(F.log("_key") * RANGES).cast("int"))
    # the source as a key that is never null, so that sorting and joining deal rows alike and only once
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    by_range = stored(rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum")))
    targets = source_targets(by_range.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    begun = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        by_range.withColumn("_begin", F.coalesce(F.sum("_sum").over(begun), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")))
        .withColumn("_epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
        .withColumn("_budget", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
        .select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), "_range", "_begin", "source_size", "target", "_epochs", "_budget")
    )
    inside = W.partitionBy("_s", "_range").orderBy("_key", "_id", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_budget") - F.col("_begin") - F.col("_before")
    return (
        rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges, ["_s", "_range"])
        .withColumn("taken", (F.col("_epochs") * size + F.greatest(F.lit(0), F.least(size, left))).cast("long"))
        .select("_id", "size", "source_size", "target", "taken", *[f"_keep_{c}" for c in keep])
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality_weight: Column | None = None, seed: str = "mix") -> DataFrame:
    """How many words a mix takes of each document.

    Returns id_col, size, source_size, target, taken. A source's target beyond whole epochs is
    filled by weighted sampling without replacement: each document's key is an exponential variable divided by its quality
    weight, keys are sorted within the source, and sizes are summed until the budget is met. The document at the border gives
    the words that are still missing, so a source's words come within one word of its target.

    Keys are dealt into ranges of their logarithm; sums of ranges give where each begins, and only a range is sorted by one
    task, however the weights are spread. The key depends on id, seed and weight alone, so reruns agree.

    Defined cases: null text has size 0 and takes 0; null source is a source of its own, last in order; null weight counts as
    0.05, weights are held to 0.001 .. 1000; rows with equal id and size share a key and are taken one after the other; an empty
    table gives an empty result; columns not named are ignored.
    """
    return _mix(docs, [], id_col, source_col, text_col, quality_weight, seed).withColumnRenamed("_id", id_col)


def take_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality_weight: Column | None = None, seed: str = "mix") -> DataFrame:
    """The mix itself: a document once per complete take, and for the document at a source's border its leading words.

    Keeps the columns of docs. A document that the mix does not take is left out, one of size 0 too.
    """
    mixed = _mix(docs, docs.columns, id_col, source_col, text_col, quality_weight, seed)
    whole = F.array_repeat(F.lit(None).cast("long"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    part = F.when((F.col("size") > 0) & (F.col("taken") % F.col("size") > 0), F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<long>"))
    rows = mixed.withColumn("_words", F.explode(F.concat(whole, part)))
    leading = F.expr(f"array_join(slice(regexp_extract_all(`_keep_{text_col}`, '\\\\s*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(_words as int)), '')")
    text = F.when(F.col("_words").isNull(), F.col(f"`_keep_{text_col}`")).otherwise(leading)
    return rows.select(*[(text if c == text_col else F.col(f"`_keep_{c}`")).alias(c) for c in docs.columns])
