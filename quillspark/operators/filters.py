"""Predicates and projections."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def match_filters(queries: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
    """(query, row) pairs where each filter want_<col> of the query is equal; null, '' and 'All' are no filter.

    Queries are split by which filters they set, so each part is an equi-join. A query without any filter has all rows, so what is
    given as rows should be small: values with their counts where counts are asked for, not documents.
    """
    for c in cols:
        want = F.col(f"want_{c}")
        queries = queries.withColumn(f"want_{c}", F.when(~want.isin("", "All"), want))
    parts = []
    for mask in range(2 ** len(cols)):
        used = [c for i, c in enumerate(cols) if mask >> i & 1]
        own = queries
        for c in cols:
            own = own.where(F.col(f"want_{c}").isNotNull() if c in used else F.col(f"want_{c}").isNull())
        parts.append(own.join(rows, [F.col(f"want_{c}") == F.col(c) for c in used]) if used else own.crossJoin(rows))
    return reduce(DataFrame.unionByName, parts)


def contains_any(cols: list[str], needle: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    return reduce(or_, [F.contains(F.lower(F.col(c)), F.lit(needle.lower())) for c in cols])


def matches_any(cols: list[str], words: list[str]) -> Column:
    pattern = "(?i)" + "|".join(re.escape(w) for w in words)
    return reduce(or_, [F.col(c).rlike(pattern) for c in cols])


def resolve_aliases(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(value, canonical) by the first rule that fits: kind 'name' is equality, 'keyword' is a substring. Rules are a dictionary of bounded size."""
    v = values.select("value").distinct()
    low = F.lower("value")
    fits = ((F.col("kind") == "name") & (low == F.col("term"))) | ((F.col("kind") == "keyword") & F.contains(low, F.col("term")))
    return v.join(F.broadcast(rules), fits).groupBy("value").agg(F.min_by("canonical", "rule_no").alias("canonical"))


def parse_string_array(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def resolve_ids(requests: DataFrame, docs: DataFrame, aliases: DataFrame | None = None, prefix: int = 6) -> DataFrame:
    """(request, doc_id, rule) by the first rule that fits: 1 the id, of what an alias (request, target) stands for; 2 a slug, by the hash digits behind
    its last hyphen; 3 the id, where an alias stood for another; 4 the full hash; 5 the beginning of a hash, at least `prefix` digits
    of what is asked for.

    Each rule is an equi-join; those of beginnings join on a fixed length and filter on the rest.
    """
    r, d = requests.select("request").distinct(), docs.select("doc_id", "hash")
    r = r.join(aliases.select("request", "target"), "request", "left") if aliases is not None else r.withColumn("target", F.lit(None).cast("string"))
    asked = F.trim(F.coalesce("target", "request"))
    suffix = F.regexp_extract(asked, r"-([0-9a-f]{8,})$", 1)
    digits = F.lower(F.regexp_replace(F.when(suffix != "", suffix).otherwise(asked), "[^0-9a-fA-F]", ""))

    def by_id(rows: DataFrame, key: Column, rule: int) -> DataFrame:
        return rows.withColumn("_k", key).join(d, F.col("_k") == F.col("doc_id").cast("string")).select("request", "doc_id", F.lit(rule).alias("rule"))

    def by_beginning(rows: DataFrame, key: Column, rule: int) -> DataFrame:
        begun = rows.withColumn("_k", key).where(F.length("_k") >= prefix).withColumn("_b", F.substring("_k", 1, prefix))
        return begun.join(d.withColumn("_b", F.substring("hash", 1, prefix)), "_b").where(F.startswith("hash", "_k")).select("request", "doc_id", F.lit(rule).alias("rule"))

    full = r.withColumn("_k", F.lower(asked)).join(d, F.col("_k") == F.col("hash")).select("request", "doc_id", F.lit(4).alias("rule"))
    every = [by_id(r, asked, 1), by_beginning(r.where(suffix != ""), suffix, 2), by_id(r.where(F.col("target").isNotNull()), F.trim("request"), 3), full, by_beginning(r, digits, 5)]
    first = F.row_number().over(W.partitionBy("request").orderBy("rule", "doc_id"))
    return reduce(DataFrame.unionByName, every).withColumn("_n", first).where("_n = 1").drop("_n")


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null is broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return F.filter(broken, lambda x: x.isNotNull())


def length_within(value: Column, least: int, most: int) -> Column:
    """A text that is there and has so many characters."""
    return F.coalesce(F.length(value).between(least, most), F.lit(False))


def list_within(values: Column, most: int, longest: int) -> Column:
    """A list of up to `most` texts of up to `longest` characters; none at all will do, a null in it won't."""
    return values.isNull() | ((F.size(values) <= most) & F.forall(values, lambda v: F.coalesce(F.length(v) <= longest, F.lit(False))))


def is_sha256(value: Column, required: bool = True) -> Column:
    """64 hexadecimal digits in any case, with space around them or not."""
    fits = F.coalesce(F.trim(value, F.lit(" \t\n\x0b\f\r")).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    return fits if required else value.isNull() | fits


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("reasons", reasons(rules)).withColumn("valid", F.size("reasons") == 0)


# Hosts and IPv4 ranges that are not public; a number without four parts stands for an address too.
NOT_PUBLIC = (
    "localhost", "::1", r"metadata\.google\.internal",
    r"(?:0|10|127)(?:\.\d{1,3}){3}", r"(?:169\.254|192\.168|172\.(?:1[6-9]|2\d|3[01]))(?:\.\d{1,3}){2}",
    r"(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+)){0,2}",
)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def is_safe_public_url(url: Column) -> Column:
    """http(s) with a host that is not local, private, link-local or a metadata service."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"[\[\]]", "")
    return F.coalesce(url.rlike(r"^(?i:https?)://") & (host != "") & ~host.rlike(f"^(?:{'|'.join(NOT_PUBLIC)})$"), F.lit(False))


def crawl_status(url: Column, status: Column, body: Column, phrases: list[str]) -> Column:
    """What is wrong with a crawled page: invalid_url, gone, server_error, soft_404, or null."""
    soft = reduce(or_, [F.contains(F.lower(F.substring(body, 1, 3000)), F.lit(p)) for p in phrases])
    return F.when(~url.rlike("^https?://"), "invalid_url").when(status.isin(404, 410), "gone").when(status >= 500, "server_error").when(soft, "soft_404")


def query_parameter(url: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_parse_url(url, F.lit("QUERY"), F.lit(n)) for n in names])


def truncate(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, n) for c, n in limits.items()})
