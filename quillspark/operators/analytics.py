"""Search telemetry: visitors, searches, clicks, latency, quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.ingest import first_rule
from quillspark.sources.files import ranged

# Ordered (pattern, name) rules for user agents, and what is said where no rule fits or there is no agent.
DEVICES = [("(?i)ipad|tablet|playbook|silk|(android(?!.*mobile))", "Tablet"), ("(?i)mobile|iphone|ipod|android|blackberry|opera mini|opera mobi|windows phone", "Mobile")]
SYSTEMS = [("(?i)windows", "Windows"), ("(?i)macintosh|mac os x", "macOS"), ("(?i)android", "Android"), ("(?i)iphone|ipad|ipod", "iOS"), ("(?i)linux", "Linux")]
BROWSERS = [("(?i)edg", "Edge"), ("(?i)opera|opr", "Opera"), ("(?i)chrome|crios", "Chrome"), ("(?i)firefox|fxios", "Firefox"), ("(?i)safari", "Safari")]
DEVICE, SYSTEM, BROWSER, UNKNOWN = "Desktop", "Unknown", "Chrome", "Unknown"


def parse_user_agent(ua: Column) -> dict[str, Column]:
    """device, os and browser by the first rule that fits."""
    none = F.coalesce(ua, F.lit("")) == ""
    return {
        "device": F.when(none, DEVICE).otherwise(first_rule(ua, DEVICES, DEVICE)),
        "os": F.when(none, UNKNOWN).otherwise(first_rule(ua, SYSTEMS, SYSTEM)),
        "browser": F.when(none, UNKNOWN).otherwise(first_rule(ua, BROWSERS, BROWSER)),
    }


def ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole of two whole numbers, rounded half up in whole numbers, so that no order of summing shows; null where there is nothing."""
    scale = 10**places
    rounded = F.call_function("div", 2 * scale * part + whole, 2 * whole)
    return F.when(whole > 0, rounded / F.lit(float(scale)))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """part of whole in percent; null where there is nothing."""
    return F.round(F.when(whole > 0, part * 100.0 / whole), places)


def since(df: DataFrame, ts: str, as_of: str, days: int | None) -> DataFrame:
    """Rows up to as_of, of the last `days` days, or all of them."""
    end = F.lit(as_of).cast("timestamp")
    df = df.where(F.col(ts) <= end)
    return df if days is None else df.where(F.col(ts) > end - F.make_dt_interval(F.lit(days)))


def searches(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Views as searches: event_id, ts, user_id, query, result_count, clicked_position (null without a click of the user within `minutes`), took_ms.

    Clicks are summed up per user and stretch of that length. A view is followed by a click in time if the last click of its own
    stretch is later, or the first of the next stretch is near enough; so no view meets all clicks of its user.
    """
    width = minutes * 60_000_000
    stretch = lambda ts: F.floor(F.unix_micros(ts) / width)
    k = F.get_json_object("props", "$.k").cast("int")
    v = events.where("event_type = 'view'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", k.alias("k"), "value").withColumn("_b", stretch("ts"))
    c = events.where("event_type = 'click'").select("user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id", stretch("ts").alias("_b")).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    s = v.join(c.select("user_id", "_b", "_last"), ["user_id", "_b"], "left").join(c.select("user_id", (F.col("_b") - 1).alias("_b"), F.col("_first").alias("_next")), ["user_id", "_b"], "left")
    clicked = F.coalesce(F.col("_last") > F.col("ts"), F.lit(False)) | F.coalesce(F.unix_micros("_next") <= F.unix_micros("ts") + width, F.lit(False))
    return s.select("event_id", "ts", "user_id", F.concat(F.lit("q"), F.col("k").cast("string")).alias("query"), F.when(F.col("k") % 10 == 0, 0).otherwise(F.col("k")).alias("result_count"), F.when(clicked, F.col("k") % 12 + 1).alias("clicked_position"), F.col("value").alias("took_ms"))


def query_stats(s: DataFrame) -> DataFrame:
    """Per query: searches, searchers, results, clicks, and averages that are made of whole numbers (latency in millionths)."""
    n, clicks = F.count("*"), F.count("clicked_position")
    micros = F.sum(F.round(F.col("took_ms") * 1_000_000).cast("long"))
    return s.groupBy("query").agg(
        n.alias("n"), F.countDistinct("user_id").alias("searchers"), ratio(F.sum(F.col("result_count").cast("long")), n, 2).alias("avg_results"),
        clicks.alias("clicks"), ratio(100 * clicks, n, 1).alias("ctr"), ratio(micros, 1_000_000 * F.count("took_ms"), 3).alias("avg_ms"),
    )


def nearest_rank(values: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """(share, value) at row round(share * n) of the sorted values, 1 at least.

    Counts per value are dealt into ranges; sums of ranges tell which one a row is in, and only that is cumulated.
    """
    counts = ranged(values.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("c")), "value")
    sums = counts.groupBy("_p").agg(F.sum("c").alias("s"))  # a row per range
    run = sums.withColumn("hi", F.sum("s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("s").over(W.partitionBy()))
    wanted = run.withColumn("share", F.explode(F.array(*[F.lit(x) for x in shares]))).withColumn("row", F.greatest(F.round(F.col("share") * F.col("n")), F.lit(1)))
    found = wanted.where((F.col("row") <= F.col("hi")) & (F.col("row") > F.col("hi") - F.col("s"))).select("_p", "share", "row", (F.col("hi") - F.col("s")).alias("begin"))
    inside = counts.join(F.broadcast(found), "_p")  # a row per share
    upto = inside.withColumn("end", F.col("begin") + F.sum("c").over(W.partitionBy("_p", "share").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
    return upto.where((F.col("row") <= F.col("end")) & (F.col("row") > F.col("end") - F.col("c"))).select("share", "value")


def visitor_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("views"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


def keep_latest_distinct(events: DataFrame, part: str, key: str, ts: str, n: int) -> DataFrame:
    """Per part the n keys that came last, each with its last time."""
    last = events.groupBy(part, key).agg(F.max(ts).alias(ts))
    return last.withColumn("_n", F.row_number().over(W.partitionBy(part).orderBy(F.desc(ts), key))).where(F.col("_n") <= n).drop("_n")


def window_counts(events: DataFrame, key: str, ts: str, width: str, limit: int) -> DataFrame:
    """(key, window start, n) of windows with more than `limit` events."""
    per = events.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return per.where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


def anonymous(events: DataFrame, query: str, session: str, salt: str) -> DataFrame:
    """Hashes of the query and, salted, of the session; neither is kept."""
    return events.select(F.sha2(F.lower(query), 256).alias("query_hash"), F.substring(F.sha2(F.concat(F.col(session).cast("string"), F.lit(salt)), 256), 1, 32).alias("session_hash"))


def week_id(ts: Column) -> Column:
    """YYYY-Wnn: days since January 1 and the weekday of the date itself (Sunday 1), over seven, rounded up."""
    week = F.ceil((F.dayofweek(ts) + F.dayofyear(ts) - 1) / 7.0).cast("int").cast("string")
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))
