"""Streams over the driver's tables, run to their end, against the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import analytics as A
from quillspark.operators import ingest as I
from quillspark.plans.analytics import RATE_SQL, S_SQL
from quillspark.plans.registry import query, table
from quillspark.sources.files import scratch_dir
from quillspark.streaming import jobs


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return jobs.read_stream(spark, f"{d}/{name}.parquet")


@query(
    "sync_since",
    """WITH r AS (SELECT o_orderkey, o_orderdate, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 500 + 1 AS page, count(*) OVER () AS total FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-06-01', 100))
SELECT page, count(*) AS n, max(page) * 500 < max(total) AS has_more, CAST(max(o_orderdate) AS VARCHAR) AS next_time, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS next_id, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r GROUP BY page""",
)
def sync_since(spark: SparkSession, d: str) -> DataFrame:
    """All pages that a client gets who begins at a cursor of (time, key) and goes on with the cursor of each page, until there are no more."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("changed"))
    rows = I.sync_pages(orders, "changed", "o_orderkey", ("1996-06-01", 100), 500)
    pages = I.sync_summary(rows, "changed", "o_orderkey").join(rows.groupBy("page").agg(F.sum("o_orderkey").alias("keys")), "page")
    return pages.select("page", "n", "has_more", F.col("next_time").cast("string").alias("next_time"), "next_id", "keys")


@query("stream_ingest", "SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 20 GROUP BY 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Validated, hashed and upserted by hash as batches come."""
    rows = stream(spark, d, "documents").where(F.length("text") >= 20).select(X.content_hash(F.col("text")).alias("hash"), "doc_id")
    return jobs.table_of(rows, scratch_dir(spark, "ingest"), ["hash"])


@query("stream_visitor_state", "SELECT user_id, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen, count(*) AS views, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def stream_visitor_state(spark: SparkSession, d: str) -> DataFrame:
    return jobs.visitor_state(stream(spark, d, "events"), scratch_dir(spark, "visitors")).withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@query("stream_active_users", "WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * back AS start, user_id FROM events, (VALUES (0), (1)) AS b(back)) SELECT CAST(start AS VARCHAR) AS start, count(DISTINCT user_id) AS visitors FROM w GROUP BY ALL")
def stream_active_users(spark: SparkSession, d: str) -> DataFrame:
    return jobs.active_users(stream(spark, d, "events"), scratch_dir(spark, "active"), "1 day", "12 hours", "1 hour").withColumn("start", F.col("start").cast("string"))


@query("click_attribution", "SELECT v.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS last_click, count(c.event_id) AS n_clicks FROM events v LEFT JOIN events c ON c.event_type = 'click' AND c.user_id = v.user_id AND c.ts > v.ts AND c.ts <= v.ts + INTERVAL 30 MINUTE WHERE v.event_type = 'view' GROUP BY v.event_id")
def click_attribution(spark: SparkSession, d: str) -> DataFrame:
    """All views, with the last click in time, from a stream's state alone."""
    return jobs.click_attribution(stream(spark, d, "events"), scratch_dir(spark, "clicks"))


@query("stream_rate_flags", RATE_SQL)
def stream_rate_flags(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rate_flags(stream(spark, d, "events"), scratch_dir(spark, "rates"), "6 hours", 2, "1 hour").withColumn("start", F.col("start").cast("string"))


@query("stream_zero_results", f"WITH {S_SQL} SELECT sha256(lower(query)) AS query_hash, substr(sha256(CAST(user_id AS VARCHAR) || 'salt'), 1, 32) AS session_hash FROM s WHERE result_count = 0")
def stream_zero_results(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    zero = stream(spark, d, "events").where((F.col("event_type") == "view") & (k % 10 == 0)).select(F.concat(F.lit("q"), k.cast("string")).alias("query"), "user_id")
    return jobs.run(A.anonymous(zero, "query", "user_id", "salt"), scratch_dir(spark, "zero"))
