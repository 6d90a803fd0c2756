"""Telemetry, reports and joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import analytics as A
from quillspark.operators.retrieval import top_k
from quillspark.plans.registry import query, table

AS_OF = "2024-01-25 00:00:00"
S_SQL = """v AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events WHERE event_type = 'view'),
cl AS (SELECT DISTINCT v.event_id FROM v JOIN events c ON c.event_type = 'click' AND c.user_id = v.user_id AND c.ts > v.ts AND c.ts <= v.ts + INTERVAL 30 MINUTE),
s AS (SELECT event_id, ts, user_id, 'q' || k AS query, CASE WHEN k % 10 = 0 THEN 0 ELSE k END AS result_count, CASE WHEN cl.event_id IS NOT NULL THEN k % 12 + 1 END AS clicked_position, value AS took_ms FROM v LEFT JOIN cl USING (event_id))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def searches(spark: SparkSession, d: str) -> DataFrame:
    return A.searches(events(spark, d))


# Browsers, systems and devices of agents that events are given, as the tables have none; which one follows from the event.
_UA = ["Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) Version/17 Mobile Safari/604", "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120", "Mozilla/5.0 (X11; Linux x86_64) Firefox/121", "Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/120 Mobile", "Mozilla/5.0 (Linux; Android 13; Tab) Chrome/119", "Opera/9 (Windows Phone) OPR/7", "curl/8", "Mozilla/5.0 (Mobile; Android 12; rv:102) Firefox/102"]
_UA_SQL = "[" + ", ".join(f"'{u}'" for u in _UA) + f"][CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(_UA) + 1} + 1]"


@query(
    "parse_user_agent",
    f"""WITH u AS (SELECT event_id, lower({_UA_SQL}) AS a FROM events)
SELECT event_id, CASE WHEN a IS NULL THEN 'Desktop' WHEN a LIKE '%ipad%' OR a LIKE '%tablet%' OR a LIKE '%playbook%' OR a LIKE '%silk%' OR (a LIKE '%android%' AND NOT contains(regexp_extract(a, '.*android(.*)', 1), 'mobile')) THEN 'Tablet'
    WHEN a LIKE '%mobile%' OR a LIKE '%iphone%' OR a LIKE '%ipod%' OR a LIKE '%android%' OR a LIKE '%blackberry%' OR a LIKE '%opera mini%' OR a LIKE '%opera mobi%' OR a LIKE '%windows phone%' THEN 'Mobile' ELSE 'Desktop' END AS device,
  CASE WHEN a IS NULL THEN 'Unknown' WHEN a LIKE '%windows%' THEN 'Windows' WHEN a LIKE '%macintosh%' OR a LIKE '%mac os x%' THEN 'macOS' WHEN a LIKE '%android%' THEN 'Android' WHEN a LIKE '%iphone%' OR a LIKE '%ipad%' OR a LIKE '%ipod%' THEN 'iOS' WHEN a LIKE '%linux%' THEN 'Linux' ELSE 'Unknown' END AS os,
  CASE WHEN a IS NULL THEN 'Unknown' WHEN a LIKE '%edg%' THEN 'Edge' WHEN a LIKE '%opera%' OR a LIKE '%opr%' THEN 'Opera' WHEN a LIKE '%chrome%' OR a LIKE '%crios%' THEN 'Chrome' WHEN a LIKE '%firefox%' OR a LIKE '%fxios%' THEN 'Firefox' WHEN a LIKE '%safari%' THEN 'Safari' ELSE 'Chrome' END AS browser FROM u""",
)
def parse_user_agent(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    agent = F.get(F.array(*[F.lit(u) for u in _UA]), k % (len(_UA) + 1))
    return events(spark, d).select("event_id", *[c.alias(name) for name, c in A.parse_user_agent(agent).items()])


@query("enrich_pageviews", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'member' ELSE 'guest' END AS user_type, substr(sha256(CAST(user_id AS VARCHAR)), 1, 12) AS ip_hash, c_name AS title FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'view'")
def enrich_pageviews(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("title"))
    return events(spark, d).where("event_type = 'view'").join(names, "user_id", "left").select("event_id", F.when(F.col("user_id") % 2 == 0, "member").otherwise("guest").alias("user_type"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 12).alias("ip_hash"), "title")


@query("visitor_rollup", "SELECT user_id, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen, count(*) AS views, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def visitor_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.visitor_rollup(events(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@query("overview_counts", f"SELECT count(*) AS views, count(DISTINCT user_id) AS visitors, count(*) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS views_7d, count(DISTINCT user_id) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS visitors_7d, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS members FROM events WHERE ts <= TIMESTAMP '{AS_OF}'")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    week = F.col("ts") > F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(7))
    u = F.col("user_id")
    return A.since(events(spark, d), "ts", AS_OF, None).agg(F.count("*").alias("views"), F.countDistinct(u).alias("visitors"), F.count(F.when(week, 1)).alias("views_7d"), F.countDistinct(F.when(week, u)).alias("visitors_7d"), F.countDistinct(F.when(u % 2 == 0, u)).alias("members"))


@query("active_users", f"SELECT count(DISTINCT user_id) AS active FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE")
def active_users(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit(AS_OF).cast("timestamp")
    return events(spark, d).where((F.col("ts") <= end) & (F.col("ts") > end - F.expr("INTERVAL 15 MINUTES"))).agg(F.countDistinct("user_id").alias("active"))


@query("daily_trend", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS views, count(DISTINCT user_id) AS visitors, count(DISTINCT CASE WHEN user_id % 2 = 0 THEN user_id END) AS members FROM events GROUP BY 1")
def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return events(spark, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("views"), F.countDistinct(u).alias("visitors"), F.countDistinct(F.when(u % 2 == 0, u)).alias("members"))


@query("top_docs", "WITH t AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY views DESC, k LIMIT 10) SELECT k, views, visitors, c_name FROM t LEFT JOIN customer ON c_custkey = k")
def top_docs(spark: SparkSession, d: str) -> DataFrame:
    top = events(spark, d).where("event_type = 'view'").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("visitors")).orderBy(F.desc("views"), "k").limit(10)
    return top.join(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k", "left")


@query("top_paths", "SELECT event_type || '/' || json_extract_string(props, '$.k') AS path, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
def top_paths(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10)


@query("top_queries", f"WITH {S_SQL} SELECT query, count(*) AS n FROM s GROUP BY query ORDER BY n DESC, query LIMIT 10")
def top_queries(spark: SparkSession, d: str) -> DataFrame:
    return searches(spark, d).where("query <> ''").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(10)


def ratio_sql(part: str, whole: str, places: int) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN CAST((2 * {10**places} * CAST({part} AS HUGEINT) + ({whole})) // (2 * ({whole})) AS DOUBLE) / {10**places} END"


STATS_SQL = f"""{S_SQL}, st AS (SELECT query, count(*) AS n, count(DISTINCT user_id) AS searchers, {ratio_sql("sum(result_count)", "count(*)", 2)} AS avg_results, count(clicked_position) AS clicks,
{ratio_sql("100 * count(clicked_position)", "count(*)", 1)} AS ctr, {ratio_sql("sum(CAST(round(took_ms * 1000000) AS BIGINT))", "1000000 * count(took_ms)", 3)} AS avg_ms FROM s GROUP BY query)"""


@query("query_ctr", f"WITH {STATS_SQL} SELECT * FROM st ORDER BY n DESC, query LIMIT 15")
def query_ctr(spark: SparkSession, d: str) -> DataFrame:
    return A.query_stats(searches(spark, d)).orderBy(F.desc("n"), "query").limit(15)


@query("zero_result_queries", f"WITH {S_SQL} SELECT query, count(*) AS n, count(DISTINCT user_id) AS searchers, CAST(max(ts) AS VARCHAR) AS last_seen FROM s WHERE result_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 15")
def zero_result_queries(spark: SparkSession, d: str) -> DataFrame:
    return searches(spark, d).where("result_count = 0").groupBy("query").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("searchers"), F.max("ts").cast("string").alias("last_seen")).orderBy(F.desc("n"), "query").limit(15)


@query("click_brackets", f"WITH {S_SQL}, b AS (SELECT CASE WHEN clicked_position <= 3 THEN CAST(clicked_position AS VARCHAR) WHEN clicked_position <= 5 THEN '4-5' WHEN clicked_position <= 10 THEN '6-10' ELSE '>10' END AS bracket, count(*) AS n FROM s WHERE clicked_position IS NOT NULL GROUP BY 1) SELECT bracket, n, round(n * 100.0 / sum(n) OVER (), 1) AS share FROM b")
def click_brackets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = F.col("clicked_position")
    bracket = F.when(p <= 3, p.cast("string")).when(p <= 5, "4-5").when(p <= 10, "6-10").otherwise(">10")
    per = searches(spark, d).where(p.isNotNull()).groupBy(bracket.alias("bracket")).agg(F.count("*").alias("n"))
    return per.select("bracket", "n", A.percent(F.col("n"), F.sum("n").over(W.partitionBy())).alias("share"))  # six rows


@query("click_mrr", f"WITH {S_SQL} SELECT round(avg(CASE WHEN clicked_position >= 1 THEN 1.0 / clicked_position ELSE 0 END), 6) AS mrr, round(avg(clicked_position), 6) AS avg_rank FROM s")
def click_mrr(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("clicked_position")
    return searches(spark, d).agg(F.round(F.avg(F.when(p >= 1, 1.0 / p).otherwise(0.0)), 6).alias("mrr"), F.round(F.avg(p), 6).alias("avg_rank"))


@query("latency_percentiles", f"WITH {S_SQL}, r AS (SELECT took_ms, row_number() OVER (ORDER BY took_ms) AS i, count(*) OVER () AS n FROM s), m AS (SELECT {ratio_sql('sum(CAST(round(took_ms * 1000000) AS BIGINT))', '1000000 * count(took_ms)', 3)} AS average FROM s) SELECT DISTINCT share, took_ms AS value, average FROM r, m, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) p(share) WHERE i = greatest(round(share * n), 1)")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    s = searches(spark, d)
    average = s.agg(A.ratio(F.sum(F.round(F.col("took_ms") * 1_000_000).cast("long")), 1_000_000 * F.count("took_ms"), 3).alias("average"))
    return A.nearest_rank(s, "took_ms", [0.5, 0.9, 0.95, 0.99]).crossJoin(F.broadcast(average))  # one row


@query("crash_free", "SELECT round(100.0 * (1 - count(DISTINCT CASE WHEN event_type = 'error' THEN user_id || ':' || CAST(ts AS DATE) END) / count(DISTINCT user_id || ':' || CAST(ts AS DATE))), 4) AS sessions, round(100.0 * (1 - count(DISTINCT CASE WHEN event_type = 'error' AND value > 480 THEN user_id END) / count(DISTINCT user_id)), 4) AS users FROM events")
def crash_free(spark: SparkSession, d: str) -> DataFrame:
    session, bad = F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")), F.col("event_type") == "error"
    share = lambda broken, all_: F.round(100.0 * (1 - F.countDistinct(broken) / F.countDistinct(all_)), 4)
    return events(spark, d).agg(share(F.when(bad, session), session).alias("sessions"), share(F.when(bad & (F.col("value") > 480), F.col("user_id")), F.col("user_id")).alias("users"))


@query("user_split", "SELECT CASE WHEN user_id % 2 = 0 THEN 'member' ELSE 'guest' END AS user_type, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def user_split(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.when(F.col("user_id") % 2 == 0, "member").otherwise("guest").alias("user_type")).agg(F.countDistinct("user_id").alias("visitors"))


@query("device_breakdown", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 6")
def device_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(6)


@query("recent_activity", "WITH r AS (SELECT event_id, user_id, CAST(ts AS VARCHAR) AS ts FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 30) SELECT r.*, c_name FROM r LEFT JOIN customer ON c_custkey = user_id")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    last = events(spark, d).select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(30)
    return last.join(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").withColumn("ts", F.col("ts").cast("string"))


@query("facet_share", "SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share FROM documents GROUP BY lang")
def facet_share(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    per = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return per.select("lang", "n", A.percent(F.col("n"), F.sum("n").over(W.partitionBy()), 2).alias("share"))  # a row per value


@query("weekly_query_stats", f"WITH {S_SQL} SELECT query, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM s WHERE ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY query HAVING count(*) >= 3")
def weekly_query_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.since(searches(spark, d), "ts", AS_OF, 7).groupBy("query").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")).where("n >= 3")


@query("week_id", "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, year(ts) || '-W' || lpad(CAST(CAST(ceil((dayofweek(ts) + 1 + datediff('day', make_date(year(ts), 1, 1), CAST(ts AS DATE))) / 7.0) AS INTEGER) AS VARCHAR), 2, '0') AS week FROM events")
def week_id(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.to_date("ts").cast("string").alias("day"), A.week_id(F.col("ts")).alias("week")).distinct()


_STATUS_SQL = "CASE WHEN toxic = 1 THEN 'under_review' WHEN quality = 0 THEN 'pending' ELSE 'resolved' END"


def reports(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "under_review").when(F.col("quality") == 0, "pending").otherwise("resolved")
    return table(spark, d, "labels").select("doc_id", status.alias("status"), F.when(F.col("toxic") == 1, "abuse").otherwise("quality").alias("kind"))


@query("report_list", f"WITH r AS (SELECT l.doc_id, {_STATUS_SQL} AS status, CASE WHEN toxic = 1 THEN 'abuse' ELSE 'quality' END AS kind FROM labels l), f AS (SELECT * FROM r WHERE status <> 'resolved' AND kind = 'quality') SELECT f.doc_id, f.status, f.kind, source, (SELECT count(*) FROM f) AS total FROM f LEFT JOIN documents USING (doc_id) ORDER BY f.doc_id DESC LIMIT 20 OFFSET 20")
def report_list(spark: SparkSession, d: str) -> DataFrame:
    """The second page of open reports of one kind, newest first, each row with the number of all."""
    wanted = reports(spark, d).where("status <> 'resolved' AND kind = 'quality'")
    page = wanted.orderBy(F.desc("doc_id")).offset(20).limit(20).crossJoin(F.broadcast(wanted.agg(F.count("*").alias("total"))))  # one row
    return page.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "left").select("doc_id", "status", "kind", "source", "total")


@query("report_stats", "SELECT count(*) AS total, count(*) FILTER (toxic = 1 OR quality = 0) AS pending, count(*) FILTER (NOT (toxic = 1 OR quality = 0)) AS resolved FROM labels")
def report_stats(spark: SparkSession, d: str) -> DataFrame:
    open_ = F.col("status").isin("pending", "under_review")
    return reports(spark, d).agg(F.count("*").alias("total"), F.count(F.when(open_, 1)).alias("pending"), F.count(F.when(~open_, 1)).alias("resolved"))


@query("apply_report_updates", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'resolved' ELSE {_STATUS_SQL} END AS status, CASE WHEN doc_id % 3 = 0 THEN '{AS_OF}' END AS resolved_at FROM labels")
def apply_report_updates(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d)
    updates = r.where("doc_id % 3 = 0").select("doc_id", F.lit("resolved").alias("new"))
    return r.join(updates, "doc_id", "left").select("doc_id", F.coalesce("new", "status").alias("status"), F.when(F.col("new") == "resolved", F.lit(AS_OF)).alias("resolved_at"))


@query("zero_result_log", f"WITH {S_SQL} SELECT sha256(lower(query)) AS query_hash, substr(sha256(CAST(user_id AS VARCHAR) || 'salt'), 1, 32) AS session_hash, count(*) AS n FROM s WHERE result_count = 0 GROUP BY ALL")
def zero_result_log(spark: SparkSession, d: str) -> DataFrame:
    return A.anonymous(searches(spark, d).where("result_count = 0"), "query", "user_id", "salt").groupBy("query_hash", "session_hash").agg(F.count("*").alias("n"))


@query("link_audit", "WITH p AS (SELECT page_id, page_id % 11 = 0 OR page_id % 13 = 0 AS broken FROM pages WHERE substr(md5(CAST(page_id AS VARCHAR)), 1, 1) < '8') SELECT count(*) AS sampled, count(*) FILTER (broken) AS broken, round(count(*) FILTER (broken) * 100.0 / count(*), 1) AS rate, count(*) FILTER (broken) * 100.0 / count(*) > 15 AS alarm FROM p")
def link_audit(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    sample = table(spark, d, "pages").where(F.substring(F.md5(i.cast("string")), 1, 1) < "8").select(((i % 11 == 0) | (i % 13 == 0)).alias("broken"))
    n = F.count(F.when(F.col("broken"), 1))
    return sample.agg(F.count("*").alias("sampled"), n.alias("broken"), A.percent(n, F.count("*")).alias("rate"), (n * 100.0 / F.count("*") > 15).alias("alarm"))


@query("structure_monitor", "WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, bool_and(contains(html, '<article')) AS articles, bool_and(contains(html, '<h1')) AS titles, CAST(sum(len(regexp_extract_all(html, 'href=\"'))) AS BIGINT) AS links FROM pages GROUP BY 1), s AS (SELECT host, links, CASE WHEN NOT titles THEN 'FAIL' WHEN NOT articles OR links < 10 THEN 'WARN' ELSE 'PASS' END AS status FROM h) SELECT *, CASE WHEN (SELECT bool_or(status = 'FAIL') FROM s) THEN 'CRITICAL_STRUCTURE_CHANGED' WHEN (SELECT bool_or(status = 'WARN') FROM s) THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall FROM s")
def structure_monitor(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.bool_and(F.contains("html", F.lit("<article"))).alias("articles"), F.bool_and(F.contains("html", F.lit("<h1"))).alias("titles"), F.sum(F.regexp_count("html", F.lit('href="'))).alias("links"))
    checks = per.select("host", "links", F.when(~F.col("titles"), "FAIL").when(~F.col("articles") | (F.col("links") < 10), "WARN").otherwise("PASS").alias("status"))
    worst = checks.agg(F.bool_or(F.col("status") == "FAIL").alias("fail"), F.bool_or(F.col("status") == "WARN").alias("warn"))
    overall = F.when(F.col("fail"), "CRITICAL_STRUCTURE_CHANGED").when(F.col("warn"), "DEGRADED").otherwise("HEALTHY")
    return checks.crossJoin(F.broadcast(worst)).select("host", "links", "status", overall.alias("overall"))  # one row


@query("keep_latest_distinct", f"WITH {S_SQL}, m AS (SELECT user_id, query, max(ts) AS ts FROM s GROUP BY ALL) SELECT user_id, query, CAST(ts AS VARCHAR) AS ts FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m.ts DESC, query) <= 20")
def keep_latest_distinct(spark: SparkSession, d: str) -> DataFrame:
    return A.keep_latest_distinct(searches(spark, d), "user_id", "query", "ts", 20).withColumn("ts", F.col("ts").cast("string"))


RATE_SQL = "SELECT user_id, CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2"


@query("window_limit_flags", RATE_SQL)
def window_limit_flags(spark: SparkSession, d: str) -> DataFrame:
    return A.window_counts(events(spark, d), "user_id", "ts", "6 hours", 2).withColumn("start", F.col("start").cast("string"))


@query("count_docs", "SELECT count(*) AS n FROM documents")
def count_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------------------------------------


@query("bookmark_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def bookmark_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("reports_enriched", "SELECT l.doc_id, quality, coalesce(source, 'unknown') AS source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang <> 'de'")
def reports_enriched(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").where("lang <> 'de'").select("doc_id", "source")
    return table(spark, d, "labels").join(known, "doc_id", "left").select("doc_id", "quality", F.coalesce("source", F.lit("unknown")).alias("source"))


@query("collection_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["n"])


@query("events_enriched", "SELECT user_id, c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY ALL")
def events_enriched(spark: SparkSession, d: str) -> DataFrame:
    per = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return per.join(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id", "left").select("user_id", "c_mktsegment", "n")


@query("top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), 3, [F.desc("c_acctbal"), F.col("c_custkey")], ["c_nationkey"]).drop("rank")
