"""The weekly loop: queries that searchers were not served well with, asked again, with what could mend them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import analytics as A
from quillspark.operators import retrieval as R
from quillspark.plans import retrieval as P
from quillspark.plans.analytics import STATS_SQL, ratio_sql, searches
from quillspark.plans.registry import query
from quillspark.sources.files import scratch_dir

_PROBLEM_SQL = f"""{STATS_SQL}, {P.BM25_SQL}, {P.EVERY_SQL}, {P.TRANS_SQL.replace(P.QW_SQL + ", ", "")},
tot AS (SELECT query_id, count(*) AS total FROM every GROUP BY 1), top AS ({P.TOP_SQL.format("bm", 3)}), want AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS expected FROM top GROUP BY 1),
syn AS (SELECT query_id, string_agg(DISTINCT output, '|' ORDER BY output) AS synonyms FROM pt JOIN tr USING (term) GROUP BY 1),
asked AS (SELECT 'q' || query_id AS query, coalesce(total, 0) AS total, synonyms, expected FROM qw LEFT JOIN tot USING (query_id) LEFT JOIN syn USING (query_id) LEFT JOIN want USING (query_id)),
pr AS (SELECT st.query, n, ctr, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) = 0 THEN 'ZERO_RESULTS' WHEN n >= 3 AND ctr < 15 THEN 'LOW_CTR' END AS reason, synonyms, expected FROM st LEFT JOIN asked USING (query))"""


@query("problem_queries", f"WITH {_PROBLEM_SQL} SELECT * FROM pr WHERE reason IS NOT NULL")
def problem_queries(spark: SparkSession, d: str) -> DataFrame:
    """Searches of telemetry are those for the item of that number. Each is asked again: without a document that has all its words, or seldom clicked, it is a problem.

    Proposed are transliterations of its words as synonyms, and its three best documents as what to expect.
    """
    item = F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query")
    terms = P.query_terms(spark, d)
    totals = R.match_all(terms, P.index(spark, d)).groupBy("query_id").agg(F.count("*").alias("total")).select(item, "total")
    placed, outputs = P.transliterated(spark, d)
    synonyms = placed.join(outputs, "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("output")), "|").alias("synonyms")).select(item, "synonyms")
    best = P.bm25_run(spark, d, 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc")))).alias("l"))  # three a query
    expected = best.select(item, F.array_join(F.col("l.doc"), ",").alias("expected"))
    stats = A.query_stats(searches(spark, d)).select("query", "n", "ctr")
    for more in (totals, synonyms, expected):
        stats = stats.join(more, "query", "left")
    total = F.coalesce("total", F.lit(0))
    reason = F.when(total == 0, "ZERO_RESULTS").when((F.col("n") >= 3) & (F.col("ctr") < 15), "LOW_CTR")
    return stats.select("query", "n", "ctr", total.alias("total"), reason.alias("reason"), "synonyms", "expected").where("reason IS NOT NULL")


@query("write_quality_report", f"WITH {_PROBLEM_SQL} SELECT reason, count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS n_searches, count(expected) AS n_expected FROM pr WHERE reason IS NOT NULL GROUP BY reason")
def write_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """The report goes out as JSON, one line per query in parts by reason, and is read back."""
    path = scratch_dir(spark, "report")
    problem_queries(spark, d).write.partitionBy("reason").json(path)
    read = spark.read.schema("query string, n long, ctr double, total long, synonyms string, expected string, reason string").json(path)
    return read.groupBy("reason").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_searches"), F.count("expected").alias("n_expected"))


_MILLIONTHS = "CAST(round({0} * 1000000) AS BIGINT)"


@query(
    "eval_summary",
    f"""WITH ev AS ({P.EVAL_SQL}) SELECT count(*) AS n, {ratio_sql("100 * sum(hit5)", "count(*)", 2)} AS hit_percent, {ratio_sql(f"sum({_MILLIONTHS.format('rr')})", "1000000 * count(*)", 4)} AS mrr,
{ratio_sql(f"sum({_MILLIONTHS.format('ndcg10')})", "1000000 * count(*)", 4)} AS ndcg10, count(*) FILTER (hit5 = 0) AS failures, coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) FILTER (hit5 = 0), '') AS failed FROM ev""",
)
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Averages over the golden queries, and those without a hit among the first five."""
    e, n = P.eval_retrieval(spark, d), F.count("*")
    millionths = lambda c: F.sum(F.round(F.col(c) * 1_000_000).cast("long"))
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit5") == 0, F.col("query_id")))), lambda x: x.cast("string")), ",")  # a part of the golden queries
    return e.agg(
        n.alias("n"), A.ratio(100 * F.sum(F.col("hit5").cast("long")), n, 2).alias("hit_percent"), A.ratio(millionths("rr"), 1_000_000 * n, 4).alias("mrr"),
        A.ratio(millionths("ndcg10"), 1_000_000 * n, 4).alias("ndcg10"), F.count_if(F.col("hit5") == 0).alias("failures"), failed.alias("failed"),
    )
