"""Scans, filters and ingest over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import filters as P
from quillspark.operators import ingest as I
from quillspark.operators import markup as M
from quillspark.plans.registry import query, table
from quillspark.sources import files as S

# --- scans, sources, sinks -------------------------------------------------------------------------


@query("scan_docs", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents ORDER BY n_chars DESC, doc_id")
def scan_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("load_json_archive", "SELECT doc_id, doc_id % 4 = 3 AS is_raw, substr(text, 1, 40) AS title, md5(text) AS body_md5, CASE WHEN doc_id % 4 = 3 THEN 'unknown' ELSE coalesce(source, 'unknown') END AS source FROM documents")
def load_json_archive(spark: SparkSession, d: str) -> DataFrame:
    """Written out in all layouts of an archive: arrays of up to a hundred objects, single objects with the one or the other name, raw strings."""
    path, i = S.scratch_dir(spark, "archive"), F.col("doc_id")
    docs = table(spark, d, "documents").select(i, "text", "source")
    one = lambda name: F.to_json(F.struct("doc_id", F.col("text").alias(name), "source"))
    arrays = docs.where(i % 4 == 0).groupBy(F.floor(i / 400)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one("answer")), ","), F.lit("]")).alias("value"))
    raw = F.to_json(F.array(F.concat(i.cast("string"), F.lit("\n"), F.col("text"))))
    lines = arrays.select("value").union(docs.where(i % 4 == 1).select(one("answer"))).union(docs.where(i % 4 == 2).select(one("content"))).union(docs.where(i % 4 == 3).select(raw))
    lines.write.text(path)
    read = S.load_json_archive(spark, path, "doc_id long, answer string, content string, source string", {"body": ["answer", "content"]})
    body = F.coalesce("body", F.substring("raw", F.instr("raw", "\n") + 1, F.length("raw")))
    return read.select(F.coalesce("doc_id", F.substring_index("raw", "\n", 1).cast("long")).alias("doc_id"), F.col("raw").isNotNull().alias("is_raw"), F.substring(body, 1, 40).alias("title"), F.md5(body).alias("body_md5"), F.coalesce("source", F.lit("unknown")).alias("source"))


@query("seed_insert_ignore", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS origin, n_chars FROM documents")
def seed_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    old = docs.where("doc_id % 3 = 0").withColumn("origin", F.lit("old"))
    return S.insert_ignore(old, docs.withColumn("origin", F.lit("new")), "doc_id")


# What a class of a page's body contains, and the labels of questions and answers in its text.
BODY_CLASSES = "content|detail|desc|answer|body|article"
ANSWER_LABELS, QUESTION_LABELS = ("উত্তরঃ", "উত্তর:"), ("প্রশ্ন:", "প্রশ্ন")
PAGE_PARTS = {"h1": ("h1", None), "h2": ("h2", None), "h3": ("h3", None), "body": ("div", BODY_CLASSES), "article": ("article", None), "time": ("time", None), "date": (r"[a-z0-9]+", "date")}


def page_records(pages: DataFrame) -> DataFrame:
    """Of each page title, question, answer, date: the first h1, h2 or h3; a body's text, with what stands before and after a label of the answer; a time element or one of a date's class.

    The body is the first div of such a class, or else the article. Pages with neither title nor text are left out.
    """
    found = M.elements(pages, "page_id", "html", PAGE_PARTS)
    one = found.groupBy("page_id").agg(M.first_of(["h1", "h2", "h3"]).alias("title"), M.first_of(["body", "article"]).alias("body"), M.first_of(["time", "date"]).alias("date"))
    plain = lambda c: X.spaces(F.coalesce(c, F.lit("")))
    text = F.trim(F.coalesce("body", F.lit("")), F.lit(" \t\n\x0b\f\r"))
    told = one.select("page_id", plain(F.col("title")).alias("title"), text.alias("text"), F.nullif(plain(F.col("date")), F.lit("")).alias("date")).where("title <> '' OR text <> ''")
    labelled = F.split(F.replace("text", F.lit(ANSWER_LABELS[0]), F.lit(ANSWER_LABELS[1])), ANSWER_LABELS[1])
    asked = F.get(labelled, F.lit(0))
    for label in QUESTION_LABELS:
        asked = F.replace(asked, F.lit(label), F.lit(""))
    many = F.size(labelled) >= 2
    question = F.when(many & (plain(asked) != ""), plain(asked)).otherwise(F.col("title"))
    answer = F.when(many & (plain(F.get(labelled, F.lit(1))) != ""), plain(F.get(labelled, F.lit(1)))).otherwise(F.col("text"))
    return told.select("page_id", "title", F.nullif(F.trim(F.regexp_replace(question, r"^প্রশ্ন\s*\([^)]*\)\s*:\s*", "")), F.lit("")).alias("question"), answer.alias("answer"), "date").withColumn("question", F.coalesce("question", "title"))


_TEXT_SQL = r"replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*>', '', 'g'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')".replace('\\"', '"')


@query(
    "extract_pages",
    rf"""WITH p AS (SELECT page_id, trim(regexp_replace({_TEXT_SQL.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '\s+', ' ', 'g')) AS title, trim({_TEXT_SQL.format("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM pages)
SELECT page_id, title, title AS question, md5(body) AS answer_md5, length(body) AS answer_chars, NULL::VARCHAR AS date FROM p WHERE title <> '' OR body <> ''""",
)
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    return page_records(table(spark, d, "pages")).select("page_id", "title", "question", F.md5("answer").alias("answer_md5"), F.length("answer").cast("long").alias("answer_chars"), "date")


#: The parts of a repeated item's block.
ITEM_PARTS = {"item": ("div", "latest-news-item"), "head": ("h2", None), "part": ("div", r"(?:^|\s)post-text(?:\s|$)"), "quote": ("blockquote", None), "link": ("a", r"(?:^|\s)shareable-link(?:\s|$)")}
#: What is put between an answer and the quote that it rests on.
SOURCES_HEAD = "\n\nদলীল ও সূত্র:\n"


def news_items(pages: DataFrame, parts: dict = ITEM_PARTS) -> DataFrame:
    """Of each item block (page_id, item, asker, number, question, answer, link): its headings, both parts of its text, and a quote behind the answer if it is not in there. Blocks without a heading or any text are left out."""
    found = M.elements(pages, "page_id", "html", parts, outer="item")
    plain = lambda c: X.spaces(F.coalesce(c, F.lit("")))
    held = M.item_blocks(found, "page_id", "item", {"h0": M.nth_of("head", 0), "h1": M.nth_of("head", 1), "q": M.nth_of("part", 0), "a": M.nth_of("part", 1), "quote": M.nth_of("quote", 0), "href": M.nth_of("link", 0, "href")})
    told = held.where("h0 IS NOT NULL").select("page_id", "item", F.when(F.col("h1").isNotNull(), plain(F.col("h0"))).otherwise("").alias("asker"), plain(F.coalesce("h1", "h0")).alias("number"), plain(F.col("q")).alias("question"), plain(F.col("a")).alias("answer"), plain(F.col("quote")).alias("quote"), "href").where("question <> '' OR answer <> ''")
    answer = F.when((F.col("quote") != "") & ~F.contains("answer", F.col("quote")), F.concat("answer", F.lit(SOURCES_HEAD), "quote")).otherwise(F.col("answer"))
    return told.join(pages.select("page_id", "url"), "page_id").select("page_id", "item", "asker", "number", "question", answer.alias("answer"), F.when(F.coalesce(F.col("href"), F.lit("")) == "", F.col("url")).otherwise(M.resolve(F.col("url"), F.col("href"))).alias("link"))


@query(
    "extract_repeated_items",
    rf"""WITH i AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS xs FROM pages)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY u.i) AS pos, trim(regexp_replace({_TEXT_SQL.format("xs[u.i]")}, '\s+', ' ', 'g')) AS text, host || {_TEXT_SQL.format("regexp_extract(xs[u.i], 'href=\"([^\"]*)\"', 1)").replace('\\"', '"')} AS link FROM i, LATERAL unnest(range(1, len(xs) + 1)) AS u(i)""",
)
def extract_repeated_items(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that pages of the table repeat are the entries of their navigation."""
    pages = table(spark, d, "pages")
    found = M.elements(pages, "page_id", "html", {"item": ("li", None), "link": ("a", None)}, outer="item")
    held = M.item_blocks(found, "page_id", "item", {"text": M.nth_of("link", 0), "href": M.nth_of("link", 0, "href")}).join(pages.select("page_id", "url"), "page_id")
    place = F.row_number().over(W.partitionBy("page_id").orderBy("item"))  # entries of a page
    return held.select("page_id", place.alias("pos"), X.spaces(F.col("text")).alias("text"), M.resolve(F.col("url"), F.col("href")).alias("link"))


@query(
    "discover_links",
    rf"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages),
e AS (SELECT page_id, u.i AS place, regexp_replace(host || {_TEXT_SQL.format("hs[u.i]")}, '#.*$', '') AS link FROM l, LATERAL unnest(range(1, len(hs) + 1)) AS u(i))
SELECT link, min(page_id) AS first_page, count(*) OVER (PARTITION BY min(page_id)) AS new_of_page FROM e GROUP BY link""",
)
def discover_links(spark: SparkSession, d: str) -> DataFrame:
    """Each address once, with the page that has it first and how many that page brings in."""
    first = M.links(table(spark, d, "pages")).select("link", "first_page")
    return first.join(first.groupBy("first_page").agg(F.count("*").alias("new_of_page")), "first_page").select("link", "first_page", "new_of_page")


@query("write_dedup_json", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def write_dedup_json(spark: SparkSession, d: str) -> DataFrame:
    path = S.scratch_dir(spark, "dedup")
    S.write_distinct_json(table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5")), path, ["text_md5"], [F.col("doc_id")])
    return spark.read.schema("doc_id long, text_md5 string").json(path)


_SLUG_SQL = r"""t AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(substr(string_split(text, chr(10))[1], 1, 120), '<[^>]*>', '', 'g')), '[^\pL\pM\pN]+', '-', 'g'), '-') AS s, sha256(text) AS h FROM documents),
c AS (SELECT doc_id, h, s, list_max(list_filter(range(21, 71), lambda i: substr(s, i + 1, 1) = '-')) AS cut FROM t),
slugs AS (SELECT doc_id, CASE WHEN s = '' THEN h ELSE CASE WHEN length(s) <= 70 THEN s WHEN cut IS NOT NULL THEN substr(s, 1, cut) ELSE rtrim(substr(s, 1, 70), '-') END || '-' || substr(h, 1, 8) END AS slug FROM c)"""
_CHUNK_SQL = f"""{_SLUG_SQL}, chunks AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 + 1 AS chunk, slug,
  CASE WHEN doc_id % 10 <> 0 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 365 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') WHEN doc_id % 20 <> 0 THEN '2023-05-05T08:00:00.000Z' END AS last_modified FROM slugs)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents have no times: most are given a date of change, some only a time of publication, and a twentieth one that is none."""
    i = F.col("doc_id")
    changed = F.when(i % 10 != 0, F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")).cast("string"), F.lit("T00:00:00Z"))).otherwise("")
    published = F.when(i % 20 != 0, "2023-05-05T10:00:00+02:00").otherwise("soon")
    return S.address_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", X.slug(X.title_of(F.col("text")), F.sha2("text", 256)), S.iso_instant(changed, published), 200)


@query("chunk_export", f"WITH {_CHUNK_SQL} SELECT doc_id, chunk, slug, last_modified FROM chunks")
def chunk_export(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d)


@query("chunk_list", f"WITH {_CHUNK_SQL} SELECT chunk, count(*) AS n, min(doc_id) AS first_key, max(doc_id) AS last_key, max(last_modified) AS last_modified FROM chunks GROUP BY chunk")
def chunk_list(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_list(_chunks(spark, d), "doc_id")


# --- filters ------------------------------------------------------------------------------------------


@query(
    "facet_filter",
    """WITH q AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'All' WHEN 2 THEN '' ELSE 'src' || (item_id % 20) END AS want_source, CASE WHEN item_id % 3 = 0 THEN 'All' WHEN item_id % 3 = 1 THEN 'en' END AS want_lang FROM benchmark)
SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM q JOIN documents d ON (coalesce(want_source, '') IN ('', 'All') OR want_source = d.source) AND (coalesce(want_lang, '') IN ('', 'All') OR want_lang = d.lang) GROUP BY item_id""",
)
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents are counted by their values first, so that a query without a filter meets those and not all documents."""
    i = F.col("item_id")
    source = F.when(i % 5 == 1, "All").when(i % 5 == 2, "").when(i % 5 > 2, F.concat(F.lit("src"), (i % 20).cast("string")))
    queries = table(spark, d, "benchmark").select(i, source.alias("want_source"), F.when(i % 3 == 0, "All").when(i % 3 == 1, "en").alias("want_lang"))
    values = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return P.match_filters(queries, values, ["source", "lang"]).groupBy("item_id").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"))


@query("ci_substring_filter", "SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%license%'")
def ci_substring_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(P.contains_any(["text", "source"], "License")).select("doc_id", "lang")


@query("regex_any_filter", r"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)(MIT License|CC BY\-NC|\+1)') OR regexp_matches(source, '(?i)(MIT License|CC BY\-NC|\+1)')")
def regex_any_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(P.matches_any(["text", "source"], ["MIT License", "CC BY-NC", "+1"])).select("doc_id", "source")


_ALIASES = [(1, "name", "en", "English"), (2, "name", "de", "German"), (3, "keyword", "r", "Romance"), (4, "keyword", "e", "Other")]
_ALIAS_SQL = "(VALUES (1, 'name', 'en', 'English'), (2, 'name', 'de', 'German'), (3, 'keyword', 'r', 'Romance'), (4, 'keyword', 'e', 'Other')) AS r(rule_no, kind, term, canonical)"


@query(
    "category_alias_filter",
    f"""SELECT canonical, count(*) AS n FROM documents d JOIN (SELECT lang, arg_min(canonical, rule_no) AS canonical FROM (SELECT DISTINCT lang FROM documents), {_ALIAS_SQL}
  WHERE (kind = 'name' AND lang = term) OR (kind = 'keyword' AND contains(lang, term)) GROUP BY lang) m USING (lang) GROUP BY canonical""",
)
def category_alias_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_ALIASES, "rule_no int, kind string, term string, canonical string")
    docs = table(spark, d, "documents").select(F.col("lang").alias("value"))
    return docs.join(P.resolve_aliases(docs, rules), "value").groupBy("canonical").agg(F.count("*").alias("n"))


@query("project_without_vector", "SELECT vec_id, label FROM embeddings")
def project_without_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").drop("embedding")


@query("parse_json_array_col", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 5 > 0 THEN event_type END AS head FROM events""")
def parse_json_array_col(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("[broken")).otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('","x"]')))
    tags = P.parse_string_array(raw)
    return table(spark, d, "events").select("event_id", F.size(tags).alias("n"), F.get(tags, 0).alias("head"))


@query(
    "resolve_ids",
    """WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, sha256(CAST(doc_id AS VARCHAR)) AS hash FROM documents),
q AS (SELECT item_id, sha256(CAST(item_id AS VARCHAR)) AS h FROM benchmark),
r AS (SELECT DISTINCT CASE item_id % 5 WHEN 0 THEN CAST(item_id AS VARCHAR) WHEN 1 THEN upper(h) WHEN 2 THEN substr(h, 1, 12) WHEN 3 THEN 'a-title-' || substr(h, 1, 8) ELSE 'old-' || item_id END AS request, CASE WHEN item_id % 5 = 4 THEN CAST(item_id + 1 AS VARCHAR) END AS target FROM q),
k AS (SELECT *, coalesce(target, request) AS asked, regexp_extract(coalesce(target, request), '-([0-9a-f]{8,})$', 1) AS suffix FROM r),
g AS (SELECT *, lower(regexp_replace(CASE WHEN suffix <> '' THEN suffix ELSE asked END, '[^0-9a-fA-F]', '', 'g')) AS digits FROM k),
m AS (SELECT request, doc_id, CASE WHEN asked = id THEN 1 WHEN suffix <> '' AND starts_with(hash, suffix) THEN 2 WHEN target IS NOT NULL AND request = id THEN 3 WHEN lower(asked) = hash THEN 4 WHEN length(digits) >= 6 AND starts_with(hash, digits) THEN 5 END AS rule FROM g, d)
SELECT request, doc_id, rule FROM m WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request ORDER BY rule, doc_id) = 1""",
)
def resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    """Asked for by id, by hash in capitals, by its beginning, by slug, and by a name that stands for the next id."""
    i, h = F.col("item_id"), F.sha2(F.col("item_id").cast("string"), 256)
    old = F.concat(F.lit("old-"), i.cast("string"))
    items = table(spark, d, "benchmark").select("item_id")
    requests = items.select(F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 1, F.upper(h)).when(i % 5 == 2, F.substring(h, 1, 12)).when(i % 5 == 3, F.concat(F.lit("a-title-"), F.substring(h, 1, 8))).otherwise(old).alias("request"))
    aliases = items.where(i % 5 == 4).select(old.alias("request"), (i + 1).cast("string").alias("target"))
    return P.resolve_ids(requests, table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("hash")), aliases)


@query(
    "validate_records",
    r"""WITH r AS (SELECT doc_id, text, source, substr(string_split(text, chr(10))[1], 1, 120) AS title, string_split(text, chr(10))[2] AS question, string_split(substr(string_split(text, chr(10))[1], 1, 120), ' ') AS tags,
  CASE doc_id % 6 WHEN 0 THEN substr(sha256(text), 1, 63) WHEN 1 THEN upper(sha256(text)) || ' ' WHEN 2 THEN NULL ELSE sha256(text) END AS hash FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT coalesce(length(source) BETWEEN 1 AND 100, false) THEN 'source' END, CASE WHEN NOT coalesce(length(title) BETWEEN 3 AND 100, false) THEN 'title' END,
  CASE WHEN question IS NOT NULL AND NOT length(question) BETWEEN 5 AND 400 THEN 'question' END, CASE WHEN NOT coalesce(length(text) BETWEEN 100 AND 5000, false) THEN 'answer' END,
  CASE WHEN len(tags) > 18 OR list_max(list_transform(tags, lambda x: length(x))) > 10 THEN 'tags' END, CASE WHEN NOT regexp_full_match(trim(hash), '[0-9a-fA-F]{64}') THEN 'hash' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""",
)
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document stand for title and question, the title's words for tags; a third of the hashes are cut, in capitals or missing."""
    i, h, title = F.col("doc_id"), F.sha2("text", 256), X.title_of(F.col("text"))
    question = F.get(F.split("text", "\n"), F.lit(1))
    rows = table(spark, d, "documents").select(i, "text", "source", title.alias("title"), question.alias("question"), F.split(title, " ", -1).alias("tags"), F.when(i % 6 == 0, F.substring(h, 1, 63)).when(i % 6 == 1, F.concat(F.upper(h), F.lit(" "))).when(i % 6 > 2, h).alias("hash"))
    c = {n: F.col(n) for n in ("source", "title", "question", "text", "tags", "hash")}
    rules = {"source": P.length_within(c["source"], 1, 100), "title": P.length_within(c["title"], 3, 100), "question": c["question"].isNull() | P.length_within(c["question"], 5, 400), "answer": P.length_within(c["text"], 100, 5000), "tags": P.list_within(c["tags"], 18, 10), "hash": P.is_sha256(c["hash"], required=False)}
    return P.validate(rows, rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "safe_public_url",
    r"""WITH u AS (SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'http://127.0.0.1/x' WHEN 1 THEN 'ftp' || substr(url, strpos(url, ':')) WHEN 2 THEN 'https://172.20.1.1/' WHEN 3 THEN 'http://[::1]/' WHEN 4 THEN 'http://0.1.2.3/' ELSE url END AS url FROM pages),
h AS (SELECT *, lower(trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '[]')) AS host, TRY_CAST(regexp_extract(url, '//(\d+)\.', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(url, '//\d+\.(\d+)\.', 1) AS INTEGER) AS b FROM u)
SELECT page_id, (starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://')) AND host NOT IN ('', 'localhost', '::1', 'metadata.google.internal')
  AND NOT coalesce(regexp_full_match(host, '\d+(\.\d+){3}') AND (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31)), false) AS safe FROM h""",
)
def safe_public_url(spark: SparkSession, d: str) -> DataFrame:
    """The tables' own addresses are all public; five in twelve are made unsafe in one way or another."""
    m = F.col("page_id") % 12
    url = F.when(m == 0, "http://127.0.0.1/x").when(m == 1, F.concat(F.lit("ftp"), F.regexp_extract("url", "(:.*)", 1))).when(m == 2, "https://172.20.1.1/").when(m == 3, "http://[::1]/").when(m == 4, "http://0.1.2.3/").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", P.is_safe_public_url(url).alias("safe"))


_STATUS_SQL = "CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 503 ELSE 200 END"


@query(
    "classify_crawl",
    f"""SELECT page_id, CASE WHEN {_STATUS_SQL} IN (404, 410) THEN 'gone' WHEN {_STATUS_SQL} >= 500 THEN 'server_error' WHEN contains(lower(substr(html, 1, 3000)), 'ad 3') THEN 'soft_404' END AS error_type FROM pages""",
)
def classify_crawl(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    status = F.when(i % 11 == 0, 404).when(i % 13 == 0, 503).otherwise(200)
    return table(spark, d, "pages").select(i, P.crawl_status(F.col("url"), status, F.col("html"), ["ad 3"]).alias("error_type"))


@query("extract_search_param", r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1), '') AS section FROM pages")
def extract_search_param(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", P.query_parameter(F.col("url"), "page", "p").alias("page"), F.nullif(F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)", 1), F.lit("")).alias("section"))


@query("truncate_fields", "SELECT doc_id, substr(text, 1, 50) AS text, substr(source, 1, 4) AS source FROM documents")
def truncate_fields(spark: SparkSession, d: str) -> DataFrame:
    return P.truncate(table(spark, d, "documents").select("doc_id", "text", "source"), {"text": 50, "source": 4})


# --- ingest ---------------------------------------------------------------------------------------------


def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant's turn that follows: conv_id, turn, question, answer."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    return c.withColumn("answer", F.lead("text").over(w)).withColumn("_r", F.lead("role").over(w)).where("role = 'user' AND _r = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


QA_SQL = """qa AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"""
HASH_SQL = r"sha256(trim(regexp_replace(question, '\s+', ' ', 'g')) || '|' || trim(regexp_replace(answer, '\s+', ' ', 'g')))"


@query("content_hash", f"WITH {QA_SQL} SELECT conv_id, turn, {HASH_SQL} AS hash FROM qa")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return qa_pairs(spark, d).select("conv_id", "turn", X.content_hash(F.col("question"), F.col("answer")).alias("hash"))


@query("hash_uuid", f"WITH {QA_SQL}, h AS (SELECT conv_id, turn, {HASH_SQL} AS h FROM qa) SELECT conv_id, turn, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM h")
def hash_uuid(spark: SparkSession, d: str) -> DataFrame:
    return qa_pairs(spark, d).select("conv_id", "turn", X.hash_uuid(X.content_hash(F.col("question"), F.col("answer"))).alias("uuid"))


@query("dedup_first", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars, doc_id) = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("h"))
    return I.dedup_first(rows, ["h"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@query("drop_known", "SELECT doc_id FROM documents WHERE upper(md5(text)) NOT IN (SELECT upper(md5(text)) FROM documents WHERE doc_id % 4 = 0)")
def drop_known(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return I.drop_known(docs, docs.where("doc_id % 4 = 0").select(F.upper("h").alias("h")), "h").select("doc_id")


@query(
    "cut_at_known_run",
    """WITH m AS (SELECT doc_id, source, doc_id % 97 > 30 AS known, row_number() OVER w AS i, sum(CASE WHEN doc_id % 97 > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS isl FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC)),
l AS (SELECT *, row_number() OVER (PARTITION BY source, isl, known ORDER BY i) AS len FROM m),
e AS (SELECT *, min(CASE WHEN known AND len >= 8 THEN i END) OVER (PARTITION BY source) AS stop FROM l)
SELECT doc_id, source FROM e WHERE stop IS NULL OR i <= stop - 8""",
)
def cut_at_known_run(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 97 > 30).alias("known"))
    return I.cut_at_known_run(docs, "source", [F.desc("doc_id")], "known").select("doc_id", "source")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    qa = qa_pairs(spark, d).select(X.content_hash(F.col("question"), F.col("answer")).alias("hash"), "conv_id").groupBy("hash").agg(F.min("conv_id").alias("conv_id"))
    old = qa.where("conv_id % 10 < 8").withColumn("category", F.lit("General"))
    return old, qa.withColumn("category", F.when(F.col("conv_id") % 7 == 0, "Changed").otherwise("General"))


_SNAP_SQL = f"WITH {QA_SQL}, s AS (SELECT {HASH_SQL} AS hash, min(conv_id) AS conv_id FROM qa GROUP BY 1)"


@query("upsert_classify", f"{_SNAP_SQL} SELECT CASE WHEN conv_id % 10 >= 8 THEN 'inserted' WHEN conv_id % 7 = 0 THEN 'updated' ELSE 'skipped' END AS status, count(*) AS n FROM s GROUP BY 1")
def upsert_classify(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return I.classify(old, new, "hash", ["category", "conv_id"]).groupBy("status").agg(F.count("*").alias("n"))


@query("upsert_overwrite", f"{_SNAP_SQL} SELECT hash, conv_id, CASE WHEN conv_id % 7 = 0 THEN 'Changed' ELSE 'General' END AS category FROM s WHERE conv_id % 10 < 8 OR conv_id % 2 = 0")
def upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return I.upsert(old, new.where("conv_id % 10 < 8 OR conv_id % 2 = 0"), "hash")


@query("delete_by_key", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    return I.delete_keys(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


def _unsafe_sql() -> str:
    """Written out pass by pass from the lists of what is unsafe."""
    steps = []
    for e in X.UNSAFE_ELEMENTS:
        steps += [f"(?is)<{e}\\b.*?</{e}>", f"(?i)</?{e}\\b[^>]*>"]
    steps.append("(?i)</?(?:base|meta|link|form|input|button|textarea|select)\\b[^>]*>")
    steps.append("(?i)\\bon\\w+\\s*=\\s*(?:''[^'']*''|\"[^\"]*\"|[^\\s>]+)")
    steps += [f"(?i){a}[^\"''\\s]*" for a in ("javascript:", "vbscript:", "data:(?:text/html|image/svg\\+xml)")]
    out = "html"
    for _ in range(5):
        for step in steps:
            out = f"regexp_replace({out}, '{step}', '', 'g')"
    return out


@query("sanitize_markup", f"SELECT page_id, md5(trim({_unsafe_sql()})) AS clean_md5 FROM pages")
def sanitize_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.sanitize(F.col("html"))).alias("clean_md5"))


@query(
    "html_to_text",
    r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""",
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("text_md5"))


@query("infer_category", "SELECT CASE WHEN regexp_matches(text, '(?i)license') THEN 'legal' WHEN regexp_matches(text, '@|\\+1') THEN 'contact' WHEN regexp_matches(text, '[*$%&]{3}') THEN 'noise' ELSE 'general' END AS category, count(*) AS n FROM documents GROUP BY 1")
def infer_category(spark: SparkSession, d: str) -> DataFrame:
    rules = [("(?i)license", "legal"), (r"@|\+1", "contact"), ("[*$%&]{3}", "noise")]
    return table(spark, d, "documents").groupBy(I.first_rule(F.col("text"), rules, "general").alias("category")).agg(F.count("*").alias("n"))


@query("canonical_source", "SELECT CASE WHEN contains(source, 'src1') THEN 'first' WHEN contains(source, '2') THEN 'second' ELSE 'other' END AS source, count(*) AS n FROM documents GROUP BY 1")
def canonical_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(I.canonical_source(F.col("source"), [("src1", "first"), ("2", "second")], "other").alias("source")).agg(F.count("*").alias("n"))


@query("assemble_tags", "SELECT doc_id, array_to_string(list_transform(CASE WHEN lang = 'en' THEN ['qa', lang] WHEN source = lang THEN ['qa', lang] ELSE ['qa', lang, source] END, lambda x: x), '|') AS tags FROM documents")
def assemble_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_distinct(F.concat(F.array(F.lit("qa"), F.col("lang")), F.when(F.col("lang") == "en", F.array(F.col("lang"))).otherwise(F.array(F.col("source")))))
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


@query(
    "split_qa_text",
    r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS x FROM documents),
t AS (SELECT *, list_filter(x[greatest(len(x) - 2, 1):], lambda y: regexp_matches(y, '\d{4}')) AS dated FROM l)
SELECT doc_id, md5(coalesce(x[1], '')) AS question, md5(array_to_string(x[2:], chr(10))) AS answer, dated[len(dated)] AS date_line FROM t""",
)
def split_qa_text(spark: SparkSession, d: str) -> DataFrame:
    parts = I.split_qa(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(parts["question"]).alias("question"), F.md5(parts["answer"]).alias("answer"), parts["date_line"].alias("date_line"))


@query("make_slug", f"WITH {_SLUG_SQL} SELECT doc_id, slug FROM slugs")
def make_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.slug(X.title_of(F.col("text")), F.sha2("text", 256)).alias("slug"))


@query("fill_defaults", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN lang END), ''), CASE WHEN source = 'src0' THEN 'zero' ELSE 'any' END) AS author FROM documents")
def fill_defaults(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", I.fill(raw, F.when(F.col("source") == "src0", "zero").otherwise("any")).alias("author"))
