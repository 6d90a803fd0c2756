"""Text jobs and retrieval over the driver's tables: benchmark items are the queries, documents the corpus."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import expansion as E
from quillspark.operators import ingest as I
from quillspark.operators import retrieval as R
from quillspark.operators.index import VOCABULARY, WHOLE, Index, vocabulary_of, whole_rows
from quillspark.plans.ingest import QA_SQL, qa_pairs
from quillspark.plans.registry import query, table
from quillspark.sources.files import export_partitioned, scratch_dir, stored

# Small dictionaries for the corpus, which all operators take as arguments: stop words, suffixes in order, (variant, canonical).
STOP = ["the", "of", "and", "to", "in", "is", "that", "it", "der", "die", "und", "de", "la", "le", "el", "que"]
SUFFIXES = ["tion", "ing", "ed", "ly", "es", "er"]
SYNONYMS = [("this", "that"), ("are", "is"), ("was", "is"), ("with", "from"), ("or", "and"), ("for", "to"), ("an", "a"), ("das", "der"), ("los", "el"), ("un", "le")]
#: Places of hashed vectors.
DIM = 32
TITLE_SQL = "ti AS (SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 120) AS title, coalesce(substr(string_split(text, chr(10))[2], 1, 120), '') AS question FROM documents)"

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
SYN_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + ") AS s(variant, canonical)"


def _tok(col: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({col}), '[\s\pP\pS]+'), lambda w: w <> '')"


TOK_SQL = f"tok AS (SELECT doc_id, u.i AS pos, ws[u.i] AS term FROM (SELECT doc_id, {_tok('text')} AS ws FROM documents), LATERAL unnest(range(1, len(ws) + 1)) AS u(i))"
FTOK_SQL = f"""fa AS (SELECT doc_id, {_tok('substr(string_split(text, chr(10))[1], 1, 120)')} AS a, coalesce({_tok('source')}, []) AS b, coalesce({_tok('lang')}, []) AS c, {_tok('text')} AS d FROM documents),
fw AS (SELECT doc_id, a || b || c || d AS w, len(a) AS na, len(a) + len(b) AS nb, len(a) + len(b) + len(c) AS nc FROM fa),
ftok AS (SELECT doc_id, u.i AS pos, w[u.i] AS term, CASE WHEN u.i <= na THEN 'A' WHEN u.i <= nb THEN 'B' WHEN u.i <= nc THEN 'C' ELSE 'D' END AS field FROM fw, LATERAL unnest(range(1, len(w) + 1)) AS u(i))"""
POST_SQL = f"{FTOK_SQL}, post AS (SELECT term, doc_id, count(*) AS tf, sum(CASE field WHEN 'A' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END) AS wtf, min(pos) AS first FROM ftok GROUP BY ALL)"
QW_SQL = f"qw AS (SELECT item_id AS query_id, {_tok('text')} AS ws FROM benchmark)"
QT_SQL = f"{QW_SQL}, qt AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(list_filter(ws, lambda w: w NOT IN {STOP_SQL})) > 0 THEN list_filter(ws, lambda w: w NOT IN {STOP_SQL}) ELSE ws END) AS term FROM qw)"
BM25_SQL = f"""{POST_SQL}, {QT_SQL}, ln AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS mean FROM ln),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term) JOIN ln USING (doc_id), c GROUP BY ALL)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.token_table(docs(spark, d), "doc_id", F.col("text"))


def query_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.tokens(F.lower("text")).alias("ws"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of a query that are no stop words, or all if it has no others; each is a group of its own."""
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(X.tokens(F.lower("text"), STOP)).alias("term")).distinct()
    return terms.withColumn("group_no", F.xxhash64("term"))


def query_groups(spark: SparkSession, d: str) -> DataFrame:
    """For each of these words the candidates of which one is enough: query_id, group_no, term, kind."""
    synonyms = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(SYNONYMS)], "variant string, canonical string, no int")
    return R.candidate_groups(query_terms(spark, d), synonyms, SUFFIXES)


_BUILT: dict[tuple, str] = {}


def index(spark: SparkSession, d: str) -> Index:
    """The index of the documents' fields: title (A), source (B), language (C), whole text (D).

    It is built and stored once for the files of a session, as all queries start from it; if its folder is gone, or a file has another
    length or time than it had, it is built anew.
    """
    t = docs(spark, d)
    files = spark.read.format("binaryFile").load(t.inputFiles()).select("path", "length", "modificationTime").collect() if t.inputFiles() else []
    key = (spark.sparkContext.applicationId, *sorted(map(tuple, files)))
    fields = {"A": X.title_of(F.col("text")), "B": F.col("source"), "C": F.col("lang"), "D": F.col("text")}
    if key in _BUILT:
        try:
            return Index.of_whole(*[spark.read.schema(kind).parquet(f"{_BUILT[key]}/{name}") for name, kind in (("documents", WHOLE), ("vocabulary", VOCABULARY))])
        except AnalysisException:
            del _BUILT[key]
    path = scratch_dir(spark, "postings")
    whole_rows(t, "doc_id", "text", fields, dim=DIM).write.parquet(f"{path}/documents")
    vocabulary_of(Index.of_whole(spark.read.schema(WHOLE).parquet(f"{path}/documents"), None).rows("term", "wtf", "len")).write.parquet(f"{path}/vocabulary")
    _BUILT[key] = path
    return index(spark, d)


# --- text jobs ------------------------------------------------------------------------------------------

_NORM_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '[\x{{2018}}\x{{2019}}\x{{02bc}}`\x{{00b4}}]', '''', 'g'), '\s+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, md5({_NORM_SQL.format('nfc_normalize(text)')}) AS norm_md5 FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Only texts beyond ASCII go through the Arrow function that composes characters."""
    t = docs(spark, d).select("doc_id", "text")
    composed = t.where(X.non_ascii(F.col("text"))).withColumn("text", X.nfc(F.col("text"))).unionByName(t.where(~X.non_ascii(F.col("text"))))
    return composed.select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm_md5"))


@query("normalize_text_web", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '\s+', ' ', 'g'))) AS norm_md5 FROM documents")
def normalize_text_web(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(X.normalize(F.col("text"), apostrophes=False)).alias("norm_md5"))


@query("fold_arabic", r"SELECT doc_id, md5(translate(regexp_replace(replace(replace(text, 'a', 'أَ'), 'e', 'ى'), '[\x{064b}-\x{065f}\x{0670}\x{0640}]', '', 'g'), 'آأإى', 'اااي')) AS folded_md5 FROM documents")
def fold_arabic(spark: SparkSession, d: str) -> DataFrame:
    """The texts have no Arabic letters, so two of their letters are written as an Alif form with a vowel mark and as a final Ya."""
    arabic = F.replace(F.replace(F.col("text"), F.lit("a"), F.lit("أَ")), F.lit("e"), F.lit("ى"))
    return docs(spark, d).select("doc_id", F.md5(X.fold_arabic(arabic)).alias("folded_md5"))


@query("tokenize", f"WITH t AS (SELECT doc_id, {_tok('text')} AS w FROM documents), r AS (SELECT *, list_filter(w, lambda x: x NOT IN {STOP_SQL}) AS k FROM t) SELECT doc_id, CASE WHEN len(k) > 0 THEN len(k) ELSE len(w) END AS n_tokens, md5(array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ')) AS tokens_md5 FROM r")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("doc_id", X.tokens(F.lower("text"), STOP).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _stem_sql(w: str) -> str:
    return f"CASE WHEN length({w}) <= 3 THEN {w} " + " ".join(f"WHEN regexp_full_match({w}, '(.{{2,}}){s}') THEN substr({w}, 1, length({w}) - {len(s)})" for s in SUFFIXES) + f" ELSE {w} END"


_STEM_SQL = _stem_sql("term")
#: The second variant: words of three letters too, and an ending that loses one letter or two by what stands before it.
SPECIAL = [*X.endings(["tion", "ing"]), "^(.+(?:[aiou]|d))ed$", "^(.{2,}e)d$", *X.endings(["es", "er", "e"])]
_SPECIAL_SQL = """CASE WHEN length(term) <= 2 THEN term WHEN regexp_full_match(term, '..+tion') THEN left(term, -4) WHEN regexp_full_match(term, '..+ing') THEN left(term, -3)
  WHEN length(term) >= 4 AND ends_with(term, 'ed') THEN left(term, CASE WHEN substr(term, length(term) - 2, 1) IN ('a', 'i', 'o', 'u', 'd') THEN -2 ELSE -1 END)
  WHEN regexp_full_match(term, '..+e[sr]') THEN left(term, -2) WHEN regexp_full_match(term, '..+e') THEN left(term, -1) ELSE term END"""


@query("stem_tokens", f"WITH {TOK_SQL}, v AS (SELECT 1 AS variant, term, {_STEM_SQL} AS stem FROM tok UNION ALL SELECT 2, term, {_SPECIAL_SQL} FROM tok) SELECT variant, stem, count(DISTINCT term) AS n_terms, count(*) AS n FROM v GROUP BY ALL")
def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Stems of both variants, made once per distinct token."""
    counted = doc_tokens(spark, d).groupBy("term").agg(F.count("*").alias("n"))
    stems = F.array(F.struct(F.lit(1).alias("variant"), X.stem(F.col("term"), SUFFIXES).alias("stem")), F.struct(F.lit(2).alias("variant"), X.strip_first(F.col("term"), SPECIAL, 2).alias("stem")))
    return counted.select("n", F.inline(stems)).groupBy("variant", "stem").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n"))


def _synonyms(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(SYNONYMS, "variant string, canonical string"))  # a fixed list


#: Stand-in for an article that is written with the word.
ARTICLE = "th"


@query("canonicalize_terms", f"WITH {TOK_SQL} SELECT coalesce(a.canonical, CASE WHEN length(term) > {len(ARTICLE) + 1} THEN b.canonical END, term) AS canonical, count(*) AS n FROM tok LEFT JOIN {SYN_SQL.replace('s(', 'a(')} ON term = a.variant LEFT JOIN {SYN_SQL.replace('s(', 'b(')} ON term = '{ARTICLE}' || b.variant GROUP BY 1")
def canonicalize_terms(spark: SparkSession, d: str) -> DataFrame:
    """A word's canonical form, or that of the word without its article."""
    counted = doc_tokens(spark, d).groupBy("term").agg(F.count("*").alias("n"))
    bare = F.when(F.startswith("term", F.lit(ARTICLE)) & (F.length("term") > len(ARTICLE) + 1), F.substring("term", len(ARTICLE) + 1, 1000))
    known = counted.withColumn("bare", bare).join(_synonyms(spark).toDF("term", "own"), "term", "left").join(_synonyms(spark).toDF("bare", "other"), "bare", "left")
    return known.groupBy(F.coalesce("own", "other", "term").alias("canonical")).agg(F.sum("n").alias("n"))


_GROUP_SQL = f"g AS (SELECT variant AS term, canonical FROM {SYN_SQL} UNION SELECT canonical, canonical FROM {SYN_SQL})"


def _groups(spark: SparkSession) -> DataFrame:
    s = spark.createDataFrame(SYNONYMS, "variant string, canonical string")
    return s.select(F.col("variant").alias("term"), "canonical").union(s.select("canonical", "canonical")).distinct()


@query("expand_synonyms", f"WITH {QW_SQL}, {_GROUP_SQL}, t AS (SELECT DISTINCT query_id, unnest(ws) AS term FROM qw) SELECT query_id, t.term, b.term AS variant FROM t JOIN g a ON t.term = a.term JOIN g b ON a.canonical = b.canonical")
def expand_synonyms(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark)
    pairs = F.broadcast(g.join(g.select(F.col("term").alias("variant"), "canonical"), "canonical").select("term", "variant"))
    return query_words(spark, d).select("query_id", F.explode("ws").alias("term")).distinct().join(pairs, "term")


def _processed_sql(text: str) -> str:
    form = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS) + " ELSE w END"
    stem = _stem_sql("f")
    return f"array_to_string(flatten(list_transform(list_transform({_tok(text)}, lambda w: {form}), lambda f: CASE WHEN {stem} <> f AND length({stem}) >= 2 THEN [f, {stem}] ELSE [f] END)), ' ')"


#: Fields of an exported index, with how much of the answer goes in.
INDEX_ANSWER = 3000
INDEX_FIELDS = ("title", "tags", "question", "category", "answer")


def index_export(docs_: DataFrame, answer: int = INDEX_ANSWER) -> DataFrame:
    """doc_id, lang, source, created and the processed words of each field as one text: canonical forms, each with its stem behind it."""
    canonical = F.create_map(*[F.lit(x) for pair in SYNONYMS for x in pair])
    text = {"title": X.title_of(F.col("text")), "tags": F.col("source"), "question": F.substring(F.get(F.split("text", "\n"), F.lit(1)), 1, 120), "category": F.col("lang"), "answer": F.substring("text", 1, answer)}
    words = lambda c: X.tokens(F.lower(F.coalesce(c, F.lit(""))))
    return docs_.select("doc_id", "lang", "source", "created", *[F.array_join(X.processed(words(text[f]), canonical, lambda w: X.stem(w, SUFFIXES)), " ").alias(f) for f in INDEX_FIELDS])


@query(
    "export_index_table",
    f"""WITH v AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 <> 0 THEN 'first' ELSE 'second' END AS created, CASE WHEN doc_id % 3 <> 0 THEN text ELSE 'was ' || text END AS text FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 <> 0),
f AS (SELECT doc_id, lang, source, created, text, substr(string_split(text, chr(10))[1], 1, 120) AS title, coalesce(substr(string_split(text, chr(10))[2], 1, 120), '') AS question FROM v)
SELECT doc_id, lang, source, created, md5({_processed_sql('title')}) AS title, md5({_processed_sql("coalesce(source, '')")}) AS tags, md5({_processed_sql('question')}) AS question, md5({_processed_sql("coalesce(lang, '')")}) AS category, md5({_processed_sql(f'substr(text, 1, {INDEX_ANSWER})')}) AS answer FROM f""",
)
def export_index_table(spark: SparkSession, d: str) -> DataFrame:
    """A first export of four in five documents, into which two in three are put again: their words change, when they were made does not."""
    path, t = scratch_dir(spark, "index"), docs(spark, d).select("doc_id", "lang", "source", "text")
    first = index_export(t.where("doc_id % 5 <> 0").select("doc_id", "lang", "source", F.lit("first").alias("created"), F.concat(F.lit("was "), "text").alias("text")))
    second = index_export(t.where("doc_id % 3 <> 0").withColumn("created", F.lit("second")))
    export_partitioned(first, f"{path}/first", "lang", "doc_id")
    held = spark.read.schema(first.schema).parquet(f"{path}/first")
    export_partitioned(I.upsert(held, second, "doc_id", keep=["source", "created"]), f"{path}/second", "lang", "doc_id")
    return spark.read.schema(first.schema).parquet(f"{path}/second").select("doc_id", "lang", "source", "created", *[F.md5(f).alias(f) for f in INDEX_FIELDS])


@query("process_tokens", f"WITH {TOK_SQL}, k AS (SELECT doc_id, pos, coalesce(a.canonical, b.canonical, {_STEM_SQL}) AS w FROM tok LEFT JOIN {SYN_SQL.replace('s(', 'a(')} ON term = a.variant LEFT JOIN {SYN_SQL.replace('s(', 'b(')} ON {_STEM_SQL} = b.variant WHERE term NOT IN {STOP_SQL}) SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY pos)) AS words_md5 FROM k GROUP BY doc_id")
def process_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words without stop words, each as its canonical form, or that of its stem, or its stem. All in a document's own row: the dictionary is a short literal."""
    canonical = F.create_map(*[F.lit(x) for pair in SYNONYMS for x in pair])
    words = docs(spark, d).select("doc_id", F.filter(X.tokens(F.lower("text")), lambda w: ~w.isin(*STOP)).alias("w")).where(F.size("w") > 0)
    stems = words.select("doc_id", "w", F.transform("w", lambda w: X.stem(w, SUFFIXES)).alias("s"))
    kept = stems.select("doc_id", F.zip_with("w", "s", lambda w, s: F.coalesce(F.try_element_at(canonical, w), F.try_element_at(canonical, s), s)).alias("l"))
    return kept.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", " ")).alias("words_md5"))


@query("script_profile", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[\x{0980}-\x{09ff}]')) AS bengali, len(regexp_extract_all(text, '[\x{0600}-\x{06ff}]')) AS arabic FROM documents")
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", *[c.cast("long").alias(k) for k, c in X.script_counts(F.col("text")).items()])


@query("split_paragraphs", r"WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\n+') AS x FROM documents) SELECT doc_id, u.i - 1 AS pos, length(x[u.i]) AS n_chars, len(regexp_extract_all(x[u.i], '[\x{0600}-\x{06ff}]')) > 0.35 * length(x[u.i]) AS rtl FROM p, LATERAL unnest(range(1, len(x) + 1)) AS u(i)")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"\n+")).alias("pos", "x"))
    return p.select("doc_id", F.col("pos").cast("long"), F.length("x").cast("long").alias("n_chars"), (X.script_counts(F.col("x"))["arabic"] > 0.35 * F.length("x")).alias("rtl"))


@query("classify_intent", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\?\s*$|^(?i:what|why|how|is|are|was)\b') THEN 'question' WHEN len(regexp_extract_all(text, '[A-Za-z]')) * 2 > length(text) THEN 'romanised' ELSE 'topic' END AS intent FROM conversations WHERE role = 'user'")
def classify_intent(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    intent = F.when(t.rlike(r"\?\s*$|^(?i:what|why|how|is|are|was)\b"), "question").when(X.script_counts(t)["latin"] * 2 > F.length(t), "romanised").otherwise("topic")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


# Stand-ins for the dictionaries of a romanised language: phrases, words with their outputs, inflections, letters.
PHRASES = [("of the", "des"), ("in the", "im"), ("de la", "du")]
ROMANISED = [("the", ["der", "el"]), ("that", ["que"]), ("re", ["ra", "ro"]), ("on", ["ono"]), ("th", ["tho", "thi"]), ("er", ["er"]), ("ti", ["tia"]), ("in", ["en"]), ("ha", ["ah"]), ("ea", ["aea"])]
#: rule_no, suffix, characters taken off, what comes in their place, characters of the stem at least, ending, ending after a vowel.
INFLECTIONS = [(1, "entions", 7, "", 2, "entos", "ntos"), (2, "ing", 3, "", 2, "ando", "ndo"), (3, "ed", 2, "", 2, "ado", "do"), (4, "en", 2, "", 2, "en", "n"), (5, "tion", 4, "", 2, "cion", "cion"), (6, "at", 1, "", 3, "t", "t"), (7, "le", 2, "a", 2, "", ""), (8, "le", 2, "wa", 2, "", ""), (9, "sh", 2, "", 2, "s", "s")]
LETTERS = [("sh", "শ"), ("th", "থ"), ("ch", "চ"), ("kh", "খ"), ("an$", "ান"), ("^a", "আ"), ("a", "া"), ("e", "ে"), ("i", "ি"), ("o", "ো"), ("u", "ু"), ("n", "ন"), ("r", "র"), ("t", "ত"), ("d", "দ"), ("h", "হ"), ("l", "ল"), ("s", "স"), ("b", "ব"), ("m", "ম"), ("g", "গ")]


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS {names}"


def _letters_sql(col: str) -> str:
    for pattern, to in LETTERS:
        col = f"regexp_replace({col}, '{pattern}', '{to}', 'g')"
    return col


TRANS_SQL = f"""{QW_SQL}, ph(phrase, instead) AS {_values(PHRASES, "x(phrase, instead)").replace("(VALUES", "(SELECT * FROM (VALUES", 1)}), pw AS (SELECT query_id, u.i AS i, ws[u.i] AS word, a.instead, b.instead AS covered FROM qw, LATERAL unnest(range(1, len(ws) + 1)) AS u(i) LEFT JOIN ph a ON a.phrase = ws[u.i] || ' ' || ws[u.i + 1] LEFT JOIN ph b ON u.i > 1 AND b.phrase = ws[u.i - 1] || ' ' || ws[u.i]), pt AS (SELECT query_id, i, coalesce(instead, word) AS term FROM pw WHERE covered IS NULL),
dict AS (SELECT * FROM {_values([(w, i + 1, o) for w, os in ROMANISED for i, o in enumerate(os)], "x(variant, alt, output)")}), words AS (SELECT DISTINCT term FROM pt),
exact AS (SELECT term, 'dictionary' AS rule, alt, output FROM words JOIN dict ON term = variant),
inf AS (SELECT term, rule_no, left(term, length(term) - off) || put AS stem, ending, vowel FROM words, {_values(INFLECTIONS, "r(rule_no, suffix, off, put, least, ending, vowel)")} WHERE ends_with(term, suffix) AND length(term) - off >= least AND term NOT IN (SELECT term FROM exact)),
best AS (SELECT inf.* FROM inf WHERE stem IN (SELECT variant FROM dict) QUALIFY row_number() OVER (PARTITION BY term ORDER BY rule_no) = 1),
infl AS (SELECT term, 'inflection' AS rule, alt, output || CASE WHEN regexp_matches(output, '[aeiou]$') THEN vowel ELSE ending END AS output FROM best JOIN dict ON stem = variant UNION ALL SELECT term, 'inflection', 100 + alt, output FROM best JOIN dict ON stem = variant),
rest AS (SELECT term, 'letters' AS rule, 1 AS alt, {_letters_sql('term')} AS output FROM words WHERE term NOT IN (SELECT term FROM exact) AND term NOT IN (SELECT term FROM infl)),
tr AS (SELECT * FROM exact UNION ALL SELECT * FROM infl UNION ALL SELECT * FROM rest), tf AS (SELECT term, rule, arg_min(output, alt) AS output FROM tr GROUP BY ALL),
trq AS (SELECT query_id, string_agg(output, ' ' ORDER BY i) AS text FROM pt JOIN tf USING (term) GROUP BY query_id)"""


def transliterated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words of queries after phrases (query_id, i, term), and the outputs of their distinct words (term, rule, alt, output)."""
    phrases = spark.createDataFrame(PHRASES, "phrase string, output string")
    placed = E.replace_phrases(query_words(spark, d), phrases).select("query_id", F.posexplode("ws").alias("i", "term"))
    dictionary = spark.createDataFrame([(w, i + 1, o) for w, os in ROMANISED for i, o in enumerate(os)], "variant string, alt int, output string")
    rules = spark.createDataFrame(INFLECTIONS, "rule_no int, suffix string, off int, put string, least int, ending string, vowel string")
    return placed, E.transliterate(placed.select("term").distinct(), dictionary, rules, LETTERS)


@query("transliterate", f"WITH {TRANS_SQL} SELECT query_id, trq.text AS main, (SELECT string_agg(DISTINCT output, '|' ORDER BY output) FROM pt JOIN tr USING (term) WHERE pt.query_id = trq.query_id) AS terms, (SELECT count(*) FROM pt JOIN tf USING (term) WHERE pt.query_id = trq.query_id AND rule = 'inflection') AS inflected FROM trq")
def transliterate(spark: SparkSession, d: str) -> DataFrame:
    placed, outputs = transliterated(spark, d)
    sets = placed.join(outputs, "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("output")), "|").alias("terms"))
    return E.transliterated_text(placed, outputs).withColumnRenamed("text", "main").join(sets, "query_id").select("query_id", "main", "terms", "inflected")


# Sound classes of Latin letters, as an argument; the reference's are those of another script.
SOUNDS = {**dict.fromkeys("bpvf", "P"), **dict.fromkeys("ckqg", "K"), **dict.fromkeys("szx", "S"), **dict.fromkeys("dt", "T"), **dict.fromkeys("mn", "N"), **dict.fromkeys("jy", "J"), "h": "", "w": "U"}
HEADS = {"UJ": "OJ", "UR": "OR"}


def _sound_sql(word: str) -> str:
    out = f"upper(translate({word}, '{''.join(k for k, v in SOUNDS.items() if v)}h', '{''.join(SOUNDS.values())}'))"
    for c in "ABCDEFGIJKLMNOPQRSTUVWXYZ":
        out = f"regexp_replace({out}, '{c}+', '{c}', 'g')"
    for k, v in HEADS.items():
        out = f"regexp_replace({out}, '^{k}', '{v}')"
    return out


def latin_words(text: Column) -> Column:
    return F.filter(X.tokens(F.lower(text)), lambda w: w.rlike("^[a-z]+$"))


def _keys_sql(text: str) -> str:
    return f"list_distinct(list_filter(list_transform(list_filter({_tok(text)}, lambda w: regexp_full_match(w, '[a-z]+')), lambda w: {_sound_sql('w')}), lambda k: length(k) >= 2))"


@query("phonetic_keys", f"WITH {TITLE_SQL} SELECT doc_id, array_to_string(list_sort({_keys_sql('title')}), ' ') AS keys FROM ti")
def phonetic_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = X.phonetic_keys(latin_words(F.col("title")), SOUNDS, HEADS)
    return titles(spark, d).select("doc_id", F.array_join(F.array_sort(keys), " ").alias("keys"))


#: rule_no, pattern, canonical form, domain, subject, aspect, keywords: stand-ins for rules of a domain. The first that fits counts.
RULES = [(1, "(^| )(with|was)( |$)", "with what was", "state", "with", "was", "from that"), (2, "(^| )of .*the( |$)|(^| )the .*of( |$)", "of the whole", "part", "of", "the", "whole part rest are by at"), (3, "(^| )(de|la)( |$)", "de la langue", "romance", "de", "la", "les des"), (4, "(^| )(der|und)( |$)", "der und die", "german", "der", "und", "die den von")]
RULE_SQL = f"ru AS (SELECT query_id, arg_min(canonical, rule_no) AS canonical, arg_min(domain, rule_no) AS domain, arg_min(subject, rule_no) AS subject, arg_min(aspect, rule_no) AS aspect, string_split(arg_min(keywords, rule_no), ' ') AS keywords FROM qw, {_values(RULES, 'r(rule_no, pattern, canonical, domain, subject, aspect, keywords)')} WHERE regexp_matches(array_to_string(ws, ' '), pattern) GROUP BY query_id)"


def ruled(spark: SparkSession, d: str) -> DataFrame:
    """query_id, canonical, domain, subject, aspect, keywords (an array) of the queries that a rule fits."""
    rules = spark.createDataFrame([(*r[:-1], r[-1].split()) for r in RULES], "rule_no int, pattern string, canonical string, domain string, subject string, aspect string, keywords array<string>")
    return E.first_rules(query_words(spark, d).select("query_id", F.array_join("ws", " ").alias("text")), rules)


@query("rule_expand", f"WITH {QW_SQL}, {RULE_SQL} SELECT query_id, canonical, domain, subject, aspect, array_to_string(keywords, ' ') AS keywords FROM ru")
def rule_expand(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d).withColumn("keywords", F.array_join("keywords", " "))


@query("embedding_text", r"SELECT doc_id, md5(substr(string_split(text, chr(10))[1], 1, 120) || chr(10) || CASE WHEN length(text) <= 1500 THEN text ELSE regexp_replace(substr(text, 1, 1500), '\s+\S*\z', '') END) AS input_md5 FROM documents")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.length("text") <= 1500, F.col("text")).otherwise(F.regexp_replace(F.substring("text", 1, 1500), r"\s+\S*\z", ""))
    return docs(spark, d).select("doc_id", F.md5(F.concat(X.title_of(F.col("text")), F.lit("\n"), cut)).alias("input_md5"))


@query("normalize_queries", f"WITH {TRANS_SQL}, {RULE_SQL} SELECT query_id, coalesce(canonical, CASE WHEN latin AND trq.text <> input THEN trq.text END, input) AS normalized, CASE WHEN canonical IS NOT NULL THEN 'rules' WHEN latin AND trq.text <> input THEN 'transliteration' ELSE 'input' END AS provider FROM (SELECT query_id, array_to_string(ws, ' ') AS input, regexp_matches(array_to_string(ws, ' '), '[A-Za-z]') AS latin FROM qw) LEFT JOIN trq USING (query_id) LEFT JOIN ru USING (query_id)")
def normalize_queries(spark: SparkSession, d: str) -> DataFrame:
    """The canonical form of a rule, or the transliteration of a Latin query, or the input, whichever is there first."""
    placed, outputs = transliterated(spark, d)
    q = query_words(spark, d).select("query_id", F.array_join("ws", " ").alias("input")).join(E.transliterated_text(placed, outputs), "query_id", "left").join(ruled(spark, d), "query_id", "left")
    other = F.when(F.col("input").rlike("[A-Za-z]") & (F.col("text") != F.col("input")), F.col("text"))
    return q.select("query_id", F.coalesce("canonical", other, "input").alias("normalized"), F.when(F.col("canonical").isNotNull(), "rules").when(other.isNotNull(), "transliteration").otherwise("input").alias("provider"))


_EXPAND_SQL = f"""ex AS (SELECT query_id, array_to_string(ws, ' ') AS term, 1 AS kind FROM qw UNION ALL SELECT query_id, output, 2 FROM pt JOIN tr USING (term)
UNION ALL SELECT query_id, variant, 3 FROM (SELECT query_id, cg.term AS variant, min(list_position(ws, word)) AS i, min(kind) AS kind FROM cg JOIN qw USING (query_id) WHERE cg.term <> word GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i, kind, variant) <= 5
UNION ALL SELECT query_id, unnest(keywords[1:6]), 4 FROM ru)"""


_CAND_SQL = f"""{QT_SQL}, sy AS (SELECT * FROM {_values([(a, b, i) for i, (a, b) in enumerate(SYNONYMS)], "x(variant, canonical, no)")}), can AS (SELECT variant, arg_min(canonical, no) AS canonical FROM sy GROUP BY 1),
cw AS (SELECT query_id, term AS word, {_stem_sql("term")} AS stem FROM qt), cf AS (SELECT query_id, word, stem, CASE WHEN a.canonical <> word THEN a.canonical WHEN b.canonical <> stem THEN b.canonical ELSE word END AS form FROM cw LEFT JOIN can a ON word = a.variant LEFT JOIN can b ON stem = b.variant),
va AS (SELECT canonical, v FROM (SELECT canonical, v, min(no) AS no FROM (SELECT canonical, variant AS v, no FROM sy UNION ALL SELECT canonical, canonical, -1 FROM sy) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY no, v) <= 8),
ce AS (SELECT query_id, word, form AS term, 1 AS kind FROM cf UNION ALL SELECT query_id, word, {_stem_sql("form")}, 2 FROM cf UNION ALL SELECT query_id, word, word, 3 FROM cf UNION ALL SELECT query_id, word, stem, 4 FROM cf UNION ALL SELECT query_id, word, v, 5 FROM cf JOIN va ON form = canonical),
cg AS (SELECT query_id, word, term, min(kind) AS kind FROM ce WHERE kind IN (1, 3) OR length(term) >= 2 GROUP BY ALL)"""


@query("candidate_groups", f"WITH {_CAND_SQL} SELECT query_id, word, string_agg(term || ':' || kind, ' ' ORDER BY kind, term) AS candidates FROM cg GROUP BY ALL")
def candidate_groups(spark: SparkSession, d: str) -> DataFrame:
    """What a query asks for, word by word: each word's candidates with their kinds."""
    words = query_terms(spark, d).select("query_id", "group_no", F.col("term").alias("word"))
    said = F.struct("kind", "term", F.concat_ws(":", "term", F.col("kind").cast("string")).alias("t"))
    listed = query_groups(spark, d).groupBy("query_id", "group_no").agg(F.array_join(F.sort_array(F.collect_list(said))["t"], " ").alias("candidates"))  # a word's
    return listed.join(words, ["query_id", "group_no"]).select("query_id", "word", "candidates")


@query("expand_query", f"WITH {TRANS_SQL}, {RULE_SQL}, {_CAND_SQL.replace(QW_SQL + ', ', '')}, {_EXPAND_SQL} SELECT query_id, term, min(kind) AS kind FROM ex GROUP BY ALL")
def expand_query(spark: SparkSession, d: str) -> DataFrame:
    """Distinct union of the text (1), its transliterations (2), up to five further candidates of its words (3) and up to six terms of its rule (4)."""
    words = query_words(spark, d)
    placed, outputs = transliterated(spark, d)
    own = query_terms(spark, d).select("query_id", "group_no", F.col("term").alias("word"))
    near = query_groups(spark, d).join(own, ["query_id", "group_no"]).where("term <> word").join(words, "query_id").groupBy("query_id", "term").agg(F.min(F.array_position("ws", F.col("word"))).alias("i"), F.min("kind").alias("kind"))
    kinds = [
        words.select("query_id", F.array_join("ws", " ").alias("term"), F.lit(1).alias("kind")),
        placed.join(outputs, "term").select("query_id", F.col("output").alias("term"), F.lit(2).alias("kind")),
        R.top_k(near, 5, [F.col("i"), F.col("kind"), F.col("term")]).select("query_id", "term", F.lit(3).alias("kind")),
        ruled(spark, d).select("query_id", F.explode(F.slice("keywords", 1, 6)).alias("term"), F.lit(4).alias("kind")),
    ]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    return every.groupBy("query_id", "term").agg(F.min("kind").alias("kind"))


# --- retrieval -------------------------------------------------------------------------------------------


#: FTOK_SQL with the whole first line as the title.
_LINE_SQL = FTOK_SQL.replace("substr(string_split(text, chr(10))[1], 1, 120)", "string_split(text, chr(10))[1]")


def term_statistics(t: DataFrame) -> DataFrame:
    """(term, field, df, cf, first, places) of all postings of documents: title (the whole first line), source, language, whole text.

    Postings are made in a document's own row. Documents of one id count once in df, those without an id in all but df; a document without
    a text has no words.
    """
    fields = {"A": F.substring_index("text", "\n", 1), "B": F.col("source"), "C": F.col("lang"), "D": F.col("text")}
    t = t.where("text IS NOT NULL")
    again = stored(t.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "ids")

    def summed(rows: DataFrame, df: Column, *keys: str) -> DataFrame:
        each = Index.of_whole(whole_rows(rows, "doc_id", "text", fields, dim=DIM), None).by_field
        size, places = F.size("positions").cast("long"), F.aggregate("positions", F.lit(0).cast("long"), lambda s, p: s + p)
        return each.groupBy("term", "field", *keys).agg(df.alias("df"), F.sum(size).alias("cf"), F.min(F.array_min("positions")).alias("first"), F.sum(places).alias("places"))

    known = F.col("doc_id").isNotNull().cast("long")
    if again.isEmpty():
        return summed(t.withColumn("doc_id", known), F.sum("doc_id"))
    once = summed(t.join(again, "doc_id", "left_anti").withColumn("doc_id", known), F.sum("doc_id"))
    more = summed(t.join(again, "doc_id", "left_semi"), F.lit(1).cast("long"), "doc_id").drop("doc_id")
    return once.unionByName(more).groupBy("term", "field").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.min("first").alias("first"), F.sum("places").alias("places"))


@query("build_postings", f"WITH {_LINE_SQL} SELECT term, field, count(DISTINCT doc_id) AS df, count(*) AS cf, CAST(min(pos) AS INTEGER) AS first, CAST(sum(pos) AS BIGINT) AS places FROM ftok GROUP BY term, field")
def build_postings(spark: SparkSession, d: str) -> DataFrame:
    """Builds all postings in the call; what another query has stored is not used."""
    return term_statistics(docs(spark, d))


_ALL_SQL = f"{POST_SQL}, {_CAND_SQL}, need AS (SELECT query_id, count(DISTINCT word) AS need FROM cg GROUP BY query_id), h AS (SELECT query_id, doc_id, count(DISTINCT word) AS n FROM cg JOIN post USING (term) GROUP BY ALL), every AS (SELECT query_id, doc_id FROM h JOIN need USING (query_id) WHERE n = need)"


@query("match_all", f"WITH {_ALL_SQL} SELECT * FROM every")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    return R.match_all(query_groups(spark, d), index(spark, d))


@query("match_any", f"WITH {_ALL_SQL} SELECT query_id, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT query_id, doc_id FROM h EXCEPT SELECT query_id, doc_id FROM every) GROUP BY query_id")
def match_any(spark: SparkSession, d: str) -> DataFrame:
    q, i = query_groups(spark, d), index(spark, d)
    return R.match_any(q, i, R.match_all(q, i)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("prefix_match", f"WITH {TOK_SQL}, {QT_SQL}, p AS (SELECT DISTINCT substr(term, 1, 5) AS prefix FROM qt WHERE length(term) >= 3) SELECT prefix, term FROM p JOIN (SELECT DISTINCT term FROM tok) v ON starts_with(term, prefix)")
def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    prefixes = query_terms(spark, d).where(F.length("term") >= 3).select(F.substring("term", 1, 5).alias("prefix"))
    return R.prefix_match(prefixes, doc_tokens(spark, d))


@query("phrase_match", f"WITH {TOK_SQL}, {QW_SQL}, ph AS (SELECT query_id, u.i AS i, ws[u.i] AS term FROM qw, LATERAL unnest(range(1, len(ws) + 1)) AS u(i)), sz AS (SELECT query_id, count(*) AS size FROM ph GROUP BY 1), st AS (SELECT query_id, doc_id, pos - i AS start, count(*) AS c FROM ph JOIN tok USING (term) GROUP BY ALL) SELECT query_id, doc_id, count(*) AS n FROM st JOIN sz USING (query_id) WHERE c = size GROUP BY ALL")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    phrases = query_words(spark, d).select("query_id", F.posexplode("ws").alias("p", "term")).select("query_id", (F.col("p") + 1).alias("pos"), "term")
    return R.phrase_match(phrases, index(spark, d))


def bm25_run(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return R.bm25_top(query_terms(spark, d), index(spark, d), k)


TOP_SQL = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0} QUALIFY rank <= {1}"


@query("bm25", f"WITH {BM25_SQL} {TOP_SQL.format('bm', 10)}")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return bm25_run(spark, d)


def covered(spark: SparkSession, d: str) -> DataFrame:
    """Places of a query's words in the documents that have all of them: query_id, doc_id, pos, term, field, need."""
    q, i = query_terms(spark, d), index(spark, d)
    need = q.groupBy("query_id").agg(F.count("*").alias("need"))
    found = i.of_pairs(R.match_all(q, i), "doc_id", "term", "fields").join(q.select("query_id", "term"), ["query_id", "term"]).join(need, "query_id").select("query_id", "doc_id", "term", "need", F.inline("fields"))
    return found.select("query_id", "doc_id", F.explode("positions").alias("pos"), "term", "field", "need")


@query("cover_density")
def cover_density(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(R.cover_density(covered(spark, d)), 10, [F.desc("score"), F.col("doc_id")])


def titles(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Titles and, in the place of questions, what stands in the second line; with further columns of the documents."""
    return docs(spark, d).select("doc_id", *more, X.title_of(F.col("text")).alias("title"), F.coalesce(F.substring(F.get(F.split("text", "\n"), F.lit(1)), 1, 120), F.lit("")).alias("question"))


@query("title_bonus", lambda: f"WITH {BM25_SQL}, {TITLE_SQL}, {EVERY_SQL}, top AS ({TOP_SQL.format('bm', 10)}) SELECT query_id, doc_id, round(score + CASE WHEN contains(lower(title), array_to_string(ws, ' ')) THEN CASE WHEN (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM every) THEN 3.0 ELSE 2.0 END ELSE 0.0 END + 1.5 * {_sim_sql('g', 'h')}, 6) AS score FROM (SELECT *, {_tri('title')} AS h, {_tri(_QTEXT)} AS g FROM top JOIN ti USING (doc_id) JOIN qw USING (query_id))")
def title_bonus(spark: SparkSession, d: str) -> DataFrame:
    """Points for a title that holds the whole query, more where all words match, and for what the two have alike."""
    every = R.match_all(query_terms(spark, d), index(spark, d)).withColumn("all", F.lit(True))
    whole = F.array_join("ws", " ")
    top = bm25_run(spark, d).join(titles(spark, d), "doc_id").join(query_words(spark, d), "query_id").join(every, ["query_id", "doc_id"], "left")
    bonus = F.when(F.contains(F.lower("title"), whole), F.when(F.col("all"), 3.0).otherwise(2.0)).otherwise(0.0)
    alike = R.similarity_of(R.trigrams(whole), R.trigrams(F.col("title")))
    return top.select("query_id", "doc_id", F.round(F.col("score") + bonus + 1.5 * alike, 6).alias("score"))


def _tri(col: str) -> str:
    return f"list_distinct(flatten(list_transform({_tok(col)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


_QTEXT = "'' || array_to_string(ws, ' ')"


def _sim_sql(g: str, h: str) -> str:
    return f"round(coalesce(len(list_intersect({g}, {h})) / nullif(CAST(len({g}) + len({h}) - len(list_intersect({g}, {h})) AS DOUBLE), 0), 0), 6)"


SIM_SQL = f"""{TITLE_SQL}, qg AS (SELECT query_id, {_tri(_QTEXT)} AS g FROM qw), tg AS (SELECT doc_id, {_tri('title')} AS h FROM ti), sim AS (SELECT query_id, doc_id, {_sim_sql('g', 'h')} AS score FROM qg, tg),
tq AS (SELECT doc_id, {_tri('title')} AS h, {_tri('question')} AS k FROM ti), sim2 AS (SELECT query_id, doc_id, round(2 * st + sq, 6) AS score FROM (SELECT query_id, doc_id, {_sim_sql('g', 'h')} AS st, {_sim_sql('g', 'k')} AS sq FROM qg, tq) WHERE st > 0.2 OR sq > 0.2)"""
TRI_SQL = f"{QW_SQL}, {SIM_SQL}"
EVERY_SQL = "need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY query_id), h AS (SELECT query_id, doc_id, count(*) AS n FROM qt JOIN post USING (term) GROUP BY ALL), every AS (SELECT query_id, doc_id FROM h JOIN need USING (query_id) WHERE n = need)"


#: What the similarity of a title and of a question counts.
ALIKE = {"title": 2.0, "question": 1.0}


@query("trigram_similarity", f"WITH {TRI_SQL} {TOP_SQL.format('sim2', 25)}")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    texts = query_words(spark, d).select("query_id", F.array_join("ws", " ").alias("text"))
    return R.trigram_similarity(texts, titles(spark, d), 0.2, ALIKE, 25).withColumnRenamed("similarity", "score").select("query_id", "doc_id", "score", "rank")


#: A query with fewer documents goes on to the next stage.
FEW = 5
_GROUPED_SQL = f"""{_ALL_SQL}, ln AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS mean FROM ln), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM (SELECT DISTINCT query_id, term FROM cg) JOIN post USING (term) JOIN df USING (term) JOIN ln USING (doc_id), c GROUP BY ALL)"""
_CASC_SQL = f"""{_GROUPED_SQL}, {SIM_SQL},
s1 AS (SELECT query_id, doc_id, 1 AS stage, score FROM bm JOIN every USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
few1 AS (SELECT query_id FROM qw WHERE query_id NOT IN (SELECT query_id FROM s1 GROUP BY 1 HAVING count(*) >= 5)),
s2 AS (SELECT query_id, doc_id, 2 AS stage, score FROM bm WHERE query_id IN (SELECT query_id FROM few1) AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM s1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
two AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), few2 AS (SELECT query_id FROM qw WHERE query_id NOT IN (SELECT query_id FROM two GROUP BY 1 HAVING count(*) >= 5)),
s3 AS (SELECT query_id, doc_id, 3 AS stage, score FROM sim2 JOIN qw USING (query_id) WHERE length(array_to_string(ws, ' ')) >= 4 AND query_id IN (SELECT query_id FROM few2) AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM two) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 25),
casc AS (SELECT * FROM two UNION ALL SELECT * FROM s3)"""


def cascade_run(spark: SparkSession, d: str) -> DataFrame:
    """All groups of a query, then any, then similar titles, each for the queries that lack documents; scores are those of all candidates."""
    g, i = stored(query_groups(spark, d), "groups"), index(spark, d)
    texts = query_words(spark, d).select("query_id", F.array_join("ws", " ").alias("text"))
    of = lambda df, q: df.join(q, "query_id", "left_semi")
    return R.cascade(texts, [
        (lambda q: R.bm25_within(R.match_all(of(g, q), i), of(g, q), i), 50, 1),
        (lambda q: R.bm25_top(of(g, q), i, 50 + FEW), 50, 2),
        (lambda q: R.trigram_similarity(of(texts, q).where(F.length("text") >= 4), titles(spark, d), 0.2, ALIKE, 25 + FEW).withColumnRenamed("similarity", "score"), 25, 3),
    ], FEW)


@query("lexical_cascade", f"WITH {_CASC_SQL} SELECT * FROM casc")
def lexical_cascade(spark: SparkSession, d: str) -> DataFrame:
    return cascade_run(spark, d)


@query(
    "tiered_candidates",
    f"""WITH {POST_SQL}, {QT_SQL}, {RULE_SQL}, {_GROUP_SQL}, has AS (SELECT DISTINCT term, doc_id FROM post),
c1 AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(keywords[1:6]) AS term FROM ru) JOIN has USING (term)),
c2 AS (SELECT query_id, a.doc_id FROM ru JOIN has a ON a.term = subject JOIN has b ON b.term = aspect AND b.doc_id = a.doc_id),
f3 AS (SELECT query_id, u.i AS i, ks[u.i] AS term FROM (SELECT query_id, list_filter(ws, lambda w: w NOT IN {STOP_SQL})[1:3] AS ks FROM qw), LATERAL unnest(range(1, len(ks) + 1)) AS u(i)),
g3 AS (SELECT query_id, i, term FROM f3 UNION SELECT query_id, i, b.term FROM f3 JOIN g a ON f3.term = a.term JOIN g b ON a.canonical = b.canonical),
c3 AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, count(DISTINCT i) AS n FROM g3 JOIN has USING (term) GROUP BY ALL) JOIN (SELECT query_id, count(DISTINCT i) AS need FROM f3 GROUP BY 1) USING (query_id) WHERE n = need),
c AS (SELECT query_id, doc_id, 1 AS tier FROM c1 UNION SELECT query_id, doc_id, 1 FROM c2 UNION SELECT query_id, doc_id, 1 FROM c3 UNION SELECT query_id, doc_id, 2 FROM qt JOIN has USING (term)),
t AS (SELECT query_id, doc_id, min(tier) AS tier FROM c GROUP BY ALL)
SELECT query_id, tier, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM t) WHERE tier = best GROUP BY ALL""",
)
def tiered_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Conjunctions first: any term of the query's rule, its subject with its aspect, its first three words or synonyms of them. Only queries without any such document get those with one of their words."""
    q, p, rules, g = query_terms(spark, d), index(spark, d), ruled(spark, d), _groups(spark)
    group = lambda df, no, term: df.select("query_id", no.alias("group_no"), term.alias("term"))
    domain = group(rules, F.lit(1), F.explode(F.slice("keywords", 1, 6)))
    pair = group(rules, F.lit(1), F.col("subject")).unionByName(group(rules, F.lit(2), F.col("aspect")))
    first = query_words(spark, d).select("query_id", F.posexplode(F.slice(F.filter("ws", lambda w: ~w.isin(*STOP)), 1, 3)).alias("group_no", "term"))
    variants = F.broadcast(g.join(g.select(F.col("term").alias("v"), "canonical"), "canonical").select("term", "v"))  # fixed lists
    three = first.unionByName(first.join(variants, "term").select("query_id", "group_no", F.col("v").alias("term"))).distinct()
    clauses = reduce(DataFrame.unionByName, [c.withColumn("clause", F.lit(i)) for i, c in enumerate((domain, pair, three))])
    conjunctions = stored(R.match_clauses(clauses, p).groupBy("query_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")), "conjunctions").withColumn("tier", F.lit(1))
    lacking = q.join(conjunctions.select("query_id"), "query_id", "left_anti")
    rest = R.match_any(lacking, p).groupBy("query_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).withColumn("tier", F.lit(2))
    return conjunctions.unionByName(rest).select("query_id", "tier", "n", "first_doc")


# What each feature adds to a candidate's score, or multiplies it with.
FEATURES = {
    "phrase title": 240.0, "phrase text": 160.0, "canonical title": 260.0, "canonical text": 180.0, "keyword title": 360.0, "keyword text": 150.0,
    "both title": 420.0, "subject title": 300.0, "aspect title": 280.0, "both text": 180.0, "subject only": 0.12, "aspect only": 0.25,
    "word title": 40.0, "word text": 8.0, "all words": 340.0, "some words": 200.0, "few words": 0.4, "no subject": 0.15, "one word": 90.0, "synonym title": 30.0, "synonym text": 4.0, "sound": 18.0,
}


def _rerank_sql() -> str:
    w = FEATURES
    either = lambda xs, t, b: f"list_sum(list_transform({xs}, lambda x: CASE WHEN contains(title, x) THEN {t} WHEN contains(text, x) THEN {b} ELSE 0.0 END))"
    return f"""WITH {BM25_SQL}, {TITLE_SQL}, {RULE_SQL}, {_GROUP_SQL}, top AS ({TOP_SQL.format('bm', 10)}),
q AS (SELECT query_id, ws, list_filter(ws, lambda x: x NOT IN {STOP_SQL}) AS toks FROM qw),
sy AS (SELECT query_id, list(DISTINCT b.term) AS syns FROM (SELECT query_id, unnest(toks) AS term FROM q) t JOIN g a ON t.term = a.term JOIN g b ON a.canonical = b.canonical WHERE b.term <> t.term GROUP BY 1),
su AS (SELECT query_id, toks[1] AS w1, coalesce(list(DISTINCT b.term) FILTER (b.term IS NOT NULL), []) || [toks[1]] AS pool FROM q LEFT JOIN g a ON toks[1] = a.term LEFT JOIN g b ON a.canonical = b.canonical GROUP BY query_id, toks[1]),
cand AS (SELECT query_id, doc_id, score, lower(title) AS title, lower(text) AS text, array_to_string(ws, ' ') AS whole, toks, len(toks) AS n, coalesce(syns, []) AS syns, pool, w1, canonical, subject, aspect, coalesce(keywords, []) AS keywords,
  {_keys_sql("array_to_string(toks, ' ')")} AS qkeys, {_keys_sql('title')} AS tkeys FROM top JOIN ti USING (doc_id) JOIN documents USING (doc_id) JOIN q USING (query_id) LEFT JOIN sy USING (query_id) LEFT JOIN su USING (query_id) LEFT JOIN ru USING (query_id)),
f1 AS (SELECT *, 100 + score + CASE WHEN contains(title, whole) THEN {w['phrase title']} WHEN contains(text, whole) THEN {w['phrase text']} ELSE 0.0 END + CASE WHEN contains(title, canonical) THEN {w['canonical title']} WHEN contains(text, canonical) THEN {w['canonical text']} ELSE 0.0 END
  + coalesce({either('keywords', w['keyword title'], w['keyword text'])}, 0.0) AS s1, coalesce(contains(title, subject), false) AS st, coalesce(contains(text, subject), false) AS sb, coalesce(contains(title, aspect), false) AS pt, coalesce(contains(text, aspect), false) AS pb FROM cand),
f2 AS (SELECT *, CASE WHEN subject IS NULL THEN s1 WHEN st AND pt THEN s1 + {w['both title']} WHEN st AND pb THEN s1 + {w['subject title']} WHEN pt AND sb THEN s1 + {w['aspect title']} WHEN sb AND pb THEN s1 + {w['both text']} WHEN st AND n >= 2 THEN s1 * {w['subject only']} WHEN pt AND n >= 2 THEN s1 * {w['aspect only']} ELSE s1 END AS s2,
  len(list_filter(toks, lambda x: contains(title, x))) AS m FROM f1),
f3 AS (SELECT *, s2 + coalesce({either('toks', w['word title'], w['word text'])}, 0.0) AS s3 FROM f2),
f4 AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN m >= n THEN s3 + {w['all words']} WHEN m >= 2 THEN s3 + m / CAST(n AS DOUBLE) * {w['some words']} ELSE s3 * {w['few words']} END WHEN n = 1 THEN s3 + m * {w['one word']} ELSE s3 END AS s4 FROM f3),
f5 AS (SELECT *, CASE WHEN n >= 2 AND length(w1) >= 2 AND len(list_filter(pool, lambda x: contains(title, x) OR contains(text, x))) = 0 THEN s4 * {w['no subject']} ELSE s4 END AS s5 FROM f4)
SELECT query_id, doc_id, round(s5 + coalesce({either('syns', w['synonym title'], w['synonym text'])}, 0.0) + {w['sound']} * len(list_intersect(qkeys, tkeys)), 4) AS score FROM f5"""


@query("feature_rerank", _rerank_sql)
def feature_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best by BM25, scored again by features; each is a column, and the last one is the score."""
    g = _groups(spark)
    variants = g.join(g.select(F.col("term").alias("v"), "canonical"), "canonical").select("term", "v").distinct()
    q = query_words(spark, d).select("query_id", "ws", F.filter("ws", lambda w: ~w.isin(*STOP)).alias("toks"))
    near = F.broadcast(variants)  # fixed lists
    syns = q.select("query_id", F.explode("toks").alias("term")).join(near, "term").where("v <> term").groupBy("query_id").agg(F.collect_set("v").alias("syns"))
    pool = q.select("query_id", F.get("toks", 0).alias("term")).join(near, "term", "left").groupBy("query_id").agg(F.collect_set("v").alias("pool"))
    cand = bm25_run(spark, d).join(docs(spark, d).select("doc_id", F.lower(X.title_of(F.col("text"))).alias("title"), F.lower("text").alias("text")), "doc_id").join(q, "query_id")
    for more in (syns, pool, ruled(spark, d)):
        cand = cand.join(more, "query_id", "left")
    empty = F.array().cast("array<string>")
    keys = lambda words: X.phonetic_keys(words, SOUNDS, HEADS)
    cand = cand.withColumns({
        "whole": F.array_join("ws", " "), "syns": F.coalesce("syns", empty), "keywords": F.coalesce("keywords", empty), "first": F.get("toks", 0), "pool": F.array_append(F.coalesce("pool", empty), F.get("toks", 0)),
        "sounds": F.size(F.array_intersect(keys(F.filter("toks", lambda w: w.rlike("^[a-z]+$"))), keys(latin_words(F.col("title"))))),
    })
    return E.rerank(cand, FEATURES).select("query_id", "doc_id", F.round("score", 4).alias("score"))


# Points for a whole query in title or question, for each word in title, question or answer, and for each synonym in title or question.
KEYWORD_POINTS = {"base": 50, "phrase": (200, 120), "word": (35, 20, 8), "synonym": (25, 12)}


def _keyword_sql() -> str:
    p = KEYWORD_POINTS
    first = lambda fields, points, x: "CASE " + " ".join(f"WHEN contains({f}, {x}) THEN {n}" for f, n in zip(fields, points, strict=False)) + " ELSE 0 END"
    fields = ("title", "question", "text")
    each = lambda xs, points: f"coalesce(list_sum(list_transform({xs}, lambda x: {first(fields, points, 'x')})), 0)"
    return f"""WITH {BM25_SQL}, {TITLE_SQL}, {_GROUP_SQL}, top AS ({TOP_SQL.format('bm', 10)}), q AS (SELECT query_id, array_to_string(any_value(ws), ' ') AS whole, list(term) AS toks FROM qt JOIN qw USING (query_id) GROUP BY query_id),
sy AS (SELECT query_id, list(DISTINCT b.term) AS syns FROM qt t JOIN g a ON t.term = a.term JOIN g b ON a.canonical = b.canonical WHERE b.term <> t.term GROUP BY 1),
kc AS (SELECT query_id, doc_id, whole, toks, coalesce(syns, []) AS syns, lower(title) AS title, lower(question) AS question, lower(text) AS text FROM top JOIN q USING (query_id) LEFT JOIN sy USING (query_id) JOIN ti USING (doc_id) JOIN documents USING (doc_id))
SELECT query_id, doc_id, CAST({p['base']} + {first(fields, p['phrase'], 'whole')} + {each('toks', p['word'])} + {each('syns', p['synonym'])} AS BIGINT) AS score FROM kc"""


@query("keyword_score", _keyword_sql)
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    """Points by words as parts of title, question and answer, of the ten best by BM25; of each word and synonym the best field counts."""
    g = _groups(spark)
    variants = F.broadcast(g.join(g.select(F.col("term").alias("v"), "canonical"), "canonical").where("v <> term").select("term", "v"))  # fixed lists
    terms = query_terms(spark, d).select("query_id", "term")
    toks = terms.groupBy("query_id").agg(F.collect_list("term").alias("toks"))
    syns = terms.join(variants, "term").groupBy("query_id").agg(F.collect_set("v").alias("syns"))
    fields = titles(spark, d, "text").select("doc_id", *[F.lower(c).alias(c) for c in ("title", "question", "text")])
    cand = bm25_run(spark, d).select("query_id", "doc_id").join(query_words(spark, d), "query_id").join(toks, "query_id").join(syns, "query_id", "left").join(fields, "doc_id")
    p = KEYWORD_POINTS
    return E.keyword_points(cand.select("query_id", "doc_id", F.array_join("ws", " ").alias("whole"), "toks", F.coalesce("syns", F.array().cast("array<string>")).alias("syns"), "title", "question", "text"), ["title", "question", "text"], p["base"], p["phrase"], p["word"], p["synonym"])


def _letters_as_bytes(term: str) -> str:
    """The SQL engine counts edits of bytes, so letters beyond ASCII that the texts have are written as signs, which no word has."""
    return f"translate({term}, 'äöüßéèêëàâçùûîïôœæáíóúñ', '!#$%&()*+,-./:;<=>?@[]^_')"


_FUZZY_SQL = f"""voc AS (SELECT DISTINCT term FROM ftok), vb AS (SELECT term, {_letters_as_bytes('term')} AS b, length(term) AS n FROM voc), tb AS (SELECT DISTINCT term, {_letters_as_bytes('term')} AS b, length(term) AS n FROM qt),
fz AS (SELECT * FROM (SELECT tb.term AS query_term, vb.term, levenshtein(tb.b, vb.b) AS edits FROM tb, (VALUES (-1), (0), (1)) AS o(more) JOIN vb ON vb.n = tb.n + more) WHERE edits <= 1)"""


@query(
    "fuzzy_boosted",
    f"""WITH {FTOK_SQL}, {QT_SQL}, {_FUZZY_SQL}, has AS (SELECT DISTINCT term, doc_id, field FROM ftok WHERE field IN ('A', 'D')),
cl AS (SELECT DISTINCT query_id, qt.term AS word, doc_id, CASE field WHEN 'A' THEN 'title' ELSE 'text' END AS clause FROM qt JOIN fz ON qt.term = query_term JOIN has ON has.term = fz.term
  UNION SELECT query_id, qt.term, doc_id, 'exact' FROM qt JOIN has USING (term) WHERE field = 'D' UNION SELECT query_id, qt.term, doc_id, 'begins' FROM qt JOIN has ON length(qt.term) >= 3 AND starts_with(has.term, qt.term) WHERE field = 'A'),
sc AS (SELECT query_id, doc_id, CAST(sum(CASE clause WHEN 'title' THEN 4.5 WHEN 'text' THEN 2.5 WHEN 'begins' THEN 2.0 ELSE 1.0 END) AS DOUBLE) AS score FROM cl GROUP BY ALL) {TOP_SQL.format('sc', 10)}""",
)
def fuzzy_boosted(spark: SparkSession, d: str) -> DataFrame:
    scored = R.boosted(query_terms(spark, d).select("query_id", "term"), index(spark, d), {"A": 4.5, "D": 2.5}, {"D": 1.0}, {"A": 2.0}, k=10)
    return R.top_k(scored, 10, [F.desc("score"), F.col("doc_id")])


@query(
    "ranking_rules",
    f"""WITH {FTOK_SQL}, {QT_SQL}, {_FUZZY_SQL}, wo AS (SELECT query_id, term, list_position(ws, term) AS i FROM qt JOIN qw USING (query_id)),
m AS (SELECT query_id, i, wo.term AS word, doc_id, edits, min(pos) AS place, min(CASE field WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'C' THEN 2 ELSE 3 END) AS attr FROM wo JOIN fz ON wo.term = query_term JOIN ftok ON ftok.term = fz.term GROUP BY ALL),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, word, doc_id ORDER BY edits, place) = 1),
n AS (SELECT *, least(8, abs(lead(place) OVER (PARTITION BY query_id, doc_id ORDER BY i) - place)) AS gap FROM b),
h AS (SELECT query_id, doc_id, count(*) AS words, CAST(sum(edits) AS BIGINT) AS typos, CAST(coalesce(sum(gap), 0) AS BIGINT) AS proximity, min(attr) AS attribute, count(*) FILTER (edits = 0) AS exact FROM n GROUP BY ALL),
u AS (SELECT h.*, CAST(CASE query_id % 3 WHEN 0 THEN -n_chars WHEN 1 THEN n_chars ELSE 0 END AS DOUBLE) AS sort FROM h JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY words DESC, typos, proximity, attribute, sort, exact DESC, doc_id) = 1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, typos, proximity, attribute, sort, exact DESC, doc_id) AS rank FROM u QUALIFY rank <= 10""",
)
def ranking_rules(spark: SparkSession, d: str) -> DataFrame:
    """Words found, edits, distance between them, best field, the order that a query asks for (longest first, shortest first, none), exact words; one row per text."""
    words = query_terms(spark, d).join(query_words(spark, d), "query_id").select("query_id", "term", F.array_position("ws", F.col("term")).alias("i"))
    ruled_ = R.rule_columns(words, index(spark, d), ["A", "D", "C", "B"], 10)
    i = F.col("query_id")
    wanted = query_words(spark, d).where(i % 3 < 2).select("query_id", F.lit("n_chars").alias("by"), (i % 3 == 0).alias("down"))
    ruled_ = R.sort_rule(ruled_, wanted, docs(spark, d).select("doc_id", "n_chars"))
    order = [F.desc("words"), F.col("typos"), F.col("proximity"), F.col("attribute"), F.col("sort"), F.desc("exact"), F.col("doc_id")]
    return R.top_k(R.top_k(ruled_, 1, order, ["query_id", "text_md5"]).drop("rank", "text_md5"), 10, order)


_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6)"
_KNN_SQL = f"k AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score, b.label FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 {{0}})"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), v


@query("knn_exact", f"WITH {_KNN_SQL.format('AND b.label < 5')} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k QUALIFY rank <= 10")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return R.knn(q, v.where("label < 5"), 10)


@query("knn_postfilter", f"WITH {_KNN_SQL.format('')}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k QUALIFY rank <= 20) SELECT query_id, doc_id, score, rank FROM t WHERE label < 5")
def knn_postfilter(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return R.knn(q, v, 20).join(v.where("label < 5").select("doc_id"), "doc_id", "left_semi")


@query("knn_approx")
def knn_approx(spark: SparkSession, d: str) -> DataFrame:
    """Codes of one byte per number find thirty candidates a query, and only these are compared exactly."""
    return R.knn_approx(*_vectors(spark, d), 10)


@query("fit_vector_dim", "SELECT vec_id, 80 AS dim, CAST(embedding[1] AS DOUBLE) AS first, CAST(CASE WHEN len(embedding) >= 80 THEN embedding[80] ELSE 0 END AS DOUBLE) AS last FROM embeddings")
def fit_vector_dim(spark: SparkSession, d: str) -> DataFrame:
    v = R.fit_dim(F.col("embedding"), 80)
    return table(spark, d, "embeddings").select("vec_id", F.size(v).alias("dim"), v[0].cast("double").alias("first"), F.element_at(v, -1).cast("double").alias("last"))


_PLACE_SQL = f"CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {DIM}"
_COUNTS_SQL = "[" + ", ".join(f"CAST(count(*) FILTER (place = {i}) AS DOUBLE)" for i in range(DIM)) + "]"
_VEC_SQL = f"""dv AS (SELECT doc_id, {_COUNTS_SQL} AS v FROM (SELECT doc_id, {_PLACE_SQL} AS place FROM ftok) GROUP BY doc_id), qv AS (SELECT query_id, {_COUNTS_SQL} AS v FROM (SELECT query_id, {_PLACE_SQL} AS place FROM (SELECT query_id, unnest(ws) AS term FROM qw)) GROUP BY query_id),
vs AS (SELECT query_id, doc_id, round(list_dot_product(qv.v, dv.v) / sqrt(list_dot_product(qv.v, qv.v) * list_dot_product(dv.v, dv.v)), 6) AS score FROM qv, dv)"""
_FUSED_SQL = f"""{_CASC_SQL}, {_VEC_SQL}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, score DESC, doc_id) AS rank FROM casc), b AS ({TOP_SQL.format('vs', 50)}),
fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS ra, b.rank AS rb, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 6) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)"""


def vector_run(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The k nearest documents of each query by hashed vectors of both."""
    vectors = index(spark, d).documents.select("doc_id", "embedding")
    wanted = query_words(spark, d).select("query_id", F.explode("ws").alias("term"))
    return R.knn(R.hashed_vectors(wanted, "query_id", F.lit(1), DIM), vectors, k)


@query("rrf_fuse", f"WITH {_FUSED_SQL} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, doc_id) AS rank FROM fu")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search: the lexical cascade's list and the nearest vectors, fused by reciprocal ranks."""
    return hybrid(spark, d)


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    lexical = cascade_run(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("stage", F.desc("score"), "doc_id")))
    return R.rrf(lexical, vector_run(spark, d)).select("query_id", "doc_id", "score", "rank")


@query("interleave_sources", "WITH t AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY turn, CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, source, doc_id) AS rank FROM t WHERE turn <= 5")
def interleave_sources(spark: SparkSession, d: str) -> DataFrame:
    best = R.top_k(docs(spark, d).select("doc_id", "source", "lang", "n_chars"), 5, [F.desc("n_chars"), F.col("doc_id")], ["lang", "source"]).drop("rank")
    return R.interleave(best, "source", ["src3", "src1"], [F.desc("n_chars"), F.col("doc_id")], ["lang"]).select("doc_id", "lang", "rank")


@query("paginate", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT (count(*) + 19) // 20 FROM orders) AS total_pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return R.page_of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@query("count_matches", f"WITH {POST_SQL}, {QT_SQL} SELECT query_id, count(DISTINCT doc_id) AS total, count(DISTINCT CASE WHEN lang = 'en' THEN doc_id END) AS total_en FROM qt JOIN post USING (term) JOIN documents USING (doc_id) GROUP BY query_id")
def count_matches(spark: SparkSession, d: str) -> DataFrame:
    m = R.match_any(query_terms(spark, d), index(spark, d)).join(docs(spark, d).select("doc_id", "lang"), "doc_id")
    return m.groupBy("query_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("lang") == "en", 1)).alias("total_en"))


@query("did_you_mean", f"WITH {POST_SQL}, {QT_SQL}, {SIM_SQL}, {EVERY_SQL} SELECT query_id, doc_id, score FROM sim WHERE score > 0.25 AND score < 0.99 AND query_id NOT IN (SELECT query_id FROM every GROUP BY 1 HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1")
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    """The most similar title, for queries that few documents answer."""
    enough = R.match_all(query_terms(spark, d), index(spark, d)).groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 3")
    texts = query_words(spark, d).select("query_id", F.array_join("ws", " ").alias("text"))
    near = R.trigram_similarity(texts, titles(spark, d), 0.25, k=1, below=0.99)
    return near.join(enough, "query_id", "left_anti").select("query_id", "doc_id", F.col("similarity").alias("score"))


@query("facet_counts", "SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents WHERE source <> '' GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang <> '' GROUP BY lang")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = docs(spark, d).select(F.explode(F.array(F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")), F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value")))).alias("f")).select("f.*")
    return pairs.where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("facet_consolidate", "SELECT coalesce(CASE string_split(p_type, ' ')[1] WHEN 'SMALL' THEN 'Little' WHEN 'MEDIUM' THEN 'Little' WHEN 'LARGE' THEN 'Big' END, p_type) AS category, count(*) AS n FROM part GROUP BY 1")
def facet_consolidate(spark: SparkSession, d: str) -> DataFrame:
    dim = F.broadcast(spark.createDataFrame([("SMALL", "Little"), ("MEDIUM", "Little"), ("LARGE", "Big")], "head string, category string"))
    raw = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).withColumn("head", F.substring_index("p_type", " ", 1))
    return raw.join(dim, "head", "left").groupBy(F.coalesce("category", "p_type").alias("category")).agg(F.sum("n").alias("n"))


@query("browse_recent", "WITH o AS (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%') SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM o) AS total, (SELECT (count(*) + 99) // 100 FROM o) AS total_pages FROM o ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def browse_recent(spark: SparkSession, d: str) -> DataFrame:
    """Without a query: filters, the newest first, a page (as large as is allowed) and how many there are."""
    found = table(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_orderdate")
    return R.page_of(found, [F.desc("o_orderdate"), F.col("o_orderkey")], 0, 250)


@query("sample_per_source", "SELECT doc_id, source, row_number() OVER (ORDER BY turn, source, h, doc_id) AS rank FROM (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR) || ':7') AS h, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) AS turn FROM documents) WHERE turn <= 3")
def sample_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Three of each source by a hash, then one source after the other."""
    keyed = docs(spark, d).select("doc_id", "source", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))).alias("h"))
    picked = R.top_k(keyed, 3, [F.col("h"), F.col("doc_id")], ["source"]).drop("rank")
    return R.interleave(picked, "source", ["-"], [F.col("h"), F.col("doc_id")], []).select("doc_id", "source", "rank")  # three rows a source


_REL_SQL = """WITH c AS (SELECT a.doc_id, b.doc_id AS related, CASE WHEN a.lang = b.lang THEN 1 ELSE 2 END AS tier FROM documents a JOIN (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 7 OR row_number() OVER (ORDER BY doc_id DESC) <= 13) b ON a.doc_id <> b.doc_id)
SELECT doc_id, related, row_number() OVER (PARTITION BY doc_id ORDER BY tier, related DESC) AS rank FROM c QUALIFY rank <= 6"""


@query("related_docs", _REL_SQL)
def related_docs(spark: SparkSession, d: str) -> DataFrame:
    """The newest seven of each language are enough for six that are not the document itself; the newest of all fill them up.

    Of all documents 13 are enough: six that are listed already, the document itself, and six more.
    """
    t = docs(spark, d).select("doc_id", "lang")
    newest = R.top_k(t, 7, [F.desc("doc_id")], ["lang"]).select(F.col("doc_id").alias("related"), "lang", F.col("rank").alias("n"))
    lists = newest.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "related"))).alias("r"))  # seven a language
    every = t.select("doc_id").orderBy(F.desc("doc_id")).limit(13).agg(F.sort_array(F.collect_list("doc_id"), asc=False).alias("every"))  # one row
    same = F.coalesce(F.col("r.related"), F.array().cast("array<long>"))
    own = t.join(lists, "lang", "left").crossJoin(F.broadcast(every)).select("doc_id", "every", F.slice(F.filter(same, lambda x: x != F.col("doc_id")), 1, 6).alias("r"))
    more = F.filter("every", lambda x: (x != F.col("doc_id")) & ~F.array_contains("r", x))
    return own.select("doc_id", F.posexplode(F.slice(F.concat("r", more), 1, 6)).alias("p", "related")).select("doc_id", "related", (F.col("p") + 1).cast("long").alias("rank"))


#: Documents in a context at most, and characters of each one's answer.
CONTEXT_DOCS, CONTEXT_CHARS = 2, 1500
_PASSAGE_SQL = f"'[' || rank || ']' || chr(10) || 'Title: ' || title || chr(10) || 'Source: ' || source || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || substr(text, 1, {CONTEXT_CHARS}) || chr(10)"


@query(
    "rag_context",
    lambda: f"""WITH {BM25_SQL}, {TITLE_SQL}, {_VEC_SQL}, g1 AS (SELECT item_id AS query_id, u.i AS nth, item_id + u.i * u.i * 400 AS doc_id FROM benchmark, (VALUES (0), (1), (2)) AS u(i) WHERE item_id % 3 = 0),
r1 AS (SELECT query_id, doc_id, 1 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY nth, doc_id) AS rank FROM g1 JOIN documents USING (doc_id) QUALIFY rank <= {CONTEXT_DOCS}),
r2 AS (SELECT query_id, doc_id, 2 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs WHERE query_id % 3 = 1 AND query_id NOT IN (SELECT query_id FROM r1) QUALIFY rank <= {CONTEXT_DOCS}),
r3 AS (SELECT query_id, doc_id, 3 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE query_id NOT IN (SELECT query_id FROM r1 UNION SELECT query_id FROM r2) QUALIFY rank <= {CONTEXT_DOCS}),
r AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3), c AS (SELECT query_id, min(stage) AS stage, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS sources, md5(string_agg({_PASSAGE_SQL}, chr(10) ORDER BY rank)) AS context_md5 FROM r JOIN documents USING (doc_id) JOIN ti USING (doc_id) GROUP BY query_id)
SELECT item_id AS query_id, coalesce(stage, 0) AS stage, coalesce(sources, '') AS sources, context_md5 FROM benchmark LEFT JOIN c ON query_id = item_id""".replace(", c AS (SELECT query_id, min(stage)", ", ctx AS (SELECT query_id, min(stage)").replace("LEFT JOIN c ON", "LEFT JOIN ctx ON"),
)
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Documents to answer from: those given by id, else the nearest vectors where the query has one, else the best by words; each stage only for queries without any so far. Queries without any document have stage 0.

    A third of the queries come with three ids, some of which there are, and a third have a vector.
    """
    i, item = index(spark, d), F.col("query_id")
    texts, known = query_words(spark, d), docs(spark, d).select("doc_id")
    ids = F.posexplode(F.array(*[item + n * n * 400 for n in range(3)])).alias("at", "doc_id")
    of = lambda df, q: df.join(q, "query_id", "left_semi")
    words = texts.where(item % 3 == 1).select("query_id", F.explode("ws").alias("term"))
    stages = [
        (lambda q: of(texts, q).where(item % 3 == 0).select("query_id", ids).join(known, "doc_id").select("query_id", "doc_id", (-F.col("at")).cast("double").alias("score")), CONTEXT_DOCS, 1),
        (lambda q: R.knn(R.hashed_vectors(of(words, q), "query_id", F.lit(1), DIM), i.documents.select("doc_id", "embedding"), CONTEXT_DOCS), CONTEXT_DOCS, 2),
        (lambda q: R.bm25_top(of(query_terms(spark, d), q), i, CONTEXT_DOCS), CONTEXT_DOCS, 3),
    ]
    ranked = R.cascade(texts, stages, 1).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    told = ranked.join(titles(spark, d, "source", "text"), "doc_id")
    said = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"), *[said(n.title(), F.col(n)) for n in ("title", "source", "question")], said("Answer", F.substring("text", 1, CONTEXT_CHARS)))
    listed = told.groupBy("query_id").agg(F.min("stage").alias("stage"), F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc"), passage.alias("text")))).alias("l"))  # two a query
    context = listed.select("query_id", "stage", F.array_join("l.doc", ",").alias("sources"), F.md5(F.array_join("l.text", "\n")).alias("context_md5"))
    return texts.select("query_id").join(context, "query_id", "left").select("query_id", F.coalesce("stage", F.lit(0)).alias("stage"), F.coalesce("sources", F.lit("")).alias("sources"), "context_md5")


def hashing_encoder(texts: pd.Series) -> list[list[float]]:
    """The encoder that is used where no model is given: counts of hashed words in 16 places."""
    out = []
    for t in texts:
        counts = [0.0] * 16
        for w in re.findall(r"[^ \t\n\f\r]+", (t or "").lower()):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1.0
        out.append(counts)
    return out


@query(
    "pending_embeddings",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\f\r]+')) AS w FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16 AS place, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL)
SELECT vec_id AS doc_id, len(embedding) AS dim, NULL::BIGINT AS n_words, NULL::BIGINT AS weighed FROM embeddings
UNION ALL SELECT d.doc_id, 16, CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(sum(n * (place + 1)), 0) AS BIGINT) FROM documents d LEFT JOIN c USING (doc_id) WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY d.doc_id""",
)
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a vector get one from an encoder, the others keep theirs. Of the new ones, all counts and their sum by place are shown."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    filled = R.fill_vectors(docs(spark, d), v, hashing_encoder, "doc_id long, vector array<double>")
    new = F.size("vector") == 16
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    weighed = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return filled.select("doc_id", F.size("vector").alias("dim"), F.when(new, total).cast("long").alias("n_words"), F.when(new, weighed).cast("long").alias("weighed"))


@query("dedup_candidates", f"WITH {BM25_SQL}, {SIM_SQL}, l AS (SELECT query_id, doc_id, 1 AS list, rank FROM ({TOP_SQL.format('bm', 10)}) UNION ALL SELECT query_id, doc_id, 2, rank FROM ({TOP_SQL.format('sim2', 25)})) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list, rank) = 1")
def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best by words and then those with similar titles as one list, of each document the first row."""
    lists = bm25_run(spark, d).select("query_id", "doc_id", F.lit(1).alias("list"), "rank").unionByName(trigram_similarity(spark, d).select("query_id", "doc_id", F.lit(2).alias("list"), "rank"))
    return lists.groupBy("query_id", "doc_id").agg(F.min(F.struct("list", "rank")).alias("f")).select("query_id", "doc_id", "f.list", "f.rank")


@query("browse_interleaved_page", "WITH t AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY n, o_orderstatus) AS rank FROM t WHERE n > 10 AND n <= 21 QUALIFY rank <= 30")
def browse_interleaved_page(spark: SparkSession, d: str) -> DataFrame:
    best = R.top_k(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), 21, [F.desc("o_orderdate"), F.col("o_orderkey")], ["o_orderstatus"])
    return best.where("rank > 10").withColumn("r", F.row_number().over(W.orderBy("rank", "o_orderstatus"))).where("r <= 30").select("o_orderkey", F.col("r").alias("rank"))  # 11 rows a status


@query(
    "snippet",
    f"""WITH {BM25_SQL}, top AS ({TOP_SQL.format('bm', 3)}), p AS (SELECT query_id, list(term) AS terms FROM qt GROUP BY query_id),
w AS (SELECT query_id, doc_id, terms, ' ' || regexp_replace(lower(text), '[^\\pL\\pN]', ' ', 'g') || ' ' AS flat, text FROM top JOIN documents USING (doc_id) JOIN p USING (query_id)),
a AS (SELECT *, greatest(coalesce(list_min(list_filter(list_transform(terms, lambda t: strpos(flat, ' ' || t || ' ')), lambda x: x > 0)), 1) - 80, 1) AS place FROM w),
sn AS (SELECT *, replace(replace(replace(substr(text, place, 220), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS cut FROM a)
SELECT query_id, doc_id, CAST(place AS BIGINT) AS place, md5(cut) AS cut_md5, len(list_filter(regexp_split_to_array(regexp_replace(lower(cut), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda x: list_contains(terms, x))) AS n_marks FROM sn""",
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    """For the best documents of each query, where its 220 characters around the query's first word begin, their text, and how many of its words are marked in them."""
    top = bm25_run(spark, d, 3).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    q = query_terms(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    cut = top.join(q, "query_id").select("query_id", "doc_id", E.snippet_start(F.col("text"), F.col("terms")).alias("place"), "text", "terms")
    plain, marked = E.snippet(F.col("text"), F.col("terms"), F.col("place"), 220)
    return cut.select("query_id", "doc_id", F.col("place").cast("long").alias("place"), F.md5(plain).alias("cut_md5"), F.regexp_count(marked, F.lit("<mark>")).cast("long").alias("n_marks"))


GOLD_SQL = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item word for word: phrases narrow the pairs, the whole text decides."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    return phrase_match(spark, d).join(b, "query_id").join(docs(spark, d).select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("query_id", "doc_id")


_KEYWORD_SQL = "gk AS (SELECT query_id, list_sort(list_distinct(list_filter(ws, lambda w: length(w) = list_max(list_transform(ws, lambda x: length(x))))))[1] AS keyword FROM qw)"
EVAL_SQL = f"WITH {_FUSED_SQL}, {GOLD_SQL}, {_KEYWORD_SQL}, run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, doc_id) AS rank FROM fu QUALIFY rank <= 10), j AS (SELECT run.query_id, rank, CASE WHEN g.doc_id IS NOT NULL OR contains(lower(title || ' ' || question), keyword) THEN 1 ELSE 0 END AS rel FROM run JOIN gk ON gk.query_id = run.query_id JOIN ti ON ti.doc_id = run.doc_id LEFT JOIN gold g ON g.query_id = run.query_id AND g.doc_id = run.doc_id), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS k FROM j), p AS (SELECT query_id, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hit5, max(CASE WHEN rel = 1 THEN 1.0 / rank ELSE 0 END) AS rr, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(k + 1)) AS idcg FROM i GROUP BY 1) SELECT query_id, coalesce(hit5, 0) AS hit5, round(coalesce(rr, 0), 6) AS rr, round(coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0), 6) AS ndcg10 FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN p USING (query_id)"


def judged_run(spark: SparkSession, d: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The hybrid's k best of each query with a golden document, and which of them are relevant: golden documents, and those whose title or question has the query's keyword, its longest word."""
    gold = stored(golden(spark, d), "golden")
    run = stored(hybrid(spark, d).where(F.col("rank") <= k).join(gold.select("query_id").distinct(), "query_id", "left_semi"), "run")
    longest = F.array_max(F.transform("ws", lambda w: F.length(w)))
    keyword = F.array_min(F.filter("ws", lambda w: F.length(w) == longest))
    told = run.join(titles(spark, d), "doc_id").join(query_words(spark, d).select("query_id", keyword.alias("keyword")), "query_id")
    named = told.where(F.contains(F.lower(F.concat_ws(" ", "title", "question")), F.col("keyword"))).select("query_id", "doc_id")
    return run, gold.unionByName(named).distinct()


@query("eval_retrieval", EVAL_SQL)
def eval_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return R.evaluate(*judged_run(spark, d))


@query("index_join", f"WITH {_ALL_SQL} SELECT query_id, doc_id, source, n_chars FROM every JOIN documents USING (doc_id) WHERE lang = 'en'")
def index_join(spark: SparkSession, d: str) -> DataFrame:
    return match_all(spark, d).join(docs(spark, d).where("lang = 'en'").select("doc_id", "source", "n_chars"), "doc_id")


@query("exclude_ids", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def exclude_ids(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("fetch_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def fetch_ids(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")


@query("prefix_lookup", "WITH d AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents), r AS (SELECT item_id, substr(md5(CAST(item_id AS VARCHAR)), 1, 6 + item_id % 20) AS p FROM benchmark) SELECT item_id, doc_id FROM r JOIN d ON h = p OR starts_with(h, p)")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = docs(spark, d).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")).withColumn("k", F.substring("h", 1, 6))
    r = table(spark, d, "benchmark").select("item_id", F.expr("substring(md5(cast(item_id as string)), 1, 6 + cast(item_id % 20 as int))").alias("p")).withColumn("k", F.substring("p", 1, 6))
    return r.join(h, "k").where(F.startswith("h", "p")).select("item_id", "doc_id")


@query("dictionary_join", f"WITH {TOK_SQL} SELECT canonical, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok JOIN {SYN_SQL} ON term = variant GROUP BY canonical")
def dictionary_join(spark: SparkSession, d: str) -> DataFrame:
    return doc_tokens(spark, d).join(_synonyms(spark), F.col("term") == F.col("variant")).groupBy("canonical").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("merge_ranked", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY quality, doc_id DESC) AS rank FROM labels QUALIFY rank <= 50) SELECT doc_id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b USING (doc_id)")
def merge_ranked(spark: SparkSession, d: str) -> DataFrame:
    first = lambda df, *by: df.orderBy(*by).limit(50).select("doc_id", F.row_number().over(W.orderBy(*by)).alias("rank"))  # noqa: E731  of 50 rows
    a = first(docs(spark, d).select("doc_id", "n_chars"), F.desc("n_chars"), F.col("doc_id"))
    b = first(table(spark, d, "labels").select("doc_id", "quality"), F.col("quality"), F.desc("doc_id"))
    return a.select("doc_id", F.col("rank").alias("ra")).join(b.select("doc_id", F.col("rank").alias("rb")), "doc_id", "full_outer")


@query("pair_snapshot", f"WITH {QA_SQL} SELECT conv_id, count(*) AS n, CAST(sum(length(answer)) AS BIGINT) AS answer_chars FROM qa GROUP BY conv_id")
def pair_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return qa_pairs(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("answer")).alias("answer_chars"))
