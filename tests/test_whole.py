"""Documents stored in one row: the same rows as by joins, made where the documents are."""

import random

import pytest
from pyspark.sql import functions as F
from test_index import built, columns, frame, sample, seen, wanted

from quillspark.functions import text as X
from quillspark.operators import index as I
from quillspark.operators import retrieval as R


def whole(spark, rows, parts=3):
    made = I.whole_rows(frame(spark, rows, parts), "doc_id", "text", columns()).cache()
    return I.Index.of_whole(made, I.vocabulary_of(I.Index.of_whole(made, None).postings))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_whole_documents_have_the_same_postings(spark, monkeypatch, most):
    monkeypatch.setattr(I, "WORDS", most)
    rows = sample(1, 60)
    index = whole(spark, rows)
    assert seen(index) == wanted(rows)
    assert got(index.in_fields) == got(built(spark, rows).in_fields)
    assert seen(whole(spark, [])) == ({}, {}, {})
    assert "Sort" not in plan(I.whole_rows(frame(spark, rows), "doc_id", "text", columns()))


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_matches_and_best_without_pairs_in_a_shuffle(spark, monkeypatch, cells):
    """the rows of the joins; candidates are never rows of a shuffle."""
    monkeypatch.setattr(R, "CELLS", cells)
    rows, rng = sample(5, 80), random.Random(2)
    index, other = whole(spark, rows), built(spark, rows)
    asked = [(q, g, f"w{rng.randint(1, 40)}") for q in range(12) for g in range(rng.randint(1, 3)) for _ in range(2)] + [(20, 0, "unknown"), (21, 0, "w1"), (21, 1, "unknown")]
    terms = spark.createDataFrame(asked, "query_id long, group_no long, term string")
    assert got(R.match_all(terms, index)) == got(R.match_all(terms, other)) != []
    assert got(R.match_any(terms, index)) == got(R.match_any(terms, other))
    assert "hashpartitioning" not in plan(R.match_all(terms, index))
    clauses = terms.withColumn("clause", F.col("group_no") % 2)
    assert got(R.match_clauses(clauses, index)) == got(R.match_clauses(clauses, other)) != []
    for k in (1, 7, 300):
        assert got(R.bm25_top(terms, index, k)) == got(R.bm25_top(terms, other, k))
    pairs = R.match_all(terms, other)
    assert got(R.bm25_within(pairs, terms, index)) == got(R.bm25_within(pairs, terms, other))
    monkeypatch.setattr(R, "HELD", 3)  # a query set that no task holds
    assert got(R.match_all(terms, index)) == got(R.match_all(terms, other))
    assert got(R.bm25_top(terms, index, 7)) == got(R.bm25_top(terms, other, 7))


def test_phrases_in_whole_documents(spark):
    """only documents with all words of a phrase give their places."""
    rows = sample(7, 80, 8)
    index, other = whole(spark, rows), built(spark, rows)
    asked = [(0, "w1 w1"), (1, "w1 w2 w1"), (2, "w3"), (3, "w2 w8"), (4, "w1 w1 w1"), (5, "w1 unknown")]
    phrases = spark.createDataFrame(asked, "query_id long, t string").select("query_id", F.posexplode(F.split("t", " ")).alias("p", "term")).select("query_id", (F.col("p") + 1).alias("pos"), "term")
    assert got(R.phrase_match(phrases, index)) == got(R.phrase_match(phrases, other)) != []


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_similar_titles_are_counted_where_they_are(spark, monkeypatch, cells):
    """all pairs and the best of them, as by joins; no candidates in a shuffle."""
    monkeypatch.setattr(R, "CELLS", cells)
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["anna", "hanna", "johanna", "ann", "tree", "trees", "été", "a"]) for _ in range(rng.randint(0, 5)))
    docs = spark.createDataFrame([(i, line(), rng.choice([line(), None])) for i in range(90)], "doc_id long, title string, question string").repartition(3)
    queries = spark.createDataFrame([(i, line()) for i in range(20)] + [(30, None), (31, "...")], "query_id long, text string")
    weights = {"title": 2.0, "question": 1.0}
    every = R._alike_joined(queries, docs, 0.2, weights)
    assert got(R.trigram_similarity(queries, docs, 0.2, weights)) == got(every) != []
    assert "hashpartitioning" not in plan(R.trigram_similarity(queries, docs, 0.2, weights))
    order = [F.desc("similarity"), F.col("doc_id")]
    assert got(R.trigram_similarity(queries, docs, 0.2, weights, 4)) == got(R.top_k(every, 4, order))
    less = R._alike_joined(queries, docs, 0.25, {"title": 1.0}).where("similarity < 0.99")
    assert got(R.trigram_similarity(queries, docs, 0.25, k=1, below=0.99)) == got(R.top_k(less, 1, order))
    monkeypatch.setattr(R, "HELD", 3)
    assert got(R.trigram_similarity(queries, docs, 0.2, weights, 4)) == got(R.top_k(every, 4, order))


def test_words_of_whole_documents_are_those_of_tokens(spark):
    texts = ["  a b  c-d ", "\x1fx\x1f y", "É​È ß", "", None, "...", "\n a", "۱ ১ 𝒳 x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in I.Index.of_whole(I.whole_rows(df, "doc_id", "text", {"D": F.col("text")}), None).rows("doc_id", "term", "fields").collect():
        found.setdefault(r.doc_id, []).extend((p, r.term) for x in r.fields for p in x.positions)
    want = {r.doc_id: r.w for r in df.select("doc_id", X.tokens(F.lower("text")).alias("w")).collect() if r.w}
    assert {i: [t for _, t in sorted(ws)] for i, ws in found.items()} == want


def test_a_query_set_without_words_reads_no_document(spark):
    """As where no query of a cascade lacks documents."""
    index, rows = whole(spark, sample(1, 30)), frame(spark, sample(1, 30))
    best = R.bm25_top(spark.createDataFrame([], "query_id long, term string"), index, 3)
    alike = R.trigram_similarity(spark.createDataFrame([], "query_id long, text string"), rows, 0.2, k=3)
    assert best.columns == ["query_id", "doc_id", "score", "rank"] and alike.columns == ["query_id", "doc_id", "similarity", "rank"]
    assert best.collect() == alike.collect() == [] and best.inputFiles() == alike.inputFiles() == []
    assert R.bm25_top(spark.createDataFrame([(1, "unknown")], "query_id long, term string"), index, 3).collect() == []


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_points_and_rules_without_pairs_in_a_shuffle(spark, monkeypatch, cells):
    """the best rows are those of the joins, and pairs of queries and documents are no rows of a shuffle."""
    monkeypatch.setattr(R, "CELLS", cells)
    rng = random.Random(6)
    word = lambda: rng.choice(["anna", "hanna", "johanna", "ann", "annas", "tree", "trees", "treed", "été", "étés", "a", "ab", "x"])
    line = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, line(rng.randint(0, 4)), rng.choice([None, "x y"]), line(rng.randint(1, 15)), "t", "k") for i in range(90)]
    rows += [(100 + i, *rows[i][1:]) for i in range(20)] + [(200, None, None, None, "t", "k"), (201, "", "", "...", "t", "k")]
    index, other = whole(spark, rows), built(spark, rows)
    asked = {(q, word()) for q in range(15) for _ in range(rng.randint(1, 6))} | {(20, "unknown"), (21, "unknown"), (21, "anna"), (22, "hann")}
    terms = spark.createDataFrame([(q, t, i + 1) for i, (q, t) in enumerate(sorted(asked))], "query_id long, term string, i int")
    points = ({"A": 4.5, "D": 2.5}, {"D": 1.0}, {"A": 2.0})
    best = lambda df, k: got(R.top_k(df, k, [F.desc("score"), F.col("doc_id")]))
    order = [F.desc("words"), F.col("typos"), F.col("proximity"), F.col("attribute"), F.desc("exact"), F.col("doc_id")]
    ranked = lambda df, k: got(R.top_k(R.top_k(df, 1, order, ["query_id", "text_md5"]).drop("rank"), k, order))
    scored, ruled = R.boosted(terms, other, *points).cache(), R.rule_columns(terms, other, ["A", "D"], 300).cache()
    for k in (1, 5, 300):
        assert best(R.boosted(terms, index, *points, k=k), k) == best(scored, k) != []
        assert ranked(R.rule_columns(terms, index, ["A", "D"], k), k) == ranked(ruled, k) != []
    held = R._Forms.of(terms, index)
    assert "hashpartitioning" not in plan(R._boosted_in_tasks(held, index, 5, *points, 3)) + plan(R._ruled_in_tasks(held, index, ["A"], 5, 8))
    none = terms.where("query_id < 0")
    assert R.boosted(none, index, *points, k=5).collect() == R.rule_columns(none, index, ["A"], 5).collect() == []
    monkeypatch.setattr(R, "HELD", 3)  # a query set that no task holds
    assert best(R.boosted(terms, index, *points, k=5), 5) == best(scored, 5)
    assert ranked(R.rule_columns(terms, index, ["A", "D"], 5), 5) == ranked(ruled, 5)
