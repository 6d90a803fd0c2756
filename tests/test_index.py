"""The retrieval index against brute force: postings, segments, groups, best documents by bounds."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import index as I
from quillspark.operators import retrieval as R

FIELDS = {"A": "title", "B": "tags", "D": "text"}
SCHEMA = "doc_id long, title string, tags string, text string, term string, kind string"


def columns():
    return {f: F.col(c) for f, c in FIELDS.items()}


def words(text):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~।]+", (text or "").lower()) if w]


def sample(seed, n, vocabulary=60):
    """Documents of words with very uneven frequencies, some of them alike."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), vocabulary)}"
    line = lambda k: " ".join(word() for _ in range(k))
    out = [(i, line(rng.randint(0, 4)), rng.choice([None, "x y", "w1"]), line(rng.randint(1, 40)), "t", "k") for i in range(n)]
    out += [(n + i, *out[i][1:]) for i in range(n // 4)]  # equal scores
    return [*out, (2 * n, None, None, None, "t", "k"), (2 * n + 1, "", "", " ... ", "t", "k"), (None, "w1", "w1", "w1", "t", "k")]


def postings(rows):
    out = {}
    for i, *texts, _, _ in rows:
        at = 0
        for f, t in zip(FIELDS, texts, strict=True):
            for w in words(t):
                at += 1
                if i is not None:
                    out.setdefault((w, i), {}).setdefault(f, []).append(at)
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def built(spark, rows, parts=3):
    made = I.index_rows(frame(spark, rows, parts), "doc_id", "text", columns()).cache()
    p = made.where("kind = 'postings'").select("term", "doc_id", "tf", "wtf", "len", "first", "fields")
    return I.Index(p, made.where("kind = 'documents'").select("doc_id", "len", "text_md5", "embedding"), I.vocabulary_of(p))


def seen(index):
    rows = {(r.term, r.doc_id): ({x.field: list(x.positions) for x in r.fields}, r.tf, r.wtf, r.len, r["first"]) for r in index.postings.collect()}
    return rows, {r.doc_id: (r.len, r.text_md5, list(r.embedding)) for r in index.documents.collect()}, {r.term: r.df for r in index.vocabulary.collect()}


def wanted(rows):
    found, length = postings(rows), {}
    for (_, i), by in found.items():
        length[i] = length.get(i, 0) + sum(map(len, by.values()))
    weight = lambda by: sum(I.BM25_WEIGHTS[f] * len(p) for f, p in by.items())
    count = lambda by: sum(map(len, by.values()))
    p = {k: (by, count(by), weight(by), length[k[1]], min(min(x) for x in by.values())) for k, by in found.items()}
    docs = {i: (n, hashlib.md5(next(r[3] for r in rows if r[0] == i).encode()).hexdigest() if next(r[3] for r in rows if r[0] == i) is not None else None, [float(sum(count(by) for (w, j), by in found.items() if j == i and I.hash_place(w, 32) == x)) for x in range(32)]) for i, n in length.items()}
    return p, docs, {w: sum(1 for k in found if k[0] == w) for w, _ in found}


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_postings_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(I, "WORDS", most)
    rows = sample(1, 60)
    index = built(spark, rows)
    assert seen(index) == wanted(rows)
    assert {(r.term, r.doc_id, r.field, tuple(r.positions)) for r in index.by_field.collect()} == {(*k, f, tuple(p)) for k, by in postings(rows).items() for f, p in by.items()}
    assert {(r.term, r.doc_id, r.field) for r in index.in_fields.collect()} == {(*k, f) for k, by in postings(rows).items() for f in by}
    assert seen(built(spark, [])) == ({}, {}, {})


def test_no_row_per_word_is_shuffled(spark):
    plan = I.index_rows(frame(spark, sample(1, 5)), "doc_id", "text", columns())._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning" not in plan


def scores(rows, terms):
    found, length = postings(rows), {}
    for (_, i), by in found.items():
        length[i] = length.get(i, 0) + sum(map(len, by.values()))
    mean, out = sum(length.values()) / len(length), {}
    for t in sorted(set(terms)):
        own = {i: sum(I.BM25_WEIGHTS[f] * len(p) for f, p in by.items()) for (w, i), by in found.items() if w == t}
        for i, tf in own.items():
            out[i] = out.get(i, 0.0) + math.log(1 + (len(length) - len(own) + 0.5) / (len(own) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[i] / mean))
    return out


@pytest.mark.parametrize(("seed", "k", "worth"), [(2, 1, 1.0), (3, 5, 1.0), (4, 10, 1.0), (5, 300, 1.0), (3, 5, 0.0)])
def test_best_by_bounds_are_the_best_of_all(spark, monkeypatch, seed, k, worth):
    monkeypatch.setattr(R, "WORTH", worth)
    rows, rng = sample(seed, 150), random.Random(seed)
    index = built(spark, rows)
    queries = {q: [f"w{rng.randint(1, 60)}" for _ in range(rng.randint(1, 12))] for q in range(25)} | {90: ["w1"], 91: ["unknown"], 92: ["w1", "w2", "w3", "w59"]}
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, term string")
    got, exact = {}, {q: scores(rows, ts) for q, ts in queries.items()}
    for r in R.bm25_top(terms, index, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q, every in exact.items():
        best = sorted(((-round(s, 6), i) for i, s in every.items()))[:k]
        assert [(n + 1, i) for n, (s, i) in enumerate(best)] == [x[:2] for x in sorted(got.get(q, []))]
        assert all(abs(x[2] - every[x[1]]) < 2e-6 for x in got.get(q, []))
    pairs = spark.createDataFrame([(q, i) for q in (0, 1, 92) for i in (0, 3, 7, 149)], "query_id long, doc_id long")
    assert {(r.query_id, r.doc_id): r.score for r in R.bm25_within(pairs, terms, index).collect()} == {(q, i): pytest.approx(exact[q][i], abs=2e-6) for q in (0, 1, 92) for i in (0, 3, 7, 149) if i in exact[q]}


def test_rare_words_save_the_lists_of_frequent_ones(spark, monkeypatch):
    """Queries of a rare word and two that most documents have: less than a fifth of the postings are joined."""
    rng = random.Random(1)
    rows = [(i, None, None, " ".join([*(rng.choice(["common", "usual"]) for _ in range(rng.randint(1, 9))), *([f"rare{i % 100}"] * (1 + i % 3) if i % 2 else []), *(f"x{rng.randint(0, 99)}" for _ in range(9))]), "t", "k") for i in range(2000)]
    index, joined, real = built(spark, rows), [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, name="table": joined.append((name, out := real(df, name))) or out)
    queries = {q: [f"rare{2 * q + 1}", "common", "usual"] for q in range(20)}
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, term string")
    got = {(r.query_id, r["rank"]): r.doc_id for r in R.bm25_top(terms, index, 5).collect()}
    exact = {q: sorted((-round(s, 6), i) for i, s in scores(rows, ts).items())[:5] for q, ts in queries.items()}
    assert got == {(q, n + 1): i for q, best in exact.items() for n, (_, i) in enumerate(best)}
    candidates = dict(joined)["candidates"].count()
    assert candidates < 0.2 * terms.join(index.postings, "term").count() / 3


def test_bounds_hold(spark):
    rows = sample(6, 200)
    index = built(spark, rows)
    terms = spark.createDataFrame([(0, w) for w in wanted(rows)[2]], "query_id long, term string")
    bound = {r.term: r.bound for r in R._bm25_terms(terms, index, 1.2, 0.75)[0].collect()}
    assert all(s <= bound[w] + 1e-9 for w in bound for s in scores(rows, [w]).values())


@pytest.mark.parametrize("seed", [7, 8])
def test_all_and_any_groups_against_brute_force(spark, seed):
    rows, rng = sample(seed, 120), random.Random(seed)
    index, held = built(spark, rows), {}
    for w, i in postings(rows):
        held.setdefault(i, set()).add(w)
    groups = {q: [[f"w{rng.randint(1, 60)}" for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))] for q in range(30)} | {77: [["w1"], ["unknown"]]}
    terms = spark.createDataFrame([(q, n, t) for q, gs in groups.items() for n, g in enumerate(gs) for t in g], "query_id long, group_no long, term string")
    every = {(q, i) for q, gs in groups.items() for i, ws in held.items() if all(ws & set(g) for g in gs)}
    some = {(q, i) for q, gs in groups.items() for i, ws in held.items() if any(ws & set(g) for g in gs)}
    assert sorted(map(tuple, R.match_all(terms, index).collect())) == sorted(every)
    assert sorted(map(tuple, R.match_any(terms, index).collect())) == sorted(some)
    assert sorted(map(tuple, R.match_any(terms, index, R.match_all(terms, index)).collect())) == sorted(some - every)


# Words and canonical forms that synonyms must know.
SYNONYMS = [("নামাজ", "সালাত"), ("namaz", "সালাত"), ("ছালাত", "সালাত"), ("রোজা", "সিয়াম"), ("roza", "সিয়াম"), ("অজু", "ওযু"), ("উযু", "ওযু"), ("wudu", "ওযু"), ("oju", "ওযু"), ("রিবা", "সুদ"), ("interest", "সুদ"), ("ডিভোর্স", "তালাক"), ("talaq", "তালাক"), ("dog", "কুকুর"), ("saliva", "লালা"), ("purity", "পবিত্রতা")]


def test_candidate_groups(spark):
    table = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(SYNONYMS)], "variant string, canonical string, no int")
    asked = [w for w, _ in SYNONYMS] + ["ওযু", "dogs", "roza", "plain", "x", "running"]
    q = spark.createDataFrame([(1, i, w) for i, w in enumerate(asked)], "query_id long, group_no long, term string")
    got = {}
    for r in R.candidate_groups(q, table, ["ing", "s"]).collect():
        got.setdefault(asked[r.group_no], {})[r.term] = r.kind
    for w, canonical in SYNONYMS:
        assert got[w][canonical] == 1 and got[w][w] == 3
    assert {"অজু", "wudu", "উযু", "oju"} <= set(got["ওযু"]) and got["ওযু"]["ওযু"] == 1
    assert {"সালাত", "ছালাত", "namaz"} <= set(got["নামাজ"])
    assert got["dogs"] == {"কুকুর": 1, "dogs": 3, "dog": 4}
    assert got["plain"] == {"plain": 1} and got["x"] == {"x": 1} and got["running"] == {"running": 1, "runn": 2}
    many = spark.createDataFrame([(f"v{i:02}", "c", i) for i in range(20)], "variant string, canonical string, no int")
    kept = R.candidate_groups(spark.createDataFrame([(1, 1, "v19")], "query_id long, group_no long, term string"), many, [])
    assert {r.term for r in kept.collect()} == {"c", "v19", *(f"v{i:02}" for i in range(7))}  # the canonical form is the first of eight


def test_segments_are_as_if_built_anew(spark, tmp_path):
    held = {r[0]: r for r in sample(11, 40) if r[0] is not None}
    index = I.SegmentedIndex(spark, f"file://{tmp_path}/index", columns())
    assert seen(index.read()) == ({}, {}, {})
    index.delete(spark.createDataFrame([(5,)], "doc_id long"))
    index.add(frame(spark, list(held.values())))
    rng, fresh = random.Random(3), sample(12, 40)
    terms = spark.createDataFrame([(0, "w1"), (0, "w7"), (1, "w2"), (1, "w30")], "query_id long, term string")
    for step in range(5):
        if step == 1:
            gone = rng.sample(sorted(held), 9)
            index.delete(spark.createDataFrame([(i,) for i in [*gone, gone[0], 10**6, None]], "doc_id long"))
            held = {i: r for i, r in held.items() if i not in gone}
        elif step == 3:
            index.compact()
        else:  # new documents, changed ones, one without words, and deleted ones that come back
            new = [(rng.choice([i for i in range(70)]), *rng.choice(fresh)[1:]) for _ in range(8)] + [(3, None, None, "...", "t", "k")]
            last = {}
            for r in sorted(new, key=lambda r: r[3] or ""):
                last[r[0]] = r
            index.add(frame(spark, list(last.values())))
            held |= last
        now = index.read()
        assert seen(now) == wanted(list(held.values()))
        assert sorted(map(tuple, R.bm25_top(terms, now, 5).select("query_id", "doc_id", "rank").collect())) == sorted(map(tuple, R.bm25_top(terms, built(spark, list(held.values())), 5).select("query_id", "doc_id", "rank").collect()))
    assert [c[:2] for c in index.commits()] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6)]


def test_a_commit_that_broke_off_is_never_seen(spark, tmp_path, monkeypatch):
    index = I.SegmentedIndex(spark, f"file://{tmp_path}/index", columns())
    rows = sample(13, 10)[:10]
    index.add(frame(spark, rows[:6]))
    with monkeypatch.context() as broken:
        broken.setattr(I.SegmentedIndex, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            index.add(frame(spark, [(0, "other", "other", "other", "t", "k"), *rows[6:]]))
        with pytest.raises(OSError):
            index.compact()
    assert seen(index.read()) == wanted(rows[:6])
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))  # takes the number of those that broke off
    assert seen(index.read()) == wanted([r for r in rows[:6] if r[0] != 1])
    index.add(frame(spark, rows[6:]))
    assert seen(index.read()) == wanted([r for r in rows if r[0] != 1])


def test_a_table_that_is_written_anew_gets_a_new_index(spark, tmp_path):
    import os
    import time

    from quillspark.plans import retrieval as P

    path = f"{tmp_path}/documents.parquet"

    def write(text, at):
        spark.createDataFrame([(1, text, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(path)
        os.utime(path, (at, at))

    write("one two", time.time() - 100)
    assert {r.term for r in P.index(spark, str(tmp_path)).vocabulary.collect()} == {"one", "two", "en", "s"}
    write("six ten", time.time() - 50)  # as many bytes under the same name
    assert {r.term for r in P.index(spark, str(tmp_path)).vocabulary.collect()} == {"six", "ten", "en", "s"}


def test_words_of_a_query_without_others_are_stop_words(spark):
    got = spark.createDataFrame([("the of",), ("the cat",)], "t string").select(X.tokens(F.lower("t"), ["the", "of"]).alias("w")).collect()
    assert [r.w for r in got] == [["the", "of"], ["cat"]]


def test_the_vocabulary_is_merged(spark):
    """Its words with a letter deleted are many times as many, which the planner does not know."""
    from quillspark.operators.retrieval import fuzzy_terms

    words = spark.createDataFrame([("house",), ("mouse",), ("hose",), ("houses",)], "term string")
    near = fuzzy_terms(words.where("term = 'house'"), words)
    assert "strategy=merge" in near._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.term, r.edits) for r in near.collect()} == {("house", 0), ("mouse", 1), ("hose", 1), ("houses", 1)}


def test_words_of_a_long_query_are_counted_once(spark):
    from quillspark.operators.retrieval import _words_found

    rows = [(1, doc, i) for doc in (1, 2) for i in range(0, 200, doc) for _ in range(2)]
    got = _words_found(spark.createDataFrame(rows, "query_id long, doc_id long, i int"), {"words": F.lit(True), "even": F.col("i") % 2 == 0})
    assert {(r.doc_id, r.words, r.even) for r in got.collect()} == {(1, 200, 100), (2, 100, 100)}
