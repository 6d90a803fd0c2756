import hashlib

import duckdb
import pytest
from duck import connect, rows
from pyspark.sql import functions as F

from quillspark.plans.catalog import QUERIES, SQL

WITHOUT_SQL = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_but_two_have_sql():
    assert WITHOUT_SQL == ["cover_density", "knn_approx"]


def test_cover_density_of_the_tables(spark, sf):
    """Each score again from the places of its document, stretch by stretch."""
    from quillspark.operators.retrieval import CLASS_WEIGHTS
    from quillspark.plans.retrieval import covered

    places = {}
    for r in covered(spark, sf).collect():
        places.setdefault((r.query_id, r.doc_id), []).append((r.pos, r.term, r.field, r.need))
    got = QUERIES["cover_density"](spark, sf).collect()
    assert len(got) > 0
    for r in got:
        own, want = sorted(places[r.query_id, r.doc_id]), 0.0
        for i in range(len(own)):
            for j in range(i, len(own)):
                held = {p[1] for p in own[i : j + 1]}
                if len(held) == own[0][3]:
                    if len({p[1] for p in own[i + 1 : j + 1]}) < own[0][3]:
                        want += (j - i + 1) / sum(1 / CLASS_WEIGHTS[p[2]] for p in own[i : j + 1]) / (1 + own[j][0] - own[i][0] - (j - i))
                    break
        assert abs(r.score - want) < 1e-5


def test_approximate_neighbours_are_near_the_exact(spark, sf):
    from quillspark.operators.retrieval import knn
    from quillspark.plans.retrieval import _vectors

    q, v = _vectors(spark, sf)
    exact = {(r.query_id, r.doc_id) for r in knn(q, v, 10).collect()}
    near = {(r.query_id, r.doc_id) for r in QUERIES["knn_approx"](spark, sf).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_a_stream_that_is_started_again_goes_on(spark, tmp_path):
    from quillspark.streaming import jobs

    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "user_id long, n long"

    def add(number, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{number}")

    def table():
        got = jobs.table_of(spark.readStream.schema(schema).parquet(f"{src}/*"), out, ["user_id"])
        return sorted((r.user_id, r.n) for r in got.collect())

    add(0, [])
    assert table() == []
    add(1, [(i, 1) for i in range(100)])
    assert table() == [(i, 1) for i in range(100)]
    assert table() == [(i, 1) for i in range(100)]  # nothing new
    add(2, [(5, 2), (5, 3), (200, 2)])
    assert table() == sorted([(i, 2 if i == 5 else 1) for i in range(100)] + [(200, 2)])
    versions = spark.read.parquet(f"{out}/rows").groupBy("version").agg(F.count_distinct("bucket").alias("b")).orderBy("version").collect()
    assert versions[-1].b <= 2  # only what changed was written


def test_facets_of_more_than_thirty_sources(spark, tmp_path):
    d = spark.createDataFrame([(i, f"src{i % 40}", f"l{i % 35}") for i in range(100)], "doc_id long, source string, lang string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = rows(QUERIES["facet_counts"](spark, str(tmp_path)).toPandas())
    assert got == rows(con.execute(SQL["facet_counts"]).df()) and len(got) == 75


def test_vectors_count_all_words_of_a_text():
    import pandas as pd

    from quillspark.plans.retrieval import hashing_encoder

    texts = [" ".join(f"W{i}" for i in range(1000)), "", None, "a b a"]
    want = [[float(sum(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 == i for w in (t or "").lower().split())) for i in range(16)] for t in texts]
    assert hashing_encoder(pd.Series(texts)) == want and sum(want[0]) == 1000


def test_related_documents_are_filled_up_to_six(spark, tmp_path):
    langs = {i: "en" if i < 20 else "de" if i < 23 else "fr" if i == 23 else None for i in range(26)}
    spark.createDataFrame(list(langs.items()), "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, lang in langs.items():
        same = [j for j in sorted(langs, reverse=True) if j != i and lang is not None and langs[j] == lang][:6]
        rest = [j for j in sorted(langs, reverse=True) if j != i and j not in same]
        want += [(i, j, k + 1) for k, j in enumerate((same + rest)[:6])]
    got = QUERIES["related_docs"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.related, r["rank"]) for r in got) == sorted(want)


def test_postings_of_whole_titles_and_odd_ids(spark, tmp_path):
    """the title is the whole first line; ids that are there twice or not at all, and documents without a text, as SQL has them."""
    long = " ".join(f"w{i}" for i in range(60))
    texts = [(1, f"{long}\n{long} tail"), (1, "w1 w1 again\nw2"), (1, f"{long}\nw1"), (None, f"{long} none\nw3"), (None, "w1"), (2, None), (3, ""), (4, "w1\nw1")]
    made = [(i, t, f"src{n % 2}" if n != 4 else None, "en", len(t or "")) for n, (i, t) in enumerate(texts)]
    con = duckdb.connect()
    for at, held in (("odd", made), ("once", [r for r in made if r[0] != 1])):
        spark.createDataFrame(held, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{at}/documents.parquet")
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{at}/documents.parquet/*.parquet')")
        assert rows(QUERIES["build_postings"](spark, f"{tmp_path}/{at}").toPandas()) == rows(con.execute(SQL["build_postings"]).df())
    titles = {r.term for r in QUERIES["build_postings"](spark, f"{tmp_path}/odd").where("field = 'A'").collect()}
    assert {"w59", "none"} <= titles and "w3" in titles
