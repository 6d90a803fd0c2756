"""Clicks by keyed state and pages by cursor, against the batch form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ingest as I
from quillspark.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def attributed(rows, minutes=30):
    out = {}
    for i, ts, user, kind in rows:
        if kind == "view":
            near = [(t, j) for j, t, u, k in rows if k == "click" and u == user and ts < t <= ts + timedelta(minutes=minutes)]
            out[i] = (max(near)[1] if near else None, len(near))
    return out


def test_later_clicks_take_the_place_of_earlier_ones(spark, tmp_path):
    """Batches of a stream that is started again for each, with clicks before their views and rows that come late."""
    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=rng.randint(0, 400)), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["view", "view", "click", "other"])) for i in range(300)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 50)))  # within the hour that is waited
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    seen = []
    for n in range(4):
        part = rows[n * 75 : (n + 1) * 75]
        seen += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{src}/{n}")
        got = jobs.click_attribution(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), out)
        assert {r.event_id: (r.last_click, r.n_clicks) for r in got.collect()} == attributed(seen)
    again = jobs.click_attribution(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), out)
    assert {r.event_id: (r.last_click, r.n_clicks) for r in again.collect()} == attributed(rows)


def test_state_leaves_by_event_time(spark, tmp_path):
    src, out, start = f"{tmp_path}/in", f"file://{tmp_path}/out", datetime(2024, 1, 1)
    sizes = []
    for n in range(6):
        spark.createDataFrame([(2 * n, start + timedelta(hours=6 * n), 1, "view"), (2 * n + 1, start + timedelta(hours=6 * n, minutes=5), 1, "click")], SCHEMA).coalesce(1).write.parquet(f"{src}/{n}")
        got = jobs.click_attribution(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), out)
        assert {(r.event_id, r.last_click) for r in got.collect()} == {(2 * i, 2 * i + 1) for i in range(n + 1)}
        sizes.append(spark.read.format("statestore").load(f"{out}/state").count())
    assert max(sizes) <= 6  # old stretches are gone


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_pages_of_a_cursor(spark, limit):
    rng, start = random.Random(limit), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(days=rng.randint(0, 6)) if i % 9 else None) for i in range(120)]  # many ties
    d = spark.createDataFrame(rows, "id long, changed timestamp").repartition(3)
    for since in (None, ("2024-01-03", 60), ("2024-01-07", 10**6)):
        left = sorted((t, i) for i, t in rows if t is not None and (since is None or (t, i) > (datetime.fromisoformat(since[0]), since[1])))
        pages = I.sync_pages(d, "changed", "id", since, limit)
        got = {}
        for r in pages.collect():
            got.setdefault(r.page, []).append((r.changed, r.id))
        want = {n // limit + 1: left[n : n + limit] for n in range(0, len(left), limit)}
        assert {p: sorted(x) for p, x in got.items()} == want
        told = {r.page: (r.n, r.has_more, r.next_time, r.next_id) for r in I.sync_summary(pages, "changed", "id").collect()}
        assert told == {p: (len(x), p < len(want), *x[-1]) for p, x in want.items()}
        if want and limit == 50:  # a client that goes on with a page's cursor gets the rest
            time, key = want[1][-1]
            rest = I.sync_pages(d, "changed", "id", (str(time), key), limit)
            assert sorted((r.changed, r.id) for r in rest.collect()) == left[limit:]


def test_pages_fill_a_table(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    src = spark.createDataFrame([(2, "new"), (2, "newer"), (3, "new"), (None, "x")], "id long, v string")
    assert sorted(((r.id, r.v) for r in I.upsert(target, src, "id").collect()), key=str) == [(1, "old"), (2, "new"), (3, "new"), (None, "x")]
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    assert [tuple(r) for r in I.classify(twice, spark.createDataFrame([(1, "a"), (4, "z")], "id long, v string"), "id", ["v"]).orderBy("id").collect()] == [(1, "skipped"), (4, "inserted")]
    assert I.sync_pages(target.withColumn("t", F.lit(None).cast("timestamp")), "t", "id", None, 5).count() == 0


def test_states_do_not_grow_with_users(spark, tmp_path):
    start, src, out = datetime(2024, 1, 1), f"{tmp_path}/in", f"file://{tmp_path}/out"
    rows = [(3 * u + n, start + timedelta(seconds=7 * n + u % 60), u, kind) for u in range(300) for n, kind in enumerate(["view", "click", "click"])]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/0")
    got = jobs.click_attribution(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), out)
    assert {r.event_id: (r.last_click, r.n_clicks) for r in got.collect()} == {3 * u: (3 * u + 2, 2) for u in range(300)}
    assert spark.read.format("statestore").load(f"{out}/state").count() <= 2 * jobs.USER_GROUPS
