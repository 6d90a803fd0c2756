"""Structured Streaming jobs. Each reads files and writes Parquet or runs foreachBatch; availableNow makes a bounded run of it."""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import analytics as A
from quillspark.operators import ingest as I
from quillspark.sources.files import stored


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder or, where the path is a single file, files of that name beside it. Times without a zone are taken as the session's."""
    first = spark.read.parquet(path)
    reader = spark.readStream.schema(first.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if all(f.rstrip("/").endswith(f"/{name}") for f in first.inputFiles()):
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(path)
    return stream.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in first.dtypes])


def run(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns the rows that it wrote."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


#: Buckets of keys of a table that a stream writes; a batch rewrites those that it has rows for.
BUCKETS = 32


def latest(spark: SparkSession, out: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The table that batches have written below `out`: of each bucket its newest version, from storage alone, so that a stream that
    is started again goes on where it was. Before any batch it is empty."""
    full = T.StructType([*schema, T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    try:
        rows = spark.read.schema(full).parquet(f"{out}/rows")
    except AnalysisException:  # no batch has written yet
        return spark.createDataFrame([], full)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row per bucket
    return rows.join(F.broadcast(newest), ["bucket", "version"])


def table_of(stream: DataFrame, out: str, key: list[str], mode: str = "append") -> DataFrame:
    """The last row of each key that a stream has given, as a table that is upserted batch by batch.

    A batch reads and rewrites the buckets of its own keys only, as a version of their own; a batch that is run again writes the
    same version anew. Of rows of one key in a batch the first by all columns counts.
    """
    spark, names = stream.sparkSession, stream.columns

    def step(batch: DataFrame, number: int) -> None:
        rows = stored(I.dedup_first(batch, key, [F.col(c) for c in names]).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")), "batch")
        touched = F.broadcast(rows.select("bucket").distinct())
        old = latest(spark, out, stream.schema, number).join(touched, "bucket", "left_semi").join(rows.select(*key), key, "left_anti")
        new = old.select(*names, "bucket").unionByName(rows.select(*names, "bucket")).withColumn("version", F.lit(number))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(f"{out}/rows")

    stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark, out, stream.schema).select(*names)


def visitor_state(stream: DataFrame, out: str) -> DataFrame:
    """The visitor table: a streaming aggregate gives the visitors that a batch changed, and these are upserted."""
    return table_of(A.visitor_rollup(stream), out, ["user_id"], "update")


def active_users(stream: DataFrame, out: str, width: str, slide: str, late: str) -> DataFrame:
    """Distinct visitors per sliding window. The state has a row per window and visitor until the watermark has passed; windows come out as they change, so that the last ones are there too."""
    seen = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
    per = table_of(seen.select(F.col("w.start").alias("start"), "user_id", "n"), out, ["start", "user_id"], "update")
    return per.groupBy("start").agg(F.count("*").alias("visitors"))


def rate_flags(stream: DataFrame, out: str, width: str, limit: int, late: str) -> DataFrame:
    """Windows of a user with more than `limit` events, as far as events have come."""
    counts = A.window_counts(stream.withWatermark("ts", late), "user_id", "ts", width, limit)
    return table_of(counts, out, ["user_id", "start"], "update")


#: Groups of users that the rows of a stretch of time are dealt to; a group's are looked at together.
USER_GROUPS = 8


def _attribute(minutes: int, keep: int):
    """State of a stretch of time of a group of users: their views, and the clicks that can follow them. Gives the views whose clicks have changed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        views, clicks = ([tuple(x) for x in held] for held in (json.loads(state.get[0]) if state.exists else ([], [])))
        old = dict(zip(views, _last(views, clicks, minutes), strict=True))
        for b in batches:
            for user, at, i, click in zip(b["user"].tolist(), b["at"].tolist(), b["event_id"].tolist(), b["click"].tolist(), strict=True):
                (clicks if click else views).append((user, at, i))
        views, clicks = sorted(set(views)), sorted(set(clicks))
        state.update((json.dumps([views, clicks]),))
        state.setTimeoutTimestamp(max((int(key[1]) + 2) * minutes * 60_000 + keep, state.getCurrentWatermarkMs() + 1))  # the stretch's last click
        changed = [(v[2], *found) for v, found in zip(views, _last(views, clicks, minutes), strict=True) if old.get(v) != found]
        yield pd.DataFrame({"event_id": pd.Series([r[0] for r in changed], dtype="int64"), "last_click": pd.Series([r[1] for r in changed], dtype="Int64"), "n_clicks": pd.Series([r[2] for r in changed], dtype="int64")})

    return step


def _last(views: list[tuple[str, int, int]], clicks: list[tuple[str, int, int]], minutes: int) -> list[tuple[int | None, int]]:
    """Of each view (user, microseconds, event_id) the user's last click within `minutes` after it, and how many there are; clicks are sorted."""
    found = []
    for user, at, _ in views:
        low, high = (bisect_right(clicks, (user, to, math.inf)) for to in (at, at + minutes * 60_000_000))
        found.append((clicks[high - 1][2] if high > low else None, high - low))
    return found


def click_attribution(stream: DataFrame, out: str, minutes: int = 30, late: str = "1 hour", keep: int = 0) -> DataFrame:
    """(event_id, last_click, n_clicks) of all views (event_id, ts, user_id, event_type): each later click of the user within `minutes` takes the place of the one before.

    A state is a stretch of `minutes` of a group of users: views are dealt to their own stretch, clicks to theirs and the one before, so no state
    holds more than two stretches of its users, and it leaves once the watermark has passed the last click that it can have. There are
    USER_GROUPS states a stretch however many users there are. Clicks may come before their views. What changes is upserted by event, so a stream that is started again goes on.
    """
    width = minutes * 60_000_000
    at, click = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_type") == "click"
    rows = stream.where("event_type IN ('view', 'click')").withWatermark("ts", late).select("event_id", "ts", F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user"), at.alias("at"), click.alias("click"))
    own = F.floor(F.col("at") / width)
    dealt = rows.withColumn("stretch", F.explode(F.when(F.col("click"), F.array(own, own - 1)).otherwise(F.array(own))))
    found = dealt.withColumn("users", F.pmod(F.xxhash64("user"), F.lit(USER_GROUPS))).groupBy("users", "stretch").applyInPandasWithState(_attribute(minutes, keep), "event_id long, last_click long, n_clicks long", "held string", "update", GroupStateTimeout.EventTimeTimeout)
    return table_of(found, out, ["event_id"], "update")
