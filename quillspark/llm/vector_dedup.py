"""Embedding near-dedup by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import release, stored
from quillspark.llm.components import components
from quillspark.llm.vectors import usable, width_of

LEAST = 0.9
#: Projections that a vector is listed under, those where its value is largest, and of them those in whose lists it looks for others.
LISTED, ASKED = 64, 12
#: Part of pairs at exactly the least cosine that may be lost; nearer pairs collide more often. Generated pairs that this is measured on.
LOST, CALIBRATION = 0.02, 4096
#: Rounds in which vectors that share one of their first projections gather round one of them.
ROUNDS = 3
#: Vectors of a group that are compared at once.
BLOCK = 512


def family_size(n: int) -> int:
    """Directions in each of two families. Every sum of one of each is a direction to project on, so they grow with the vectors and lists do not."""
    return 1 << int(np.clip(np.ceil(np.log2(4 * max(n, 1) ** 0.5)), 7, 14))


@lru_cache(maxsize=2)
def directions(width: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two families of m unit vectors, the same wherever they are made."""
    drawn = np.random.default_rng([width, m]).normal(size=(2, width, m))
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    return tuple(drawn.astype(np.float32))


def largest_projections(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The LISTED directions where each row of x has its largest projections, and these, falling.

    The projection on a sum of two directions is the sum of two projections, so the largest are sums of the largest of each family.
    """
    firsts, values, most = [], [], min(LISTED, m)
    for family in directions(x.shape[1], m):
        p = x.astype(np.float32) @ family
        at = np.argpartition(-p, most - 1, axis=1)[:, :most]
        own = np.take_along_axis(p, at, 1)
        order = np.lexsort((at, -own), axis=1)
        firsts.append(np.take_along_axis(at, order, 1))
        values.append(np.take_along_axis(own, order, 1))
    i, j = np.array([(i, j) for i in range(most) for j in range(min(most, LISTED // (i + 1)))]).T  # those before a sum in both are larger
    sums, names = values[0][:, i] + values[1][:, j], firsts[0][:, i] * m + firsts[1][:, j]
    order = np.lexsort((names, -sums), axis=1)[:, :LISTED]
    return np.take_along_axis(names, order, 1).astype(np.int32), np.take_along_axis(sums, order, 1)


def calibrate(width: int, m: int, least: float, pairs: int = CALIBRATION) -> tuple[int, float, int]:
    """(m, half width of windows, collisions that a pair needs), so that of generated pairs at cosine `least` at most LOST are lost.

    Directions are drawn alike all round, so what holds for these pairs holds for pairs of any data. Short vectors need fewer directions:
    m is halved until one collision is enough, down to where all vectors are in all lists and the windows alone decide.
    """
    rng = np.random.default_rng(7)
    u = rng.normal(size=(pairs, width))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    aside = rng.normal(size=(pairs, width))
    aside -= (aside * u).sum(axis=1, keepdims=True) * u
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    v = np.where(length > 1e-9, least * u + np.sqrt(1 - least**2) * aside / np.maximum(length, 1e-9), u)
    while True:
        (a, x), (b, y), gaps = largest_projections(u, m), largest_projections(v, m), []
        for ask, own, names, values in ((a, x, b, y), (b, y, a, x)):
            met = ask[:, :ASKED, None] == names[:, None, :]
            gaps.append(np.where(met, np.abs(own[:, :ASKED, None] - values[:, None, :]), np.inf).min(axis=2))
        gap = np.concatenate(gaps, axis=1)
        half = float(np.quantile(gap[np.isfinite(gap)], 0.999)) + 1e-5 if np.isfinite(gap).any() else 2.0  # of single precision
        enough = int(np.sort((gap <= half).sum(axis=1))[int(LOST * pairs)])
        if enough or m * m <= LISTED:
            return m, half, max(1, enough)
        m //= 2


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept. Two vectors link when their cosine is `least` or more.

    Vectors are projected on many directions and listed, by value, where their projections are largest; few vectors are as far out
    in a direction, but near ones are. Each looks into windows round its own value in the lists where it stands first, and pairs
    with enough collisions (see calibrate(): at most LOST of those at exactly `least` have fewer) are compared in full, so no
    pair below it links.

    Copies and near copies first gather into balls: those that share a first projection, round one of them that they link with. Balls
    collide as one and meet if, by the angles, any of theirs can link; their vectors are then compared block by block and counted
    where they are. Those within half the angle of a ball's centre link with one another without being compared, so a group of
    copies of any size makes no pairs. All others that link are compared one by one, as their number is asked for.

    Defined cases: vectors that are null, zero or hold null or non-finite entries, and those of another length than most have, link with
    nothing; a component's id is the smallest of its vectors' that are not null; rows that repeat an id or a vector link like any others,
    and each is kept whose id is the component's; an empty table gives an empty result; other columns are ignored.
    """
    given = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_v")).withColumn("k", F.monotonically_increasing_id())
    id_type, width, m = given.schema["_id"].dataType, width_of(rows, F.col(f"`{vector_col}`")), family_size(rows.count())
    m, half, enough = calibrate(width, m, least) if width else (m, 0.0, 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, (1 << 22) // m)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                fits, x = usable(batch.column("_v"), width)
                x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), 1e-320)
                length = np.linalg.norm(x, axis=1)
                fits[np.flatnonzero(fits)[length == 0]] = False
                u = x[length > 0] / length[length > 0][:, None]
                names, values = largest_projections(u, m) if len(u) else (np.zeros((0, LISTED), np.int32), np.zeros((0, LISTED), np.float32))
                offsets = pa.array(np.r_[0, np.cumsum(fits) * LISTED].astype(np.int32), mask=np.r_[~fits, False])
                units = iter(u)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), batch.column("_id"), pa.array([next(units).tobytes() if f else None for f in fits], pa.binary()), pa.ListArray.from_arrays(offsets, names.ravel()), pa.ListArray.from_arrays(offsets, values.ravel())], names=["k", "_id", "u", "names", "values"]
                )

    kinds = T.StructType([T.StructField("k", T.LongType()), T.StructField("_id", id_type), T.StructField("u", T.BinaryType()), T.StructField("names", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])
    base = stored(given.select("k", "_id", "_v").mapInArrow(project, kinds))
    unit = base.where("u IS NOT NULL").select("k", "u")

    def compared(pairs: DataFrame, bound: Column) -> DataFrame:
        """pairs (a, b, ...) with cos where it is `bound` or more."""
        both = pairs.join(unit.select(F.col("k").alias("a"), F.col("u").alias("ua")), "a").join(unit.select(F.col("k").alias("b"), F.col("u").alias("ub")), "b")

        def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("bound"), pa.array((_matrix(b.column("ua"), width) * _matrix(b.column("ub"), width)).sum(axis=1))], names=["a", "b", "bound", "cos"])

        return both.select("a", "b", bound.alias("bound"), "ua", "ub").mapInArrow(cosines, "a long, b long, bound double, cos double").where("cos >= bound").select("a", "b", "cos")

    # balls: (k, ball, cos with the ball's centre)
    balls, left = None, base.where("u IS NOT NULL").select("k", F.slice("names", 1, ROUNDS).alias("names"))
    for r in range(ROUNDS):
        keyed = left.select("k", F.col("names")[r].alias("name"))
        centres = keyed.groupBy("name").agg(F.min(F.struct(F.xxhash64("k", F.lit(r)), "k")).alias("c"), F.count("*").alias("n")).where("n > 1").select("name", F.col("c.k").alias("b"))
        near = stored(compared(keyed.join(centres, "name").where("k <> b").select(F.col("k").alias("a"), "b"), F.lit(least)))
        found = near.select(F.col("a").alias("k"), F.col("b").alias("ball"), "cos").unionByName(near.select(F.col("b").alias("k"), F.col("b").alias("ball"), F.lit(1.0).alias("cos")).distinct())
        balls = found if balls is None else balls.unionByName(found)
        left = left.join(found, "k", "left_anti")
    angle = float(np.arccos(least))
    core = F.coalesce(F.col("cos") >= float(np.cos(angle / 2)) + 1e-12, F.lit(True))
    placed = stored(base.where("u IS NOT NULL").join(balls, "k", "left").select("k", "u", "names", "values", F.coalesce("ball", "k").alias("ball"), F.col("ball").isNotNull().alias("grouped"), F.coalesce("cos", F.lit(1.0)).alias("cos"), core.alias("core")))
    sizes = stored(placed.where("grouped").groupBy("ball").agg(F.count("*").alias("size"), F.count_if("core").alias("cores"), F.acos(F.least(F.min("cos"), F.lit(1.0))).alias("radius")))

    # lists, collisions, candidates
    each = placed.select("ball", "grouped", F.posexplode(F.arrays_zip("names", "values")).alias("p", "x")).select("ball", "grouped", F.col("x.names").alias("name"), F.col("x.values").alias("lo"), F.col("x.values").alias("hi"), (F.col("p") < ASKED).alias("asks"))
    of_balls = each.where("grouped").groupBy("ball", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("asks").alias("asks"))
    lists = stored(each.where("NOT grouped").drop("grouped").unionByName(of_balls))
    asked = lists.where("asks").select(F.col("ball").alias("x"), "name", (F.col("lo") - half).alias("from"), (F.col("hi") + half).alias("to"))
    met = asked.join(lists.drop("asks"), "name").where("x <> ball AND hi >= from AND lo <= to")
    counted = met.groupBy(F.least("x", "ball").alias("a"), F.greatest("x", "ball").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("a", "b")
    radius = lambda side: sizes.select(F.col("ball").alias(side), F.col("radius").alias(f"r{side}"))
    reach = F.lit(angle) + F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))
    bound = F.when(F.col("ra").isNull() & F.col("rb").isNull(), F.lit(least)).otherwise(F.cos(F.least(reach, F.lit(float(np.pi)))) - 1e-9)
    pairs = stored(compared(counted.join(radius("a"), "a", "left").join(radius("b"), "b", "left"), bound))
    both = pairs.join(radius("a"), "a", "left").join(radius("b"), "b", "left")
    alone = both.where("ra IS NULL AND rb IS NULL").select("a", "b")

    # balls block by block; blocks of a ball's core are not compared with one another
    parts = F.ceil(F.col("size") / BLOCK)
    members = placed.join(sizes.select("ball", "size"), "ball", "left").select("ball", "core", F.pmod(F.xxhash64("k"), F.coalesce(parts, F.lit(1))).alias("part"), "k", "u")
    wanted = both.where("ra IS NOT NULL OR rb IS NOT NULL").select("a", "b").unionByName(sizes.where("size > cores").select(F.col("ball").alias("a"), F.col("ball").alias("b")))
    needed = wanted.select(F.col("a").alias("ball")).union(wanted.select("b")).distinct()
    blocks = stored(members.join(needed, "ball", "left_semi").groupBy("ball", "core", "part").agg(F.collect_list(F.struct("k", "u")).alias("l")))
    side = lambda s: blocks.select(F.col("ball").alias(s), F.struct("core", "part").alias(f"p{s}"), F.col("l.k").alias(f"k{s}"), F.array_join(F.transform("l.u", lambda x: F.hex(x)), "").alias(f"u{s}"))
    meet = wanted.join(side("a"), "a").join(side("b"), "b").where("a <> b OR (pa <= pb AND NOT (pa.core AND pb.core))").select("a", "b", (F.col("pa") == F.col("pb")).alias("same"), "ka", "kb", "ua", "ub")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(bytes.fromhex(r[c]), np.float64).reshape(-1, width) for c in ("ua", "ub"))
                linked = x @ y.T >= least
                one = r["a"] == r["b"] and r["same"]
                if one:
                    np.fill_diagonal(linked, False)
                for keys, n in ((r["ka"], linked.sum(axis=1)), *([] if one else [(r["kb"], linked.sum(axis=0))])):
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[at]), pa.array(n[at].astype(np.int64)), pa.array(np.full(len(at), r["a"], np.int64)), pa.array(np.full(len(at), r["b"], np.int64))], names=["k", "n", "a", "b"])

    compared_blocks = stored(meet.mapInArrow(count, "k long, n long, a long, b long"))
    single = alone.select(F.col("a").alias("k"), F.lit(1).cast("long").alias("n")).unionByName(alone.select(F.col("b").alias("k"), F.lit(1).cast("long").alias("n")))
    within = placed.where("grouped AND core").join(sizes.where("cores > 1").select("ball", "cores"), "ball").select("k", (F.col("cores") - 1).alias("n"))
    n_links = single.unionByName(compared_blocks.select("k", "n")).unionByName(within).groupBy("k").agg(F.sum("n").alias("n_links"))

    # components of balls, each named by the smallest id in it
    edges = alone.unionByName(compared_blocks.where("a <> b").select("a", "b").distinct())
    roots = components(edges).select(F.col("node").alias("ball"), "root")
    where = placed.select("k", "ball").join(roots, "ball", "left").select("k", F.coalesce("root", "ball").alias("root"))
    ids = base.select("k", "_id").join(where, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least_ids = ids.groupBy("root").agg(F.min("_id").alias("component_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = ids.join(least_ids.withColumn("_in", F.lit(True)), "root", "left").withColumn("component_id", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("_id")))
    result = stored(out.join(n_links, "k", "left").select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")))
    release(base, placed, lists, blocks)
    return result
