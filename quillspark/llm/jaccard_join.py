"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance d is a metric, and two documents link when d <= t. Equal sets are one class, and a hash of 64 bits stands for a
shingle and for a set.

1. Candidates. Most sets have no link, and leave first. Of two linked sets of n and m shingles, sorted by hash, the first
   n - ceil((1 - t) n) + l and as many of m have l in common. These are sorted by hash over the cluster, neighbours show which
   are shared, and a set that shares fewer than l leaves. The others keep only shingles that two of them have.
2. Pivots. Almost all pairs of documents are at distance 1, so pivots are taken where documents are: sets with the same least
   shingle by a hash have their smallest as a pivot. What lies within t of a pivot is covered; what is not goes into another
   round with another hash, until each set is covered or a pivot itself.
3. Voronoi regions. A set belongs to the region of the nearest pivot that covered it, so it has a link to that pivot, and only
   links between regions of different components are left to find.
4. Windows. If x links with y of the region of q, d(x, q) <= t + d(y, q) <= t + radius(q) by the triangle inequality, so x is
   replicated to the regions of those pivots, of other components, and nowhere else. As that is 2 t at most, the rarest shingles of
   x and q have one in common, and shingles that many sets have stand too late in both to bring a pair together.
5. Regions are joined in tasks, recursively by pivots of their own (`join_region`). A region that is too large for one task is
   dealt as a grid: each part of its own sets meets each part of its replicas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mix, release, runs, stored, text_chunks
from quillspark.llm.components import components

#: Shingles of a region's own sets, and of its replicas, that one task joins.
REGION = 1 << 21
#: Rounds of pivots; sets that none has covered then are pivots themselves.
ROUNDS = 6
#: A set has a prefix longer by a SPARE-th of its shingles than a link needs, so that a few shared lines make no candidate.
SPARE = 20
_STEP = np.array([mix(np.array([0x51ED270B + 977 * i], np.uint64))[0] | np.uint64(1) for i in range(64)], np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first text, first shingle of each text and the end, sorted distinct shingle hashes)."""
    for lo, hi, w in text_chunks(texts):
        count = np.diff(w.first)
        doc = np.repeat(np.arange(hi - lo), count)
        total = np.zeros(max(len(w.hash) - words + 1, 0), np.uint64)
        for k in range(words):
            total += w.hash[k : k + len(total)] * _STEP[k % 64]
        whole = doc[: len(total)] == doc[words - 1 :] if len(total) else np.zeros(0, bool)
        owner, hashes = doc[: len(total)][whole], mix(total[whole])
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            one = [mix(np.array([(w.hash[w.first[i] : w.first[i + 1]] * _STEP[: count[i]]).sum() + np.uint64(0xABCD * int(count[i]))], np.uint64))[0] for i in short]
            owner, hashes = np.r_[owner, short], np.r_[hashes, np.array(one, np.uint64)]
        if hi - lo < 1 << 16:  # by hash, and then by text in a stable order, which short numbers are put into without comparing them
            order = np.argsort(hashes)
            order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
        else:
            order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[new], hashes[new]
        yield lo, np.searchsorted(owner, np.arange(hi - lo + 1)), hashes


def class_ids(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash per set; equal sets have equal ones."""
    total = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * _STEP[7])


def _lists(first: np.ndarray, last: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Lists flat[first[i]:last[i]] as an Arrow array."""
    n = last - first
    offsets = np.r_[0, np.cumsum(n)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])].view(np.int64)))


def _least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """What a set of n shingles has in common at least with one that it links with."""
    return -(-num * n // den)


def _shared_least(n: Column, num: int, den: int) -> Column:
    """How many prefix shingles a set of n shares with one that it links with: that one has num / den of n shingles at least."""
    return 1 + F.floor((F.lit(num) * n + den - 1) / den / SPARE)


def _sets(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Per row its text's class: id, tk (a hash of the text), cls, n, prefix (its first shingles by hash)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, first, hashes in shingle_sets(batch.column("_text"), words):
                n = np.diff(first)
                lists = _lists(first[:-1], first[:-1] + np.minimum(n, n - _least(n, num, den) + 1 + n // SPARE), hashes)
                own = [batch.column(c).slice(at, len(n)) for c in ("_id", "_tk")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(class_ids(first, hashes).view(np.int64)), pa.array(n, pa.int64()), lists], names=["id", "tk", "cls", "n", "prefix"])
                at += len(n)

    return rows.mapInArrow(label, "id long, tk long, cls long, n long, prefix array<long>")


def _candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that can have a link (cls), by how many of their prefix shingles stand beside those of another class.

    (shingle, class) is sorted over ranges of both, so a shingle that all texts have is spread over many tasks. What stands at
    a range's border counts as shared, as its neighbour is not seen: that only keeps some more sets.
    """
    classes = sets.where("n > 0").select("cls", "n", "prefix").dropDuplicates(["cls"])
    listed = classes.select(F.explode("prefix").alias("s"), "cls", "n").repartitionByRange("s", "cls").sortWithinPartitions("s", "cls")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the shingle before this batch, and the row that waits for the one after it

        def out(cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(cls, kind="stable")
            cls, n = cls[order], n[order]
            cut = runs(cls)
            return pa.RecordBatch.from_arrays([pa.array(cls[cut[:-1]]), pa.array(n[cut[:-1]]), pa.array(np.diff(cut))], names=["cls", "n", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, cls, n = (batch.column(c).to_numpy() for c in ("s", "cls", "n"))
            if held is not None:
                s, cls, n = np.r_[held[0], s], np.r_[held[1], cls], np.r_[held[2], n]
            like = s[1:] == s[:-1]
            shared = np.r_[True if last is None else s[0] == last, like] | np.r_[like, False]
            last, held = s[-2] if len(s) > 1 else last, (s[-1:], cls[-1:], n[-1:])
            if len(s) > 1:
                yield out(cls[:-1][shared[:-1]], n[:-1][shared[:-1]])
        if held is not None:
            yield out(held[1], held[2])

    counted = listed.mapInArrow(neighbours, "cls long, n long, c long").groupBy("cls", "n").agg(F.sum("c").alias("c"))
    return counted.where(F.col("c") >= _shared_least(F.col("n"), num, den)).select("cls")


def _frequencies(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored table, and made of it (cls, s, df) of rows (s, cls): the shingles that several classes have, with how many have them; rows that are repeated count once.

    Sorted over ranges of both as above, so that a shingle that all texts have is spread over many tasks. Each range counts its own
    runs; a run at its border may go on in another one, so those are summed up, two shingles a range at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, opened = None, [], True  # the shingle of the last run, its classes so far, whether it is the range's first

        def out(cls: np.ndarray, s: np.ndarray, df: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            keep = (df > 1) | edge
            return pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (cls, s, df, edge)], names=["cls", "s", "df", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, cls = (batch.column(c).to_numpy() for c in ("s", "cls"))
            if now is not None:
                if s[0] == now == s[-1]:
                    held.append(cls)
                    continue
                begun = np.concatenate(held)
                s, cls = np.r_[np.full(len(begun), now), s], np.r_[begun, cls]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])
            s, cls = s[new], cls[new]
            cut = runs(s)
            end, n = cut[-2], np.diff(cut)
            edge = np.zeros(len(s), bool)
            edge[: cut[1]] = opened
            yield out(cls[:end], s[:end], np.repeat(n, n)[:end], edge[:end])
            now, held, opened = s[-1], [cls[end:]], opened and end == 0
        if now is not None:
            last = np.unique(np.concatenate(held))
            yield out(last, np.full(len(last), now), np.full(len(last), len(last)), np.ones(len(last), bool))

    counted = stored(listed.repartitionByRange("s", "cls").sortWithinPartitions("s", "cls").mapInArrow(count, "cls long, s long, df long, edge boolean"))
    border = F.broadcast(counted.where("edge").groupBy("s").agg(F.count("*").alias("whole")))  # two rows a range at most
    return counted, counted.join(border, "s", "left").select("cls", "s", F.coalesce("whole", "df").alias("df")).where("df > 1")


def _shared_sets(rows: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The candidates with their shingles that others of them have, the rarest first: cls, n, sh. Of each class one row is shingled again."""
    chosen = stored(_candidates(sets, num, den))
    one = stored(sets.select("cls", "tk", "id").join(chosen, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("tk", "id")).alias("r")).select("r.*"))
    # the list of candidates grows with the input, so it is merged, never broadcast
    texts = rows.join(one.hint("merge"), (F.col("_tk") == F.col("tk")) & F.col("_id").eqNullSafe(F.col("id")), "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, first, hashes in shingle_sets(batch.column("_text"), words):
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(first, hashes).view(np.int64)), pa.array(np.diff(first), pa.int64()), _lists(first[:-1], first[1:], hashes)], names=["cls", "n", "all"])

    full = stored(texts.select("_text").mapInArrow(whole, "cls long, n long, all array<long>"))
    counted, often = _frequencies(full.select(F.explode("all").alias("s"), "cls"))
    kept = often.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("sh")).select("cls", F.col("sh.s").alias("sh"))
    shared = stored(kept.join(full.select("cls", "n").distinct(), "cls").where(den * F.size("sh") >= num * F.col("n")).select("cls", "n", "sh"))
    release(chosen, one, full, counted)
    return shared


def _listed(sets: DataFrame, name: str, num: int, den: int, *more: str) -> DataFrame:
    """Rows (s, name, its n, size of sh and place i in it) of the rarest shingles of each set, as many as are needed: a set shares one of them at
    least with each set of similarity num / den. Those that no other set has come before all of them, and are left out."""
    least = F.ceil(F.lit(num) * F.col("n") / den)
    rarest = F.slice("sh", F.lit(1), F.greatest(F.size("sh") - least + 1, F.lit(0)).cast("int"))
    rows = sets.select(F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), F.size("sh").alias(f"z_{name}"), *more, F.posexplode(rarest).alias("p", "s"))
    return rows.withColumn(f"i_{name}", F.col("p") + 1).drop("p")


def _may_reach(similarity: Column) -> Column:
    """Whether x and q, which have a shingle in common at places i of their lists, can be so similar, if it is the first one in common.

    Sizes, places within the prefixes of that similarity, and what is left behind the places must allow it. A pair that is so
    similar passes at the first shingle that it has in common, so none is lost, and frequent shingles, which stand last, bring few.
    """
    slack = 1e-6
    alike = F.least("n_x", "n_q") >= similarity * F.greatest("n_x", "n_q") - slack
    early = lambda k: F.col(f"i_{k}") <= F.col(f"z_{k}") - F.ceil(similarity * F.col(f"n_{k}") - slack) + 1
    left = 1 + F.least(F.col("z_x") - F.col("i_x"), F.col("z_q") - F.col("i_q"))
    return alike & early("x") & early("q") & (left >= similarity / (1 + similarity) * (F.col("n_x") + F.col("n_q")) - slack)


def _within(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the distinct pairs (x, q) of classes of similarity num / den, with their distance."""
    left, right = sets.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("sh").alias("sx")), sets.select(F.col("cls").alias("q"), F.col("n").alias("nq"), F.col("sh").alias("sq"))
    found = pairs.join(left, "x").join(right, "q").withColumn("common", F.size(F.array_intersect("sx", "sq")).cast("long"))
    union = F.col("nx") + F.col("nq") - F.col("common")
    return found.where(den * F.col("common") >= num * union).select("x", "q", (1 - F.col("common") / union).alias("d"))


def _pivots(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Regions: x, q (its pivot, or x itself), d; all links between covered sets and the pivots of their round besides: link."""
    rest, found = sets, None
    for number in range(ROUNDS):
        key = F.array_min(F.transform("sh", lambda s: F.xxhash64(s, F.lit(number))))
        pivots = stored(rest.groupBy(key.alias("key")).agg(F.min("cls").alias("cls")).select("cls").distinct())
        own = stored(rest.join(pivots, "cls", "left_semi"))
        near = _listed(rest, "x", num, den).join(_listed(own, "q", num, den), "s")
        pairs = near.where((F.col("x") != F.col("q")) & _may_reach(F.lit(num / den))).select("x", "q").distinct()
        near = _within(pairs, sets, num, den).unionByName(own.select(F.col("cls").alias("x"), F.col("cls").alias("q"), F.lit(0.0).alias("d")))
        before, found = found, stored(near if found is None else found.unionByName(near))
        left = stored(rest.join(found.select(F.col("x").alias("cls")).distinct(), "cls", "left_anti"))
        release(before, pivots, own, rest if number else None)
        rest = left
        if rest.isEmpty():
            return found
    return stored(found.unionByName(rest.select(F.col("cls").alias("x"), F.col("cls").alias("q"), F.lit(0.0).alias("d"))))


def join_region(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, owner: np.ndarray, shingles: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links of one region that join different components, enough to connect all that its links connect.

    owner and shingles list the region's sets. Recursive: a pivot of the smallest component, its distances to all others by
    way of the lists of its shingles, and if a cut at the median separates, an inner and an outer region, in which inner
    documents within t of the cut are replicated to the outer region.
    """
    t = 1 - num / den + 1e-9
    comp = np.unique(comp, return_inverse=True)[1]
    order = np.argsort(shingles, kind="stable")
    lists, values = owner[order], shingles[order]
    begin = np.searchsorted(values, shingles, "left")
    end = np.searchsorted(values, shingles, "right")
    by_owner = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[by_owner], np.arange(len(ids) + 1))
    links, todo = [], [np.arange(len(ids))]
    while todo:
        region = todo.pop()
        kinds, which, sizes = np.unique(comp[region], return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            continue
        p = region[np.argmin(sizes[which])]
        rest = region[region != p]
        own = by_owner[at[p] : at[p + 1]]
        own = own[end[own] - begin[own] > 1]
        common = np.bincount(np.concatenate([lists[a:b] for a, b in zip(begin[own], end[own], strict=True)] or [lists[:0]]), minlength=len(ids))[rest]
        union = n[p] + n[rest] - common
        for i in rest[den * common >= num * union]:
            if comp[i] != comp[p]:
                links.append((int(ids[p]), int(ids[i])))
                comp[comp == comp[i]] = comp[p]
        far = 1 - common / union
        cut = np.median(far)
        inner, outer = rest[far <= cut], rest[far > cut - t]
        todo += [inner, outer] if max(len(inner), len(outer)) < len(rest) else [rest]
    return links


def _join_regions(regions: DataFrame, replicas: DataFrame, sets: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the own sets (q, x) of regions and their replicas (q, x), in tasks of a bounded size."""
    sized = sets.select(F.col("cls").alias("x"), "n")
    held = stored(regions.withColumn("side", F.lit(0)).unionByName(replicas.withColumn("side", F.lit(1))).join(sized, "x"))
    load = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)) / REGION)
    parts = held.groupBy("q").agg(F.greatest(load(0), F.lit(1)).alias("p0"), F.greatest(load(1), F.lit(1)).alias("p1"))
    # each own part meets each part of the replicas
    place = lambda p: F.pmod(F.xxhash64("x"), F.col(p)).cast("long")
    all_of = lambda p: F.sequence(F.lit(0).cast("long"), F.col(p).cast("long") - 1)
    dealt = held.join(parts, "q").withColumn("i", F.explode(F.when(F.col("side") == 0, F.array(place("p0"))).otherwise(all_of("p0")))).withColumn("j", F.explode(F.when(F.col("side") == 1, F.array(place("p1"))).otherwise(all_of("p1"))))
    whole = dealt.select("q", "i", "j", F.col("x").alias("cls")).join(sets.select("cls", "n", "sh"), "cls").join(comp, "cls")

    def join(table: pa.Table) -> pa.Table:
        listed = table["sh"].combine_chunks()
        owner = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
        links = join_region(table["cls"].to_numpy(), table["comp"].to_numpy(), table["n"].to_numpy(), owner, listed.flatten().to_numpy(), num, den)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return whole.groupBy("q", "i", "j").applyInArrow(join, "a long, b long")


def link_components(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of all classes that have a link."""
    found = _pivots(sets, num, den)
    links = stored(found.where("x <> q").select(F.col("x").alias("a"), F.col("q").alias("b")))
    roots = components(links)
    comp = stored(sets.select("cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("comp")))
    # the nearest pivot, and of equally near ones the smallest
    home = stored(found.groupBy("x").agg(F.min(F.struct("d", "q")).alias("p")).select("x", F.col("p.q").alias("q"), F.col("p.d").alias("d")))
    radius = home.groupBy("q").agg(F.max("d").alias("radius"))
    # of two linked sets the one with the larger pivot is replicated, within 2 t of the other's: a similarity of 2 num - den
    wide = 2 * num - den
    known = sets.join(comp, "cls").join(home.select(F.col("x").alias("cls"), F.col("q").alias("home")), "cls")
    pivots = known.where("cls = home").withColumnRenamed("comp", "comp_q").join(radius.withColumnRenamed("q", "cls"), "cls")
    both = _listed(known, "x", wide, den, "comp", "home").join(_listed(pivots, "q", wide, den, "comp_q", "radius"), "s")
    # of each pivot only what its own radius reaches
    reached = (F.col("comp") != F.col("comp_q")) & (F.col("home") > F.col("q")) & _may_reach(F.lit(num / den) - F.col("radius"))
    pairs = both.where(reached).select("x", "q").distinct()
    t = 1 - num / den + 1e-9
    replicas = stored(_within(pairs, sets, wide, den).join(radius, "q").where(F.col("d") <= F.col("radius") + t).select("q", "x", "d"))
    # own sets that some replica can reach
    reach = replicas.groupBy("q").agg(F.min("d").alias("least"))
    regions = home.join(reach, "q").where(F.col("d") >= F.col("least") - t).select("q", "x")
    more = stored(_join_regions(regions, replicas.select("q", "x"), sets, comp, num, den))
    return stored(roots if more.isEmpty() else components(stored(links.unionByName(more))))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose sets of `words`-word shingles have a Jaccard similarity of num / den or more.

    Words are runs without white space, A-Z lower-cased; a text of fewer words is one shingle. Returns id_col, n_shingles and
    component_id, the smallest id that links reach. num / den must be above one half, where windows are below distance 1.

    Defined cases: null and empty texts and texts without words have no shingles and link with nothing; equal texts, and
    different texts of equal sets, link; rows that are repeated stay; a null id gets its component's smallest id, or null if
    there is none; very long texts are one set of all their shingles; an empty table gives an empty result; other columns are
    ignored.
    """
    if 2 * num <= den:
        raise ValueError("a similarity above one half is needed")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_tk"))
    sets = stored(_sets(rows, words, num, den))
    shared = _shared_sets(rows, sets, words, num, den)
    roots = link_components(shared, num, den)
    labelled = stored(sets.select("id", "cls", "n").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("id", "n", F.coalesce("root", "cls").alias("root")))
    release(sets, shared, roots)
    least = labelled.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    return labelled.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
