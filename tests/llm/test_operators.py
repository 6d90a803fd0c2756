"""Edge cases and brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, decontam, exact_dedup, jaccard_join, mixing, quality, queries, substring, token_files, toxicity, warc

SCHEMA = "doc_id long, text string, source string, cls string, id long, `_id` long, size string, target int, key string, row int, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 300)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   \n\t", "One", "one", "two words", base, base.upper(), " ".join(near), words(rng, 40) + " " + passage + " " + words(rng, 30), passage, words(rng, 9000), "É é ß", "x " * 400, words(rng, 30) + "\n\n" + passage]
    out = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (3, "One"), (None, base), (None, None)]
    family = words(rng, 100).split()
    for i in range(30):  # copies of copies, so that components are more than stars
        for _ in range(rng.randint(1, 3)):
            family[rng.randrange(100)] = f"w{rng.randint(0, 99)}"
        out.append((100 + i, " ".join(family)))
    return [(i, t, ["a", "b", None][k % 3], "x", k, k, "s", 1, "k", 0, "n") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def test_jaccard_join_is_exact(docs, rows, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    assert got == components(rows)
    assert jaccard_join.jaccard_join(none).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_region_recursion_connects_what_links_connect(seed):
    rng = random.Random(seed)
    base = list(range(60))
    sets = []
    for i in range(40):
        s = set(base)
        for _ in range(rng.randint(0, 9)):
            s.discard(rng.randrange(60))
            s.add(1000 + 50 * i + rng.randint(0, 40))
        sets.append(sorted(s))
    n = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(40), n), np.concatenate(sets)
    links = jaccard_join.join_region(np.arange(40), np.arange(40), n, owner, flat, 80, 100)
    a, b = ({i: i for i in range(40)} for _ in range(2))

    def merge(root, i, j):
        ri, rj = root[i], root[j]
        for k in root:
            if root[k] in (ri, rj):
                root[k] = min(ri, rj)

    for i, j in itertools.combinations(range(40), 2):
        x, y = set(sets[i]), set(sets[j])
        if 100 * len(x & y) >= 80 * len(x | y):
            merge(a, i, j)
    for i, j in links:
        merge(b, i, j)
    assert a == b


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_frequencies_of_runs_over_many_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(0, c) for c in range(300)] + [(rng.randint(1, 60), rng.randint(0, 40)) for _ in range(600)] + [(99, 1)] * 50 + [(100, 2)]
    d = spark.createDataFrame(rows, "s long, cls long").repartition(4)
    want = {}
    for s, c in set(rows):
        want.setdefault(s, set()).add(c)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.s, r.cls, r.df) for r in jaccard_join._frequencies(d)[1].collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted((s, c, len(cs)) for s, cs in want.items() if len(cs) > 1 for c in cs)


def near_family(seed, n=60):
    """Texts that drift apart by edits, many of them near the threshold, beside a line that all have."""
    rng = random.Random(seed)
    line, out = words(rng, 12), []
    for _ in range(4):
        base = words(rng, 70).split()
        for _ in range(n // 4):
            t = list(rng.choice([base, *out[-3:]])) if rng.random() < 0.7 else list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 9)}"
            out.append(t)
    return [(i, " ".join(t) + " " + line) for i, t in enumerate(out)] + [(1000 + i, words(rng, 40) + " " + line) for i in range(20)]


@pytest.mark.parametrize(("seed", "rounds", "region"), [(1, 6, 1 << 21), (2, 1, 1 << 21), (3, 6, 1), (4, 1, 300)])
def test_regions_with_few_pivots_and_dealt_as_grids(spark, monkeypatch, seed, rounds, region):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "REGION", region)
    rows = near_family(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(d).collect()), key=str)
    assert got == components(rows)


def test_windows_find_links_between_regions(spark, monkeypatch):
    """With a pivot hash that is of no use, each set is a pivot after one round, and all links come from windows."""
    monkeypatch.setattr(jaccard_join, "_pivots", lambda sets, num, den: sets.select(F.col("cls").alias("x"), F.col("cls").alias("q"), F.lit(0.0).alias("d")))
    rows = near_family(7)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(d).collect()), key=str)
    assert got == components(rows)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, rows, none, keep):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    pick = {k: ({"min": min, "max": max}[keep])((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = sorted(((r[0], pick[lower(r[1])], len(groups[lower(r[1])]), r[0] is not None and r[0] == pick[lower(r[1])], hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows), key=str)
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_of_a_group_over_many_partitions(spark):
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(many, keep="max").groupBy("keep_id", "group_size").count().orderBy(F.desc("group_size")).first()
    assert tuple(got) == (398, 266, 266)


def test_mix(docs, rows, none):
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(WORD.findall(r[1] or ""))
    total, weight, target = sum(sizes.values()), {"a": 1, "b": 2, None: 3}, {}
    open_, left = set(sizes), total
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert sorted(got.target.unique()) == pytest.approx(sorted(set(target.values())))
    for t, g in got.groupby("target"):
        assert abs(g.taken.sum() - t) <= 1
    assert got.sort_values(["doc_id", "size", "taken"]).taken.tolist() == mixing.mix_sources(docs).toPandas().sort_values(["doc_id", "size", "taken"]).taken.tolist()
    assert mixing.mix_sources(none).count() == 0
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == got.taken.sum()


@pytest.mark.parametrize("weight", [0.05, 0.2, 1.0, 100.0])
def test_no_range_of_keys_is_large_at_any_weight(weight):
    u = (np.random.default_rng(3).integers(0, 2**48, 200_000) + 0.5) / 2.0**48
    n = np.unique(np.floor(np.log(-np.log(u) / weight) * mixing.RANGES), return_counts=True)[1]
    assert n.max() < 0.0015 * len(u)


def test_heavier_documents_are_taken_more_often(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("source"), F.lit("w w w w").alias("text"), F.when(F.col("id") % 4 < 2, 1.0).otherwise(0.2).alias("q"))
    got = mixing.mix_sources(d, quality_weight=F.col("q")).join(d.select("doc_id", "source", "q"), "doc_id").where("source = 's'").groupBy("q").agg(F.avg("taken").alias("t")).collect()
    by = {r.q: r.t for r in got}
    assert by[1.0] > 1.3 * by[0.2]


def contamination(doc, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, names = pattern.findall(lower(doc)), set(), set()
    for name, text in items:
        v = pattern.findall(lower(text))
        k = min(13, len(v))
        for j in range(len(v) - k + 1 if v else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    hit |= set(range(i, i + k))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, rows, none):
    items = [(1, rows[10][1]), (2, "one"), (3, None), (4, ""), (5, " ".join(rows[11][1].split()[50:70])), (5, "É"), (10, "x x x x"), (7, "nothing of this")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r[0], *contamination(r[1], items)) for r in rows), key=str)
    got = decontam.decontaminate(docs, table).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert decontam.decontaminate(none, table).count() == 0
    assert decontam.decontaminate(docs, table.limit(0)).where("contaminated").count() == 0


def test_one_index_serves_further_test_sets(spark, docs, rows):
    index = decontam.build_index(docs)
    assert index.postings.count() == sum(contamination(r[1], [])[0] for r in rows)
    for items in ([(1, rows[10][1])], [(2, "one"), (3, " ".join(rows[11][1].split()[50:70]))]):
        table = spark.createDataFrame(items, "item_id long, text string")
        got = decontam.decontaminate(docs, table, index=index).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((r[0], *contamination(r[1], items)) for r in rows), key=str)


@pytest.mark.parametrize("slop", [1, 2, 13, 40])
def test_proximity_as_far_as_asked(spark, slop):
    texts = ["alpha x beta", "beta alpha", "alpha", None, *("x " * 7 + "alpha " + "x " * (k - 1) + "beta" for k in (12, 13, 14, 40, 41))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "nowhere alpha")], "item_id long, text string")
    got = {r.row.doc_id: (r.n_near, r.n_hit) for r in decontam.decontaminate(d, items, slop=slop).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        far = abs(w.index("alpha") - w.index("beta")) if "beta" in w else 10**9
        assert got[i] == (int(far <= slop), w.count("alpha"))


def test_passages(docs, rows, none):
    got = substring.shared_passages(docs).collect()
    seen = {i for r in got for i in (r.doc_id, r.partner_id)}
    assert {6, 7, 8, 9, 10, 14} <= seen  # copies, a near copy, and a passage of 60 words in three texts
    assert not seen & {0, 1, 2, 3, 4, 5, 11, 12}
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        if not r.exact_copy and r.doc_id is not None and r.partner_id is not None:
            x, a = lower(by_id[r.doc_id]).split()[r.start : r.stop], lower(by_id[r.partner_id]).split()[r.partner_start : r.partner_stop]
            assert min(len(x), len(a)) >= 50 and r.n_same >= 0.8 * max(len(x), len(a)) and len(set(x) & set(a)) >= 0.7 * len(set(x))
    assert substring.shared_passages(none).count() == 0


def test_passages_that_many_share_and_that_repeat_themselves(spark):
    rng = random.Random(3)
    hot, loop = words(rng, 70), "tick tock " * 60
    texts = [(i, words(rng, 30) + " " + (hot if i % 2 else loop) + " " + words(rng, 20)) for i in range(300)] + [(1000 + i, words(rng, 150)) for i in range(50)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = substring.shared_passages(d).select("doc_id", "partner_id").collect()
    assert {i for r in got for i in r} == set(range(300))
    assert len(got) < 3 * 300


def test_passages_go_on_beyond_what_is_fetched_first(spark, monkeypatch):
    """With few words beside a chain, and seeds in its middle only, the ends come from fetching more."""
    monkeypatch.setattr(substring, "BESIDE", 4)
    monkeypatch.setattr(substring, "FURTHER", 3)
    rng = random.Random(12)
    long = words(rng, 900)
    texts = [" ".join([words(rng, n), long, words(rng, 7)]) for n in (0, 11, 200)]
    got = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.partner_id))) for r in got} >= {(0, 1)} or len(got) >= 2
    begins = {0: 0, 1: 11, 2: 200}
    assert all(r.start <= begins[r.doc_id] and r.stop >= begins[r.doc_id] + 900 and r.n_same >= 900 for r in got)


def test_passages_of_three_hundred_holders_with_edits_of_their_own(spark):
    rng = random.Random(13)
    base, texts = words(rng, 60).split(), []
    for _ in range(300):
        t = list(base)
        for i in rng.sample(range(60), 2):
            t[i] = f"own{rng.randint(0, 10**6)}"
        texts.append(" ".join([words(rng, 30), *t, words(rng, 20)]))
    texts += [words(rng, 120) for _ in range(60)]
    got = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    found = {i for r in got for i in (r.doc_id, r.partner_id)}
    assert len(found & set(range(300))) >= 0.9 * 300 and not found - set(range(300))


def lcs_length(x: list, a: list) -> int:
    """Words in common of two short pieces, in order: greedy furthest-reaching paths (O(ND))."""
    n, m = len(x), len(a)
    reach = {1: 0}
    for d in range(n + m + 1):
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            while i < n and 0 <= i - k < m and x[i] == a[i - k]:
                i += 1
            reach[k] = i
            if i >= n and i - k >= m:
                return (n + m - d) // 2
    return 0


def brute_force_passages(x, a, least=50, identity=0.8):
    """Whether some `least` words of x have identity * least words in common, in order, with as many words of a."""
    shared = set(x) & set(a)
    if len(shared) < identity * least:
        return False
    for i in range(len(x) - least + 1):
        for j in range(len(a) - least + 1):
            if sum(p == q for p, q in zip(x[i : i + least], a[j : j + least], strict=True)) >= identity * least or lcs_length(x[i : i + least], a[j : j + least]) >= identity * least:
                return True
    return False


def test_recall_against_brute_force(spark):
    """Texts of passages with edits of all kinds, each pair judged by brute force; nine in ten documents of such pairs are found, no others."""
    rng, texts = random.Random(14), []
    for k in range(24):
        base = words(rng, 55 if k % 2 else 70).split()
        for _ in range(2):
            t = list(base)
            for i in sorted(rng.sample(range(1, len(t) - 1), k % 8), reverse=True):
                t[i : i + 1] = [[], ["new"], [t[i], "new"]][rng.randrange(3)]
            texts.append(" ".join([words(rng, 6), *t, words(rng, 6)]))
    texts += [" ".join(rng.sample(texts[0].split(), 40) + words(rng, 30).split()) for _ in range(4)]
    split = [t.split() for t in texts]
    true = {i for i, j in itertools.combinations(range(len(texts)), 2) if brute_force_passages(split[i], split[j]) for i in (i, j)}
    got = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {i for r in got for i in (r.doc_id, r.partner_id)}
    assert len(true) > 30 and len(found & true) >= 0.9 * len(true) and found <= true


def test_two_passages_apart_and_a_stray_line_near_one(spark):
    rng = random.Random(8)
    one, two, line = words(rng, 60), words(rng, 60), words(rng, 8)
    texts = [" ".join([words(rng, 20), one, words(rng, 100), two, words(rng, 20)]) for _ in range(2)]
    third = words(rng, 60)
    texts += [" ".join([line, words(rng, 80), third, words(rng, 30)]) for _ in range(2)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring.shared_passages(d).collect()
    found = sorted((r.doc_id + r.partner_id, r.start if r.doc_id in (0, 2) else r.partner_start, r.n_same) for r in got)
    assert found == [(1, 20, 60), (1, 180, 60), (5, 88, 60)]


def test_passages_with_edits(spark):
    rng = random.Random(10)
    texts = []

    def pair(one, two):
        texts.extend(" ".join([words(rng, 25), *t, words(rng, 25)]) for t in (one, two))

    base = words(rng, 52).split()
    pair(base, [f"new{i}" if i % 8 == 7 else w for i, w in enumerate(base)])  # no eight words in a row are the same
    base = words(rng, 50).split()
    pair(base, [f"new{i}" if i in (17, 34) else w for i, w in enumerate(base)])
    for k in range(40):
        base = words(rng, 60).split()
        other = list(base)
        for i in sorted(rng.sample(range(1, 59), 2 + k // 10), reverse=True):
            other[i : i + 1] = [[], ["new"], [other[i], "new"]][rng.randrange(3)]
        pair(base, other)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(sorted(r)) for r in substring.shared_passages(d).select("doc_id", "partner_id").collect()}
    assert got <= {(i, i + 1) for i in range(0, len(texts), 2)} and {(0, 1), (2, 3)} <= got
    assert len(got) >= 0.95 * len(texts) / 2


def test_passages_made_of_lines_that_many_texts_have(spark):
    rng = random.Random(9)
    lines = [words(rng, 20) for _ in range(60)]
    texts = []
    for _ in range(40):  # five lines in two texts, and each line in many others that hold no two of them in this order
        five = rng.sample(lines, 5)
        texts += [" ".join([words(rng, 30), *five, words(rng, 30)]) for _ in range(2)]
    for _ in range(400):
        texts.append(" ".join(words(rng, 25) + " " + line for line in rng.sample(lines, 12)))
    held = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i for v in held.values() if len(v) > 1 for i in v}
    assert want >= set(range(80))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substring.shared_passages(d).select("doc_id", "partner_id").collect()
    assert {i for r in got for i in r} >= want


def passages_of_common_lines(seed, changes, pairs=30):
    """Pairs of texts with a changed passage of five lines, each of which some forty other texts have too; pairs come first."""
    rng = random.Random(seed)
    lines = [words(rng, 15) for _ in range(60)]
    texts = []
    for _ in range(pairs):
        five = " ".join(rng.sample(lines, 5)).split()
        for _ in range(2):
            t = list(five)
            for i in rng.sample(range(75), changes):
                t[i] = f"own{rng.randint(0, 10**9)}"
            texts.append(" ".join([words(rng, 30), *t, words(rng, 30)]))
    return texts + [" ".join(words(rng, 25) + " " + line for line in rng.sample(lines, 12)) for _ in range(200)]


@pytest.mark.parametrize("changes", [4, 6])
def test_changed_passages_made_of_lines_that_many_texts_have(spark, changes):
    """Texts that only share lines get no row; nine in ten of the pairs are connected (46 of 60 and 35 of 60 while a seed had two partners)."""
    texts = passages_of_common_lines(21, changes)
    found = {}
    for parts in (1, 3):
        got = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts), every_pair=True).select("doc_id", "partner_id").collect()
        found[parts] = {tuple(sorted(r)) for r in got}
    assert found[1] == found[3] <= {(i, i + 1) for i in range(0, 60, 2)} and len(found[1]) >= 27


def test_a_line_that_a_text_has_twice_is_compared_at_both_places(spark):
    rng = random.Random(22)
    line, passage = words(rng, 8), words(rng, 30)
    other = [f"own{i}" if i % 6 == 4 else w for i, w in enumerate(passage.split())]  # no seed but those of the line
    before = words(rng, 16).split()
    changed = [f"old{i}" if i % 6 == 2 else w for i, w in enumerate(before)]
    texts = [" ".join([line, words(rng, 120), *before, line, passage, words(rng, 40)]), " ".join([words(rng, 40), *changed, line, *other, words(rng, 40)])]
    got = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), every_pair=True).collect()
    assert [tuple(sorted((r.doc_id, r.partner_id))) for r in got] == [(0, 1)] and got[0].n_same >= 40


def linked_sets(pairs):
    """Sets of what pairs connect."""
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for i, j in pairs:
        root[find(i)] = find(j)
    out = {}
    for i in list(root):
        out.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, out.values()))


def test_changed_passages_of_common_lines_are_no_option(spark):
    """found as the query calls it, which left them out."""
    texts = passages_of_common_lines(23, 5)
    got = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).select("doc_id", "partner_id").collect()
    pairs = {tuple(sorted(r)) for r in got}
    assert pairs <= {(i, i + 1) for i in range(0, 60, 2)} and len(pairs) >= 27


def test_texts_that_repeat_single_words_are_all_connected(spark):
    """runs of a word, compared by their ends, connect what an alignment of all pairs of texts does."""
    rng, texts = random.Random(24), []
    for _ in range(60):
        held = rng.sample("the of and to".split(), 3)
        texts.append(" ".join([words(rng, rng.randint(0, 9)), *[" ".join([w] * rng.randint(12, 30)) for w in held], words(rng, rng.randint(0, 30))]))
    want = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        same = substring.lcs_pairs(texts[i].split(), texts[j].split())
        if same and substring.passages(*map(np.array, zip(*same, strict=True)), substring.LEAST, substring.IDENTITY):
            want.append((i, j))
    assert len(want) > 20
    for parts in (1, 3):
        got = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)).select("doc_id", "partner_id").collect()
        found = linked_sets([*map(tuple, got)])
        assert found == linked_sets([*map(tuple, got), *want])


def test_ends_of_runs():
    seed, pos = np.array([7, 7, 7, 7, 8, 7, 8, 9]), np.array([0, 1, 2, 4, 5, 20, 7, 30])
    order = np.argsort(pos)
    ends, last = substring._run_ends(seed[order], pos[order])
    assert [(int(s), int(p)) for s, p in zip(seed[order][ends], pos[order][ends], strict=True)] == [(7, 0), (7, 4), (8, 5), (8, 7), (7, 20), (9, 30)]
    assert pos[order][last].tolist() == [4, 7]


def test_partners_of_places_against_all_pairs(monkeypatch):
    """Places by rarer words, in slices and grids of any size, are those that a test of all pairs gives."""
    rng = np.random.default_rng(5)
    reach = substring._reach(substring.LEAST, substring.IDENTITY)
    wide = 2 * reach + substring.K
    n = 160
    words_ = np.where(rng.random((n, wide)) < 0.4, rng.integers(1, 6, (n, wide)), rng.integers(100, 4000, (n, wide))).astype(np.uint32)
    words_[:, reach - 4 : reach + 10] = np.arange(50, 64)
    for i in range(0, 60, 2):  # like another, around the seed, in seven to nine of ten words
        part = slice(reach - 30, reach + 40)
        words_[(i + 5) % 60, part] = np.where(rng.random(70) < 0.7 + i / 250, words_[i, part], words_[(i + 5) % 60, part])
    words_[100:130, : reach - 20] = 0
    group, root, before = np.repeat([7, 9], n // 2), np.arange(n) // 3, np.arange(n) % 8 // 2
    want = set()
    for i, j in itertools.permutations(range(n), 2):
        if group[i] == group[j] and root[i] < root[j] and (before[i] != before[j] or not before[i]):
            same = np.array([w != 0 and w in words_[j, max(k - 25, 0) : k + 26] for k, w in enumerate(words_[i])])
            if substring._best(same[None], substring.LEAST, substring.IDENTITY)[0] >= 0:
                want.add((i, j))
    assert len(want) > 10
    for pairs in (1 << 21, 50):
        monkeypatch.setattr(substring, "PAIRS", pairs)
        got = [(int(i), int(j)) for x, a in substring.similar_places(group, root, words_, before) for i, j in zip(x, a, strict=True)]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", range(5))
def test_passages_of_an_alignment(seed):
    rng = random.Random(seed)
    x, a = ([rng.choice("abcdef") for _ in range(40)] for _ in range(2))
    pairs = substring.lcs_pairs(x, a)
    assert len(pairs) == lcs_length(x, a) and all(x[i] == a[j] for i, j in pairs)
    px, pa_ = (np.array(v) for v in zip(*pairs, strict=True))
    good = lambda i, j: min(px[j] - px[i], pa_[j] - pa_[i]) + 1 >= 6 and j - i + 1 >= 0.7 * (max(px[j] - px[i], pa_[j] - pa_[i]) + 1)
    got = substring.passages(px, pa_, 6, 0.7)
    assert all(good(i, j - 1) for i, j in got)
    free = [k for k in range(len(px)) if not any(i <= k < j for i, j in got)]
    assert not any(good(i, j) for i, j in itertools.combinations(free, 2) if j - i == free.index(j) - free.index(i))


def test_chains_ascend_and_pay_for_gaps():
    x, a = np.array([0, 5, 10, 200, 12]), np.array([100, 105, 110, 300, 4])
    chains = substring.fenwick_chains(x, a)
    assert [0, 1, 2] in [c.tolist() for c in chains]
    for c in chains:
        assert (np.diff(x[c]) > 0).all() and (np.diff(a[c]) > 0).all()


@pytest.mark.parametrize("seed", range(5))
def test_common_words(seed):
    rng = random.Random(seed)
    x, a = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
    best = [[0] * (len(a) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(len(x)), range(len(a))):
        best[i + 1][j + 1] = best[i][j] + 1 if x[i] == a[j] else max(best[i][j + 1], best[i + 1][j])
    assert lcs_length(x, a) == best[len(x)][len(a)]


@pytest.mark.parametrize("seed", range(4))
def test_common_words_in_bounded_memory(monkeypatch, seed):
    rng = random.Random(seed)
    x, a = ([rng.choice("abcdefgh"[: 2 + seed * 2]) for _ in range(rng.randint(1, 90))] for _ in range(2))
    want = len(substring.lcs_pairs(x, a))
    monkeypatch.setattr(substring, "BITS", 40)
    got = substring.lcs_pairs(x, a)
    assert len(got) == want and all(x[i] == a[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))


def test_long_gaps_take_bounded_memory():
    import tracemalloc

    x, a = [f"x{i}" for i in range(20_000)], [f"a{i}" for i in range(200_000)]
    x[10_000], a[150_000] = "same", "same"
    tracemalloc.start()
    assert substring.lcs_pairs(x, a) == [(10_000, 150_000)]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20


def test_copies_without_ids(spark):
    text = words(random.Random(8), 80)
    got = lambda ids: sorted((str(r.doc_id), str(r.partner_id)) for r in substring.shared_passages(spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")).collect())
    assert got([None, None, 5]) == [("None", "5")]
    assert got([None, 7, 5]) == [("7", "5"), ("None", "5")]
    assert got([None, None]) == got([4, 4]) == []


def test_token_files(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    folder = f"file://{tmp_path}/tokens"
    index = token_files.write_token_files(docs, path, folder, sequence=64).cache()
    got = token_files.read_token_files(index).collect()
    tok, start, want = Tokenizer.from_file(path), 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    (ids, mask), *more = token_files.read_sequences(index.first().path, 0, 1)
    assert ids.shape == (1, 64) and not more and not ids.flags.owndata and len(mask) == 1 and len(mask.flatten()) == 64
    copied = pa.total_allocated_bytes()
    views = list(token_files.read_sequences(index.first().path, 0, 2))
    assert pa.total_allocated_bytes() == copied and sum(len(i) for i, _ in views) == 2
    last = max(r.part for r in index.collect())
    path = index.where(f"part = {last}").first().path
    total = sum(r.n_tokens for r in token_files.read_token_files(index.where(f"part = {last}")).collect())
    assert sum(m.flatten().true_count for _, m in token_files.read_sequences(path, 0, -(-total // 64))) == total
    assert token_files.read_token_files(token_files.write_token_files(none, path)).count() == 0


def test_encoder_is_the_tokenizer():
    e, rng = token_files.Encoder(queries.tokenizer_path()), random.Random(2)
    parts = [*"ab  \n\t'sé !1<|", "　", " the", " it's", "<|endoftext|>", "12ab", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    ids, counts = e.column(pa.array(texts))
    for text, hi, n in zip(texts, np.cumsum(counts), counts, strict=True):
        assert ids[hi - n : hi].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "y" * 1500
    pages = [(1, "http://a/\r\nX: y%", big), (2, None, big), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "small"), (6, "http://f", "small"), (7, "http://g", "é" * 600), (None, "http://h", "null id"), (2, None, big)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("offset", F.lit("x"))
    index = warc.write_warc(d, f"file://{tmp_path}/w")
    got = warc.read_warc(index).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted((str(i), len((h or "").encode()), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in pages)
    assert {r.url for r in got} == {u or "" for _, u, _ in pages}
    assert {r.payload for r in got if r.record_type == "response"} == {h or "" for i, _, h in pages if i != 1}
    assert warc.read_warc(index.where("page_id = 7")).first().payload == "é" * 600
    assert warc.write_warc(d.limit(0)).count() == 0


def test_payloads_are_in_no_exchange(spark, sf, monkeypatch):
    """With broadcasts off and many repeated payloads, only index rows are dealt."""
    plans, real = [], warc.stored

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args)

    monkeypatch.setattr(warc, "stored", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("x"), (F.col("id") % 700).cast("string")), F.lit(600)).alias("html")).repartition(5)
        got = warc.read_warc(warc.write_warc(pages)).cache()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2 and any("SortMergeJoin" in p for p in plans) and not any("html" in p for p in plans[1:])
    assert got.where("record_type = 'response'").count() == 700 and got.where("refers_to IS NOT NULL").count() == 2300
    assert {(r.refers_to % 700 == r.page_id % 700, r.refers_to >= 2300) for r in got.where("refers_to IS NOT NULL").collect()} == {(True, True)}


def test_ranges_coalesce():
    near = [(0, 10), (10, 10), (30, 5)]
    assert [(lo, hi) for lo, hi, _ in warc.ranges(near)] == [(0, 35)]
    far = [(0, 10), (10 + warc.GAP + 1, 10)]
    assert len(list(warc.ranges(far))) == 2
    assert len(list(warc.ranges([(0, warc.READ), (warc.READ, 10)]))) == 2


RECORDS = [
    {"messages": [{"role": "user", "content": "hi <s>[INST]"}, {"role": "assistant", "content": "a\\b"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
    {"instruction": "do", "input": "this", "output": "done"},
    {"prompt": "p", "response": None},
    {"messages": []},
    {"other": 1},
]


def test_layouts(spark):
    raw = [(i, 0, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(9, 0, "{broken"), (8, 0, None)]
    turns = chat.canonical_turns(spark.createDataFrame(raw, "conv_id long, turn long, record string"))
    got = {}
    for r in turns.orderBy("conv_id", "part").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got[0] == [("messages", "user", "hi <s>[INST]"), ("messages", "assistant", "a\\b")]
    assert got[1] == [("conversations", "user", "q"), ("conversations", "assistant", "r")]
    assert [t[1] for t in got[2]] == ["user", "user", "assistant"] and got[3][1] == ("prompt-response", "assistant", "")
    assert 4 not in got and all(got[i] == [("unknown", None, None)] for i in (5, 8, 9))


def test_unknown_records_are_no_turns(spark):
    raw = [(1, 0, json.dumps(RECORDS[0])), (1, 1, "{broken"), (2, 0, json.dumps({"other": 1}))]
    turns = chat.canonical_turns(spark.createDataFrame(raw, "conv_id long, turn long, record string").withColumn("role", F.lit("x")).withColumn("part", F.lit(9)))
    got = chat.read_chats(chat.format_chats(turns)).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 2)]


def test_conversations_are_records_of_many_layouts(spark, sf, monkeypatch):
    seen = {}
    whole = chat.canonical_turns

    def kept(records, *a, **k):
        seen["layouts"] = {r.layout for r in whole(records).select("layout").distinct().collect()}
        return whole(records, *a, **k)

    monkeypatch.setattr(chat, "canonical_turns", kept)
    queries.op10_chat(spark, sf)
    assert "unknown" not in seen["layouts"] and len(seen["layouts"]) >= 7


def test_chat_round_trip(spark, monkeypatch):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 5, None, None), (2, 5, "assistant", "b"), (2, 4, "assistant", "a\\[<"), (None, 0, "x[y", "é\n"), (3, 1, "user", "z" * 5000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(d)
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    for i in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == i))
        assert got[i].n_turns == len(own)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[i].loss_chars == len(said) and got[i].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_chats(chat.format_chats(d.limit(0))).count() == 0


def test_ordinal_regression_orders_four_grades():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        good = rng.random()
        eta = 12 * good + rng.normal(0, 0.7)
        rows.append((int(np.digitize(eta, [3, 6, 9])), np.array([1, 2]), np.array([good, 1 - good])))
    m = quality.fit_ordinal(rows, 8, rounds=600)
    assert (np.diff(m.thresholds) > 0).all()
    p = m.probabilities(np.array([m.weights[1] * g + m.weights[2] * (1 - g) for _, _, (g, _) in rows]))
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == [g for g, _, _ in rows]).mean() > 0.75


@pytest.mark.parametrize("grades", [2, 4])
def test_ordinal_fit_against_the_likelihood(grades):
    """The fitted weights and thresholds leave no slope of the likelihood, taken by differences of the likelihood itself."""
    rng, places = np.random.default_rng(grades), 6
    rows = []
    for _ in range(400):
        share = rng.dirichlet(np.ones(3))
        eta = share @ [3.0, 0.0, -3.0] + rng.logistic(0, 0.7)
        rows.append((int(np.digitize(eta, np.linspace(-1, 1, grades - 1))), np.array([1, 2, 4]), share))
    model = quality.fit_ordinal(rows, places, rounds=4000, ridge=1e-6)

    def loss(w, cuts):
        total = 0.0
        for g, at, share in rows:
            eta = (w[at] * share).sum()
            below = [0.0, *(1 / (1 + np.exp(eta - c)) for c in cuts), 1.0]
            total -= np.log(below[g + 1] - below[g])
        return total / len(rows)

    def slope(i, step=1e-4):
        ends = []
        for sign in (1, -1):
            w, cuts = model.weights.copy(), model.thresholds.copy()
            (w if i < places else cuts)[i if i < places else i - places] += sign * step
            ends.append(loss(w, cuts))
        return (ends[0] - ends[1]) / (2 * step)

    assert max(abs(slope(i)) for i in [1, 2, 4, *range(places, places + grades - 1)]) < 5e-3
    assert (np.diff(model.thresholds) > 0).all() and model.weights[[0, 3, 5]].tolist() == [0, 0, 0]


def test_quality_labels_null_tied_and_repeated(spark):
    rng = random.Random(20)
    d = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") * 5 + words(rng, 12)) for i in range(200)] + [(1, "good twice"), (None, "good"), (999, None)], "doc_id long, text string")
    grades = [(i, i % 2) for i in range(200)] + [(1, 1), (1, 1), (2, None), (None, 1), (5000, 0)]
    labels = spark.createDataFrame(grades, "doc_id long, quality int")
    got = quality.rate_quality(d, labels).collect()
    by = {r.doc_id: r.tail_probability for r in got if r.doc_id not in (1, None, 999)}
    assert len(got) == 203 and np.mean([(p >= 0.5) == (i % 2 == 1) for i, p in by.items()]) > 0.95
    assert [r.tail_probability for r in got if r.doc_id == 999] == [0.0]
    one = quality.train_quality(d, labels.where("quality = 1"))
    assert one.grades == [1] and {r.tail_probability for r in quality.score_quality(d, one).collect()} == {0.0, 1.0}
    again = quality.train_quality(d.repartition(5), labels.repartition(3))
    assert np.allclose(again.weights, quality.train_quality(d, labels).weights)


def test_quality_on_held_out_rows(spark, sf, docs, none):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.rate_quality(d, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 5 and ((held.quality == 1) == held.kept).mean() > 0.8
    model = quality.OrdinalModel([0, 1], np.zeros(1 << quality.BITS), np.array([-1.0]))
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == docs.count() and all(r.tail_probability == 0 for r in scored if not (r.row.text or "").strip())
    assert quality.score_quality(none, model).count() == 0
    assert quality.rate_quality(docs, labels.limit(0)).count() == docs.count()


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 20)}. you {rng.choice(['idiot', 'blarg'])} {words(rng, 5)} you blarg {words(rng, 9)}" if i % 4 == 0 else words(rng, 40)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)], "doc_id long, toxic int, quality int")
    got = toxicity.score_toxicity(d, labels).toPandas()
    assert ((got.doc_id % 4 == 0) == (got.predicted == 1)).mean() > 0.98  # blarg is learned
    edge = toxicity.score_toxicity(docs, labels.limit(0)).toPandas()
    assert len(edge) == docs.count() and edge.score.between(0, 1).all() and (edge.predicted == 0).all()
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_grammar_weighs_clauses():
    machine = toxicity.grammar()
    run = lambda s: machine.run(s.split())
    assert run("o I o")[1] == 1.0 and run("T o I")[0][-1] == "I+" and run("T I")[1] == 1.5
    assert run("N o I") == (["N", "o", "I-"], 0.0)
    assert run("R o I")[1] == 0.5 and run("R T I")[0][-1] == "I~+"
    assert run("N o o o o I")[0][-1] == "I"
    # cues behind a head
    assert run("o o H T") == (["o", "o", "H+", "T"], 2.0) and run("I T")[0][0] == "I+"
    assert run("H T N")[0][0] == "H-+" and run("H N") == (["H-", "N"], 0.5)
    assert run("I o R")[0][0] == "I~" and run("I o o o o T")[0][0] == "I"
    assert run("N o H N")[1] == 0.5  # taken back once


def brute_force_marks(symbols):
    """Marks of each head by what stands around it, word by word."""
    out = []
    for i, s in enumerate(symbols):
        if s in "IH":
            before, behind = symbols[:i][::-1], symbols[i + 1 :]
            out.append(s + "-" * ("N" in before[:3] or "N" in behind[:2]) + "~" * ("R" in symbols) + "+" * ("T" in before[:5] or "T" in behind[:3]))
        else:
            out.append(s)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_grammar_against_brute_force(seed):
    rng, machine = random.Random(seed), toxicity.grammar()
    for _ in range(400):
        symbols = rng.choices("oooIHTNR", k=rng.randint(0, 12))
        outs, weight = machine.run(symbols)
        assert outs == brute_force_marks(symbols)
        assert weight == sum({"I": 1.0, "H": 1.5}[o[0]] - 1.0 * ("-" in o) - 0.5 * ("~" in o) + 0.5 * ("+" in o) for o in outs if o[0] in "IH")


def test_threats_are_learned_apart_from_insults(spark):
    rng = random.Random(6)
    rows = [(f"{words(rng, 12)} blarg you {words(rng, 5)}. you are a zonk {words(rng, 9)}" if i % 3 == 0 else words(rng, 30), int(i % 3 == 0)) for i in range(300)]
    got = toxicity.learn_terms(spark.createDataFrame(rows, "text string, value int"))
    model = toxicity.ToxicityModel(got, np.zeros(len(toxicity.OUTPUTS) + 1), 0.0)
    table, stems = model.classes()
    kind = lambda w: table.get(w) or next((c for c, begun in stems.items() if begun and w.startswith(begun)), "o")
    assert (kind("blarg"), kind("zonk")) == ("H", "I")
    assert toxicity.learn_terms(spark.createDataFrame([], "text string, value int")) == {}


def test_terms_that_few_rows_have_are_learned_from_what_the_frequent_ones_leave(spark):
    rng = random.Random(8)
    plain = lambda begun: " ".join(begun + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40))
    rows = [(plain("m") + (" zonker" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    rows += [(plain("v") + (" brillo" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(60)]
    rows += [(plain("v"), 1), (None, 1), ("", 0), (None, None)]  # a wrong label, and rows without words
    df = spark.createDataFrame(rows, "text string, value int")
    first, whole = toxicity.learn_terms(df, rounds=1), toxicity.learn_terms(df)
    assert set(first) == {"zon"} and set(whole) == {"zon", "bri"}
    assert toxicity.learn_terms(df.repartition(7)) == whole
    assert toxicity.learn_terms(df.where("text not like '%zonker%' and text not like '%brillo%'")) == {}


def test_toxicity_on_held_out_rows(spark, sf):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_toxicity(d, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and ((held.toxic == 1) == (held.predicted == 1)).mean() > 0.9


def test_pipeline_takes_effect(spark, sf, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect())
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    # quality: what the trained model's own probabilities say, one by one
    model = quality.train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    tail = {r.row.doc_id: r.tail_probability for r in quality.score_quality(docs, model).collect()}
    good = corpus_pipeline.keep_good(spark, docs, sf)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, p in tail.items() if p >= 0.5} != set(tail)
    # copies: one of each component, the smallest
    kept = corpus_pipeline.keep_one_of_each(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {c for i, n, c in components([(r.doc_id, r.text) for r in rows])}
    assert {r.doc_id for r in kept.collect()} == want and len(want) < len(rows)
    # benchmark items
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.drop_benchmarks(spark, docs, sf).select("doc_id").collect()}
    assert clean == {r.doc_id for r in rows if not contamination(r.text, items)[4]}
    # mix: as often and as long as the targets say
    rated, grade = corpus_pipeline.graded(spark, docs, sf)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(rated, quality_weight=F.col(grade)).collect()}
    assert {r.doc_id: r[grade] for r in rated.collect()} == {r.row.doc_id: r.expected_grade for r in quality.score_quality(docs, model).collect()}
    assert taken != {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    mixed, by_id = corpus_pipeline.mix(spark, docs, sf), {r.doc_id: r.text for r in rows}
    sums = {}
    for r in mixed.collect():
        assert by_id[r.doc_id].startswith(r.text)
        sums[r.doc_id] = sums.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert mixed.columns == docs.columns and sums == {i: n for i, n in taken.items() if n}
    # token files: the tokenizer's own ids, one after the other
    tok, start, ids = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for r in rows:
        own = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        ids.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(tuple(r) for r in corpus_pipeline.tokens(spark, docs, sf).collect()) == ids
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_with_null_ids_texts_and_sources(spark, sf, docs, rows):
    import corpus_pipeline

    given = docs.withColumn("lang", F.lit("en"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf)
        if name == "token files":
            assert out.count() == len(rows)
        else:
            assert out.columns == given.columns
            assert stage(spark, given.limit(0), sf).count() == 0
    kept = corpus_pipeline.keep_one_of_each(spark, given, sf)
    assert kept.where("doc_id = 6").count() == 1 and kept.where("doc_id in (7, 8)").count() == 0  # copies of a text go
