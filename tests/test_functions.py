import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import analytics as A
from quillspark.operators import expansion as E
from quillspark.operators import filters as P
from quillspark.operators import ingest as I
from quillspark.operators import retrieval as R
from quillspark.sources import files as S


def one(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("  A​ b\n c ", "a b c"), ("আমি ১২", "আমি 12"), ("إسلام", "اسلام"), ("don’t", "don't")])
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize(F.lit(raw))) == want


@pytest.mark.parametrize(("token", "want"), [("nation", "na"), ("the", "the"), ("ing", "ing"), ("rating", "rat")])
def test_stem_leaves_two_characters(spark, token, want):
    assert one(spark, X.stem(F.lit(token), ["tion", "ing", "ed"])) == want


@pytest.mark.parametrize(
    ("token", "want", "typed"),
    [
        ("নামাজের", "নামাজ", "নামাজ"), ("সালাতে", "সালাত", "সালাত"), ("ওযুর", "ওযু", "ওযু"), ("রোজার", "রোজা", "রোজা"), ("বই", "বই", "বই"),
        ("মসজিদগুলোতে", "মসজিদ", "মসজিদ"), ("বৈঠকে", "বৈঠক", "বৈঠক"), ("শিক্ষককে", "শিক্ষক", "শিক্ষকক"), ("বাবাকে", "বাবা", "বাবাক"), ("রোজাটিকে", "রোজা", "রোজা"),
        ("দিন", "দিন", "দিন"), ("ঘরে", "ঘরে", "ঘর"), ("abc", "abc", "abc"), ("", "", ""), (None, None, None),
    ],
)
def test_both_stems_of_bengali(spark, token, want, typed):
    word = F.lit(token).cast("string")
    assert one(spark, X.stem_bengali(word)) == want
    assert one(spark, X.stem_bengali_typed(word)) == typed


def test_stem_of_an_ending_depends_on_what_stands_before(spark):
    """Against the rule written out letter by letter, on random words."""
    rng, words = random.Random(3), set()
    while len(words) < 300:
        words.add("".join(rng.choice("কখগােিঅরত") for _ in range(rng.randint(1, 6))) + rng.choice(["কে", "ে", "তে", "", "র"]))

    def want(w):
        if len(w) <= 3:
            return w
        for s in X.BENGALI_LONG:
            if w.endswith(s) and len(w) - len(s) >= 2:
                return w[: len(w) - len(s)]
        if w.endswith("কে") and len(w) >= 4:
            return w[:-1] if "ক" < w[-3] <= "হ" else w[:-2]
        for s in X.BENGALI_SHORT:
            if w.endswith(s) and len(w) - len(s) >= 2:
                return w[: len(w) - len(s)]
        return w

    got = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", X.stem_bengali(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: want(w) for w in words}


def test_processed_words_have_their_stem_behind_them(spark):
    canonical = F.create_map(F.lit("praying"), F.lit("rating"))
    words = F.array(*[F.lit(w) for w in ("praying", "the", "nation")])
    assert one(spark, X.processed(words, canonical, lambda w: X.stem(w, ["tion", "ing"]))) == ["rating", "rat", "the", "nation", "na"]
    assert one(spark, X.processed(F.array().cast("array<string>"), canonical, lambda w: w)) == []


def test_rules_of_lengths_lists_and_hashes(spark):
    h = "aB" * 32
    rows = [("abc", ["x"], h), ("ab", ["x"] * 3, h[:-1]), (None, None, None), ("abcdef", ["xxxxx"], f" {h}\n"), ("abc", ["x", None], h[:-1] + "g")]
    df = spark.createDataFrame(rows, "t string, l array<string>, h string")
    rules = {"t": P.length_within(F.col("t"), 3, 5), "l": P.list_within(F.col("l"), 2, 4), "h": P.is_sha256(F.col("h"), required=False), "need": P.is_sha256(F.col("h"))}
    assert [r.reasons for r in P.validate(df, rules).collect()] == [[], ["t", "l", "h", "need"], ["t", "need"], ["t", "l"], ["l", "h", "need"]]


def test_upsert_keeps_what_it_is_told_to(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "then"), (None, "n", "then")], "k int, v string, made string")
    new = spark.createDataFrame([(1, "A", "now"), (2, "B", "now"), (3, "C", "now")], "k int, v string, made string")
    got = sorted((tuple(r) for r in I.upsert(old, new, "k", keep=["made"]).collect()), key=str)
    assert got == sorted([(1, "A", None), (2, "B", "then"), (3, "C", "now"), (None, "n", "then")], key=str)


def test_instants_and_lists_of_chunks(spark):
    rows = [(1, "2024-02-03", None), (2, "", "2024-02-03T01:00:00+02:00"), (3, None, None), (4, "never", "2024-01-01"), (5, "2024-05-05T00:00:01.25Z", "")]
    df = spark.createDataFrame(rows, "id int, u string, p string")
    chunks = S.address_chunks(df, "id", F.lit("s"), S.iso_instant(F.col("u"), F.col("p")), 2)
    assert sorted((r.id, r.chunk, r.last_modified) for r in chunks.collect()) == [(1, 1, "2024-02-03T00:00:00.000Z"), (2, 1, "2024-02-02T23:00:00.000Z"), (3, 2, None), (4, 2, None), (5, 3, "2024-05-05T00:00:01.250Z")]
    assert sorted(tuple(r) for r in S.chunk_list(chunks, "id").collect()) == [(1, 2, 1, 2, "2024-02-03T00:00:00.000Z"), (2, 2, 3, 4, None), (3, 1, 5, 5, "2024-05-05T00:00:01.250Z")]
    assert S.chunk_list(S.address_chunks(df.limit(0), "id", F.lit("s"), F.col("u"), 2), "id").count() == 0


def test_sort_rule_by_query(spark):
    found = spark.createDataFrame([(q, d) for q in (1, 2, 3, 4) for d in (1, 2, 3)], "query_id int, doc_id int")
    wanted = spark.createDataFrame([(1, "n", True), (2, "m", None), (3, "other", True)], "query_id int, by string, down boolean")
    values = spark.createDataFrame([(1, 5, 1), (2, 7, None), (9, 1, 1)], "doc_id int, n int, m int")
    got = {(r.query_id, r.doc_id): r.sort for r in R.sort_rule(found, wanted, values).collect()}
    inf = float("inf")
    assert got == {(1, 1): -5.0, (1, 2): -7.0, (1, 3): inf, (2, 1): 1.0, (2, 2): inf, (2, 3): inf, **{(q, d): 0.0 for q in (3, 4) for d in (1, 2, 3)}}


def test_stop_words_stay_where_nothing_else_is(spark):
    assert one(spark, X.tokens(F.lit("the of"), ["the", "of"])) == ["the", "of"]
    assert one(spark, X.tokens(F.lit("the cat, of"), ["the", "of"])) == ["cat"]


def test_sanitize_takes_out_what_taking_out_brings_forth(spark):
    out = one(spark, X.sanitize(F.lit('<scr<script>x</script>ipt>alert(1)</script><p onclick="x">a</p>')))
    assert "script" not in out and "onclick" not in out


@pytest.mark.parametrize(
    ("html", "clean"),
    [
        ("<img/onerror=alert(1)>", "<img/>"),
        ("<form action=x>a</form><button>b</button>", "ab"),
        ('<a href="javascript:alert(1)">c</a>', '<a href="">c</a>'),
        ("<script>a<b</script>d<style>e</style>", "d"),
        ("<svg><iframe></svg>f</iframe>g", "g"),
        ("<a href='data:text/html;x'>g</a><b>data: h</b>", "<a href=''>g</a><b>data: h</b>"),
        (" plain ", "plain"),
        (None, None),
    ],
)
def test_sanitize(spark, html, clean):
    assert one(spark, X.sanitize(F.lit(html).cast("string"))) == clean


SAFE = ["https://example.org/a", "http://sub.example.org:8080/article/456", "https://deenqna.org", "http://10.example.org/", "http://172.32.0.1/", "http://user:x@example.org/"]
UNSAFE = [
    "http://localhost:3000", "http://127.0.0.1:8080/admin", "http://127.0.0.2", "http://0.0.0.0", "http://0.1.2.3/", "http://[::1]", "http://[::1]:80/x", "http://169.254.169.254/latest/meta-data",
    "http://169.254.1.1/", "http://metadata.google.internal/computeMetadata/v1/", "http://10.0.0.1/internal", "http://172.16.0.1", "http://172.31.255.255", "http://192.168.1.1/router", "http://user@192.168.0.254/",
    "http://2130706433/", "http://127.1/", "http://0x7f.1/", "file:///etc/passwd", "ftp://ftp.example.com/file.txt", "gopher://gopher.example.com", "javascript:alert(1)", "", "not-a-valid-url", "http://", None,
]


@pytest.mark.parametrize(("url", "safe"), [(u, True) for u in SAFE] + [(u, False) for u in UNSAFE])
def test_safe_url(spark, url, safe):
    assert one(spark, P.is_safe_public_url(F.lit(url).cast("string"))) is safe


def test_filters_that_are_none(spark):
    q = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "All", ""), (4, "a", "x"), (5, "b", "y")], "q int, want_s string, want_l string")
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "s string, l string")
    got = sorted((r.q, r.s, r.l) for r in P.match_filters(q, d, ["s", "l"]).select("q", "s", "l").collect() if r.s is not None)
    assert got == [(1, "a", "x"), (1, "a", "y"), *((i, s, k) for i in (2, 3) for s, k in (("a", "x"), ("a", "y"), ("b", "x"))), (4, "a", "x")]


@pytest.mark.parametrize(("day", "week"), [("2024-01-01", "2024-W01"), ("2024-01-06", "2024-W02"), ("2024-01-07", "2024-W01"), ("2024-03-15", "2024-W12"), ("2024-12-31", "2024-W53"), ("2023-12-31", "2023-W53")])
def test_week(spark, day, week):
    from datetime import date
    from math import ceil

    d = date.fromisoformat(day)
    js_weekday, since = (d.weekday() + 1) % 7, (d - date(d.year, 1, 1)).days
    assert f"{d.year}-W{ceil((js_weekday + 1 + since) / 7):02d}" == week  # what the rule says
    assert one(spark, A.week_id(F.lit(day).cast("date"))) == week


AGENTS = [
    ("Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) Safari/604", ("Tablet", "macOS", "Safari")),
    ("Mozilla/5.0 (Linux; Android 13; SM-X700) Chrome/119", ("Tablet", "Android", "Chrome")),
    ("Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile", ("Mobile", "Android", "Chrome")),
    ("Opera/9.80 (Windows NT 6.1) Presto OPR/12", ("Desktop", "Windows", "Opera")),
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/120 Edg/120", ("Desktop", "Windows", "Edge")),
    ("Mozilla/5.0 (iPhone) FxiOS/1", ("Mobile", "iOS", "Firefox")),
    ("curl/8", ("Desktop", "Unknown", "Chrome")),
    ("", ("Desktop", "Unknown", "Unknown")),
    (None, ("Desktop", "Unknown", "Unknown")),
]


@pytest.mark.parametrize(("agent", "want"), AGENTS)
def test_user_agents(spark, agent, want):
    cols = A.parse_user_agent(F.lit(agent).cast("string"))
    assert tuple(spark.range(1).select(*cols.values()).first()) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [("<b>One</b> two, three!", "one-two-three-k1234567"), ("প্রশ্ন (৩২/৪৭২) : এক দুই", "এক-দুই-k1234567"), ("a" * 80, "a" * 70 + "-k1234567"), ("ab " * 30, "-".join(["ab"] * 23) + "-k1234567"), ("short " + "b" * 90, "short-" + "b" * 64 + "-k1234567"), ("!!", "k123456789"), (None, "k123456789")],
)
def test_slug(spark, title, want):
    assert one(spark, X.slug(F.lit(title).cast("string"), F.lit("k123456789"))) == want


def test_archives_of_all_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"q": "one",\n   "body": "1"},\n  "raw text",\n  {"answer": "2", "body": null}\n]')
    (tmp_path / "b.json").write_text('{"q": "single",\n "answer": "3"}\n')
    (tmp_path / "c.json").write_text("{broken")
    got = S.load_json_archive(spark, f"file://{tmp_path}/*.json", "q string, answer string, body string", {"text": ["answer", "body"]}, whole=True)
    assert sorted(((r.origin, r.raw, r.q, r.text) for r in got.collect()), key=str) == [("a.json", "raw text", None, None), ("a.json", None, "one", "1"), ("a.json", None, None, "2"), ("b.json", None, "single", "3")]


def test_searches_find_clicks_in_time(spark):
    import random

    from datetime import datetime, timedelta

    rng, t0 = random.Random(1), datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=rng.randrange(0, 20000) * rng.choice([1, 9])), rng.randrange(3), rng.choice(["view", "click"]), 1.0, f'{{"k": {rng.randrange(50)}}}') for i in range(400)]
    rows += [(900, t0, 9, "view", 1.0, '{"k": 1}'), (901, t0 + timedelta(minutes=30), 9, "click", 1.0, '{"k": 1}'), (902, t0, 8, "view", 1.0, '{"k": 1}'), (903, t0, 8, "click", 1.0, '{"k": 1}')]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    want = {r[0] for r in rows if r[3] == "view" and any(c[3] == "click" and c[2] == r[2] and r[1] < c[1] <= r[1] + timedelta(minutes=30) for c in rows)}
    got = A.searches(e).collect()
    assert len(got) == sum(r[3] == "view" for r in rows) and {r.event_id for r in got if r.clicked_position is not None} == want and 900 in want and 902 not in want


@pytest.mark.parametrize(("part", "whole", "places", "want"), [(1, 8, 2, 0.13), (247, 20, 1, 12.4), (0, 5, 2, 0.0), (5, 0, 2, None), (10**15 + 5, 10, 0, 10**14 + 1)])
def test_ratio_rounds_half_up(spark, part, whole, places, want):
    assert one(spark, A.ratio(F.lit(part).cast("long"), F.lit(whole).cast("long"), places)) == want


def ranked(spark, docs):
    return spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(docs)], "query_id long, doc_id string, rank int")


def test_fusion_prefers_what_both_lists_have(spark):
    a, b = ranked(spark, ["doc1", "doc2", "doc3"]), ranked(spark, ["doc2", "doc4", "doc1"])
    assert [r.doc_id for r in R.rrf(a, b).orderBy("rank").collect()][:2] == ["doc2", "doc1"]
    same = {(r.doc_id, r.score) for r in R.rrf(a, b).collect()}
    assert same == {(r.doc_id, r.score) for r in R.rrf(b, a).collect()}
    assert [r.doc_id for r in R.rrf(a, b.limit(0)).orderBy("rank").collect()] == ["doc1", "doc2", "doc3"]


def test_second_upsert_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    src = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in I.classify(old, src, "k", ["v"]).collect()} == {("b", "updated"), ("c", "inserted")}
    new = I.upsert(old, src, "k")
    assert {r.status for r in I.classify(new, src, "k", ["v"]).collect()} == {"skipped"}


@pytest.mark.parametrize("seed", range(4))
def test_cut_at_known_run_over_many_ranges(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]) if i % 3 else "a", rng.random() < 0.9 if rng.random() < 0.97 else None) for i in range(600)]
    want = set()
    for part in ("a", "b", None):
        own, length = sorted((r for r in rows if r[1] == part), reverse=True), 0
        kept = list(own)
        for n, r in enumerate(own):
            length = length + 1 if r[2] else 0
            if length == 20:
                kept = own[: n - 19]
                break
        want |= {r[0] for r in kept}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many small ranges
    spark.conf.set("spark.sql.shuffle.partitions", "97" if seed % 2 else "4")
    try:
        d = spark.createDataFrame(rows, "id long, part string, known boolean")
        got = {r.id for r in I.cut_at_known_run(d, "part", [F.desc("id")], "known", 20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want


def test_cover_density_against_brute_force(spark):
    import itertools
    import random

    rng, rows = random.Random(3), []
    for doc in range(40):
        for pos in sorted(rng.sample(range(1, 60), rng.randint(1, 14))):
            rows.append((1, doc, pos, rng.choice("xyz"), rng.choice("ABCD"), 3))
    want = {}
    for doc in range(40):
        own = [r for r in rows if r[1] == doc]
        whole = lambda i, j: {r[3] for r in own[i : j + 1]} == set("xyz")  # noqa: B023, E731
        for i, j in itertools.combinations(range(len(own)), 2):
            if whole(i, j) and not whole(i + 1, j) and not whole(i, j - 1):
                n, inverse = j - i + 1, sum(1 / R.CLASS_WEIGHTS[r[4]] for r in own[i : j + 1])
                want[doc] = want.get(doc, 0) + n / inverse / (1 + own[j][2] - own[i][2] - (n - 1))
    got = {r.doc_id: r.score for r in R.cover_density(spark.createDataFrame(rows, "query_id long, doc_id long, pos int, term string, field string, need int")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_transliteration_steps(spark):
    dictionary = spark.createDataFrame([("wudu", 1, "oju"), ("wudu", 2, "uju"), ("vanga", 1, "bhanga"), ("kora", 1, "kora")], "variant string, alt int, output string")
    rules = spark.createDataFrame([(1, "er", 2, "", 2, "er", "r"), (2, "r", 1, "", 3, "er", "r"), (3, "le", 2, "a", 2, "", "")], "rule_no int, suffix string, off int, put string, least int, ending string, vowel string")
    terms = spark.createDataFrame([("wudu",), ("wudur",), ("vangar",), ("korle",), ("shap",)], "term string")
    got = {}
    for r in E.transliterate(terms, dictionary, rules, [("sh", "S"), ("^a", "A"), ("a", "e")]).orderBy("term", "alt").collect():
        got.setdefault(r.term, []).append((r.rule, r.output))
    assert got == {
        "wudu": [("dictionary", "oju"), ("dictionary", "uju")],
        "wudur": [("inflection", "ojur"), ("inflection", "ujur"), ("inflection", "oju"), ("inflection", "uju")],
        "vangar": [("inflection", "bhangar"), ("inflection", "bhanga")],
        "korle": [("inflection", "kora"), ("inflection", "kora")],
        "shap": [("letters", "Sep")],
    }


@pytest.mark.parametrize(("word", "key"), [("ওযু", "OJU"), ("অজু", "OJU"), ("উযু", "OJU"), ("উজু", "OJU"), ("ওজু", "OJU"), ("kk", "KK"[:1]), ("ṃ", "Ṃ")])
def test_phonetic_keys_of_another_script(spark, word, key):
    sounds = {"য": "J", "জ": "J", "ও": "O", "অ": "O", "উ": "U", "ু": "U", "ৃ": "RI", "ঁ": ""}
    assert one(spark, X.phonetic_key(F.lit(word), sounds, {"UJ": "OJ"})) == key


def test_snippets_mark_whole_words(spark):
    text = "x " * 60 + "the café: thé & <b>the</b> cafés é"
    terms = F.array(F.lit("café"), F.lit("the"))
    at = one(spark, E.snippet_start(F.lit(text), terms))
    assert at == 121 - 80 + 0
    plain, marked = spark.range(1).select(*E.snippet(F.lit(text), terms, F.lit(at), 220)).first()
    assert marked.endswith("<mark>the</mark> <mark>café</mark>: thé &amp; &lt;b&gt;<mark>the</mark>&lt;/b&gt; cafés é") and "&amp;" in plain


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "hit5", "rr", "ndcg10"]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_of_a_large_dictionary(spark, seed):
    """A thousand phrases that overlap, leftmost first and there the longest."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 12)}"
    known = {" ".join(word() for _ in range(rng.randint(1, 4))): rng.choice(["X", "Y Z", ""]) for _ in range(1000)}
    texts = [[word() for _ in range(rng.randint(0, 30))] for _ in range(60)] + [None, ["plain"], ["w1"]]

    def brute(ws):
        out, i = [], 0
        while i < len(ws):
            n = next((n for n in (4, 3, 2, 1) if " ".join(ws[i : i + n]) in known and i + n <= len(ws)), 0)
            out += [w for w in known[" ".join(ws[i : i + n])].split(" ") if w] if n else [ws[i]]
            i += n or 1
        return out

    d = spark.createDataFrame(list(enumerate(texts)), "query_id long, ws array<string>")
    got = {r.query_id: r.ws for r in E.replace_phrases(d, spark.createDataFrame(list(known.items()), "phrase string, output string")).collect()}
    assert got == {i: brute(ws) if ws is not None else None for i, ws in enumerate(texts)}
