"""Benchmark decontamination by a positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, release, stored

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated from one hit word in so many words on.
SHARE = 20
#: Parts that the list of one term is dealt into.
SALT = 16


def _key(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _split(norm: Column) -> Column:
    """Words with an empty string before and after, where the text begins or ends with a break."""
    return F.split(norm, BREAK, -1)


def _count(words: Column) -> Column:
    last = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - F.when(words[0] == "", 1).otherwise(0) - last).cast("long")


@dataclass
class PositionalIndex:
    """The training side, stored once and used for any number of test sets.

    postings: key (MD5 of the normalised text, so that equal texts share one), pos, term; frequency: term, n.
    """

    postings: DataFrame
    frequency: DataFrame


def build_index(docs: DataFrame, text_col: str = "text") -> PositionalIndex:
    """Postings of all words of all texts, in the order of the texts: each task writes those of its own, nothing is shuffled but counts."""
    norm = ascii_lower(F.col(f"`{text_col}`"))
    texts = docs.select(_key(norm).alias("key"), _split(norm).alias("w"))
    # the outer form: no filter that splits each text a second time is inferred from it
    postings = stored(texts.select("key", F.posexplode_outer("w").alias("pos", "term")).where("term <> ''"))
    return PositionalIndex(postings, stored(postings.groupBy("term").agg(F.count("*").alias("n"))))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, win, words) of each item: `window` consecutive words; a shorter item is one window, one without words has none. win names the words."""
    words = F.filter(_split(ascii_lower(F.col(f"`{text_col}`"))), lambda w: w != "")
    w = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = w.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, window))).alias("words")).distinct()
    return cut.select("item", _key(F.array_join("words", " ")).alias("win"), "words")


def rarest_terms(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each window with its rarest term in the corpus and the second rarest: win, words, term, at (offset), term2, at2 (null for a single word).

    A window with a word that the corpus has nowhere is left out, as it can't occur. Grows with the test set only.
    """
    listed = windows.select("win", "words").distinct().select("win", "words", F.posexplode("words").alias("at", "term")).join(frequency, "term", "left")
    order = W.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "at")
    ranked = listed.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    by = ranked.groupBy("win", "words").agg(*[F.max(F.when(F.col("rank") == r, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at"))).alias(f"r{r}") for r in (1, 2)])
    return by.where("r1.n > 0").select("win", "words", F.col("r1.term").alias("term"), F.col("r1.at").alias("at"), F.col("r2.term").alias("term2"), F.col("r2.at").alias("at2"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def lists_of(index: PositionalIndex, rarest: DataFrame) -> DataFrame:
    """The lists of the windows' rarest terms: term, key, pos, salt (which part of its term's list a posting is in).

    A frequent term's list is dealt into SALT parts, and so are the terms it is looked up by, which grow with the test set only.
    Copies of a text have the same postings, which are summed up where they are.
    """
    terms = rarest.select(F.explode(F.array("term", "term2")).alias("term")).where("term IS NOT NULL").distinct()
    salt = F.pmod(F.xxhash64("key", "pos"), F.lit(SALT)).cast("int")
    return index.postings.withColumn("salt", salt).join(_salted(terms), ["term", "salt"]).distinct()


def phrase_matches(docs: DataFrame, lists: DataFrame, rarest: DataFrame, text_col: str = "text") -> DataFrame:
    """Exact occurrences of windows: key, win, start (word), length.

    The list of a window's rarest term is intersected with that of the second rarest at the offset between them; what is left is
    compared word by word with its text. Of the texts only those that still have a candidate are looked at, once each.
    """
    first = lists.join(_salted(rarest.select("win", "term", "at", "term2", "at2", F.size("words").alias("length"))), ["term", "salt"])
    first = first.select("key", "win", (F.col("pos") - F.col("at")).alias("start"), "term2", "at2", "length").where("start >= 0")
    second = lists.select(F.col("term").alias("term2"), "key", F.col("pos").alias("pos2"))
    both = stored(first.where("term2 IS NOT NULL").withColumn("pos2", F.col("start") + F.col("at2")).join(second, ["term2", "key", "pos2"], "left_semi").select("key", "win", "start", "length"))
    norm = ascii_lower(F.col(f"`{text_col}`"))
    texts = docs.select(_key(norm).alias("key"), norm.alias("norm")).join(stored(both.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    words = texts.select("key", _split(F.col("norm")).alias("w"))
    same = F.slice("w", F.col("start") + 1, F.col("length")) == F.col("words")
    checked = both.join(rarest.select("win", "words"), "win").join(words, "key").where(same).select("key", "win", "start", "length")
    return checked.unionByName(first.where("term2 IS NULL").select("key", "win", "start", "length"))


def proximity_matches(lists: DataFrame, rarest: DataFrame, slop: int = WINDOW) -> DataFrame:
    """Texts in which a window's two rarest terms stand at most `slop` words apart, in any order: key, win, distance (the least)."""
    both = rarest.where(F.col("term2").isNotNull() & (F.col("term2") != F.col("term"))).select("win", "term", "term2")
    # places are dealt into stretches of slop + 1 words, so that what is near is in the same stretch or beside it
    stretch = lambda c: F.floor(F.col(c) / (slop + 1))
    first = lists.select("term", "key", "pos").join(both, "term").withColumn("stretch", F.explode(F.array(*[stretch("pos") + i for i in (-1, 0, 1)])))
    second = lists.select(F.col("term").alias("term2"), "key", F.col("pos").alias("pos2")).withColumn("stretch", stretch("pos2"))
    found = first.join(second, ["term2", "key", "stretch"]).withColumn("distance", F.abs(F.col("pos") - F.col("pos2")))
    return found.where(F.col("distance") <= slop).groupBy("key", "win").agg(F.min("distance").alias("distance"))


def find_contamination(docs: DataFrame, index: PositionalIndex, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Matches by text: key, n_hit, n_items, items_sha256 of the texts in which a window of an item occurs; with a slop also n_near,
    the items of which some window's two rarest terms stand so near each other (a text that has only such has no hits)."""
    windows = stored(item_windows(items, item_id_col, item_text_col, window))
    rarest = stored(rarest_terms(windows, index.frequency))
    lists = stored(lists_of(index, rarest))
    found = stored(phrase_matches(docs, lists, rarest, text_col))
    owners = windows.select("win", "item")
    words = found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = found.select("key", "win").distinct().join(owners, "win").select("key", "item").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    exact = words.join(named, "key")
    if slop is None:
        return exact
    near = proximity_matches(lists, rarest, slop).join(owners, "win").select("key", "item").distinct().groupBy("key").agg(F.count("*").alias("n_near"))
    return exact.join(near, "key", "full_outer")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = SHARE, slop: int | None = None, index: PositionalIndex | None = None) -> DataFrame:
    """Per document: row (a struct of its columns), n_words, n_hit, n_items, items_sha256, contaminated; with a slop also n_near.

    A document is contaminated if at least one of its words is hit and `share` times its hit words reach its words. n_near counts
    items of which a window's two rarest terms stand at most `slop` words apart; it decides nothing. An index of docs that is there
    already (build_index) is used again for a further test set.

    Defined cases: null text has no words and is never contaminated; items with null or empty text have no window; a null
    item id counts as no name (its hits count, the list of names leaves it out); equal item ids are one item; rows that are
    repeated are judged alike; very long texts are one row of the text and as many narrow postings as words; empty tables on
    either side give no hits; other columns stay in the struct, so that no name of theirs can clash.
    """
    norm = ascii_lower(F.col(f"`{text_col}`"))
    own = index or build_index(docs, text_col)
    hits = stored(find_contamination(docs, own, items, text_col, item_id_col, item_text_col, window, slop))
    if index is None:
        release(own.postings, own.frequency)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(norm).alias("key"), _count(_split(norm)).alias("n_words"))
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    more = [] if slop is None else [F.coalesce("n_near", zero).alias("n_near")]
    return rows.join(hits, "key", "left").select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), *more)
