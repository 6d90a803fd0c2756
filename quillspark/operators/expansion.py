"""What becomes of a query's words: rules, transliteration, scoring by features, snippets. Tables are arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rules(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns of the first rule (smallest rule_no) whose pattern a query's text has; queries without one are left out. Rules are a dictionary of bounded size."""
    columns = [c for c in rules.columns if c not in ("rule_no", "pattern")]
    fits = queries.join(F.broadcast(rules), F.expr("text RLIKE pattern"))
    best = fits.groupBy("query_id").agg(F.min_by(F.struct(*columns), "rule_no").alias("r"))
    return best.select("query_id", "r.*")


def replace_phrases(texts: DataFrame, phrases: DataFrame, key: str = "query_id", words: str = "ws") -> DataFrame:
    """(key, words): texts as arrays of words with phrases (phrase, output) in the place of what they stand for, leftmost first and there the longest; what is put in is not looked at again.

    The dictionary may have any size: runs of words, of as many words as phrases have, are joined with it. Of one phrase that is there
    twice the least output counts. Null texts and texts without a phrase stay as they are.
    """
    known = phrases.withColumn("n", F.size(F.split("phrase", " "))).where("phrase <> ''").groupBy("phrase", "n").agg(F.min("output").alias("output"))
    lengths = F.broadcast(known.agg(F.array_sort(F.collect_set("n")).alias("ns")))  # one row: how many words phrases have
    starts = texts.select(key, F.col(words).alias("w")).crossJoin(lengths).select(key, "w", F.explode("ns").alias("n"))
    runs = starts.where(F.size("w") >= F.col("n")).select(key, "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(F.col("w"), i, F.col("n")), " ").alias("phrase")))).alias("r")).select(key, "n", "r.i", "r.phrase")
    found = runs.join(known, ["phrase", "n"]).groupBy(key, "i").agg(F.max_by(F.struct("n", "output"), "n").alias("p"))
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "p.n", "p.output"))).alias("l"))  # a text's words at most
    none = F.array().cast("array<struct<i: int, n: int, output: string>>")
    taken = F.aggregate("l", F.struct(F.lit(1).alias("free"), none.alias("out")), lambda s, x: F.when(x["i"] >= s["free"], F.struct((x["i"] + x["n"]).alias("free"), F.array_append(s["out"], x).alias("out"))).otherwise(s))["out"]
    empty = F.array().cast("array<string>")
    joined = texts.join(listed.select(key, taken.alias("taken")), key, "left")
    # what stands before each phrase, its output, and what is left at the end
    pieces = F.aggregate("taken", F.struct(F.lit(1).alias("at"), empty.alias("out")), lambda s, x: F.struct((x["i"] + x["n"]).alias("at"), F.concat(s["out"], F.slice(F.col(words), s["at"], x["i"] - s["at"]), F.filter(F.split(x["output"], " "), lambda w: w != "")).alias("out")))
    whole = joined.withColumn("_p", pieces)
    rest = F.concat(F.col("_p.out"), F.slice(F.col(words), F.col("_p.at"), F.size(words)))
    return whole.select(*[F.when(F.col("taken").isNull(), F.col(words)).otherwise(rest).alias(c) if c == words else F.col(c) for c in texts.columns])


def transliterate(terms: DataFrame, dictionary: DataFrame, rules: DataFrame, letters: list[tuple[str, str]], vowels: str = "aeiou") -> DataFrame:
    """(term, rule, alt, output) of distinct words; alt orders a word's outputs, the first is the one to show.

    A word of the dictionary (variant, alt, output) has its outputs. Else the first rule (rule_no, suffix, off, put, least, ending,
    vowel) counts that leads to one: the word ends in the suffix, `off` characters are taken off, `least` must stay, and with `put`
    behind them they are in the dictionary; its outputs get the ending, or that after a vowel, and are kept without it too. Any
    other word goes through the ordered letter replacements.
    """
    known = F.broadcast(dictionary)
    exact = terms.join(known, F.col("term") == F.col("variant")).select("term", F.lit("dictionary").alias("rule"), "alt", "output")
    other = terms.join(exact.select("term").distinct(), "term", "left_anti")
    cut = other.join(F.broadcast(rules), F.expr("endswith(term, suffix) AND length(term) - off >= least")).withColumn("stem", F.expr("left(term, length(term) - off) || put"))
    hit = cut.join(F.broadcast(dictionary.select("variant").distinct()), F.col("stem") == F.col("variant"), "left_semi")
    best = hit.groupBy("term").agg(F.min_by(F.struct("stem", "ending", "vowel"), "rule_no").alias("r")).select("term", "r.*")
    rooted = best.join(known, F.col("stem") == F.col("variant"))
    inflected = F.concat("output", F.when(F.col("output").rlike(f"[{vowels}]$"), F.col("vowel")).otherwise(F.col("ending")))
    both = F.explode(F.array(F.struct(F.col("alt").alias("alt"), inflected.alias("output")), F.struct((F.col("alt") + 100).alias("alt"), F.col("output").alias("output"))))
    derived = rooted.select("term", both.alias("o")).select("term", F.lit("inflection").alias("rule"), "o.alt", "o.output")
    spelled = reduce(lambda text, r: F.regexp_replace(text, *r), letters, F.col("term"))
    rest = other.join(best.select("term"), "term", "left_anti").select("term", F.lit("letters").alias("rule"), F.lit(1).alias("alt"), spelled.alias("output"))
    return exact.unionByName(derived).unionByName(rest)


def transliterated_text(placed: DataFrame, outputs: DataFrame) -> DataFrame:
    """(query_id, text, inflected): the first output of each word in order, and how many came from an inflection."""
    first = outputs.groupBy("term", "rule").agg(F.min_by("output", "alt").alias("output"))
    listed = placed.join(first, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "output"))).alias("l"), F.count_if(F.col("rule") == "inflection").alias("inflected"))  # a query's words
    return listed.select("query_id", F.array_join(F.col("l.output"), " ").alias("text"), "inflected")


def rerank(cand: DataFrame, w: dict[str, float]) -> DataFrame:
    """cand with its score again from features, in this order: whole query and canonical form, keywords, subject with aspect, words
    and how many of them, first word, synonyms, sounds.

    Columns: score, title, text (lower case), whole, toks, syns, pool (the first word and its synonyms), first, canonical, subject,
    aspect, keywords, sounds (shared phonetic keys). A word counts where it is a part of the text.
    """
    held = lambda text, x: F.coalesce(F.contains(F.col(text), x), F.lit(False))
    either = lambda x, title, text: F.when(held("title", x), w[title]).when(held("text", x), w[text]).otherwise(0.0)
    every = lambda xs, title, text: F.aggregate(xs, F.lit(0.0), lambda s, x: s + either(x, title, text))
    n, m = F.size("toks"), F.size(F.filter("toks", lambda x: F.contains(F.col("title"), x)))
    s = 100 + F.col("score") + either(F.col("whole"), "phrase title", "phrase text") + either(F.col("canonical"), "canonical title", "canonical text") + every("keywords", "keyword title", "keyword text")
    step = cand.withColumn("_s", s)
    sub_title, sub_text, asp_title, asp_text = (held(t, F.col(c)) for c in ("subject", "aspect") for t in ("title", "text"))
    s, many = F.col("_s"), n >= 2
    aimed = F.when(F.col("subject").isNull(), s).when(sub_title & asp_title, s + w["both title"]).when(sub_title & asp_text, s + w["subject title"]).when(asp_title & sub_text, s + w["aspect title"])
    aimed = aimed.when(sub_text & asp_text, s + w["both text"]).when(sub_title & many, s * w["subject only"]).when(asp_title & many, s * w["aspect only"]).otherwise(s)
    step = step.withColumn("_s", aimed).withColumn("_s", s + every("toks", "word title", "word text"))
    step = step.withColumn("_s", F.when(many & (m >= n), s + w["all words"]).when(many & (m >= 2), s + m / n * w["some words"]).when(many, s * w["few words"]).when(n == 1, s + m * w["one word"]).otherwise(s))
    lost = many & (F.length("first") >= 2) & ~F.exists("pool", lambda x: F.contains(F.col("title"), x) | F.contains(F.col("text"), x))
    step = step.withColumn("_s", F.when(lost, s * w["no subject"]).otherwise(s))
    return step.withColumn("score", s + every("syns", "synonym title", "synonym text") + w["sound"] * F.col("sounds")).drop("_s")


def keyword_points(cand: DataFrame, fields: list[str], base: int, phrase: tuple[int, ...], word: tuple[int, ...], synonym: tuple[int, ...]) -> DataFrame:
    """(query_id, doc_id, score) of whole, toks, syns and fields in lower case: points of the first field that holds the whole query, each word, each synonym; a kind has points for as many of the fields as are listed."""
    first = lambda points, x: reduce(lambda held, f: F.when(F.contains(F.col(f[0]), x), f[1]).otherwise(held), reversed(list(zip(fields, points, strict=False))), F.lit(0))
    each = lambda xs, points: F.aggregate(xs, F.lit(0), lambda s, x: s + first(points, x))
    return cand.select("query_id", "doc_id", (base + first(phrase, F.col("whole")) + each("toks", word) + each("syns", synonym)).cast("long").alias("score"))


_GAP = r"[^\p{L}\p{N}\p{M}]"


def snippet_start(text: Column, terms: Column, before: int = 80) -> Column:
    """Where a snippet begins: `before` characters ahead of the first of the words, which must stand on their own, or further ahead at the letter that a combining mark there belongs to."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _GAP, " "), F.lit(" "))
    places = F.filter(F.transform(terms, lambda t: F.call_function("instr", flat, F.concat(F.lit(" "), t, F.lit(" ")))), lambda p: p > 0)
    at = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - before, F.lit(1))
    cluster = F.length(F.regexp_extract(F.substring(text, F.lit(1), at), r"(?s)(\P{M}?\p{M}+)\z", 1))
    return F.when(cluster > 0, F.greatest(at - cluster + 1, F.lit(1))).otherwise(at)


def snippet(text: Column, terms: Column, at: Column, most: int) -> tuple[Column, Column]:
    """`most` characters from a place on, and the combining marks of the last one, safe as HTML: without and with <mark> around the words, of any script."""
    rest = F.regexp_extract(F.substring(text, at + most, F.length(text)), r"^\p{M}+", 0)
    cut = F.concat(F.substring(text, at, F.lit(most)), rest)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        cut = F.replace(cut, F.lit(plain), F.lit(entity))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}\p{M}])("), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}\p{M}])"))
    return cut, F.regexp_replace(cut, pattern, F.lit("<mark>$1</mark>"))
