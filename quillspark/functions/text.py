"""Expressions over text: cleaning, folding, tokens, stems, scripts, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that do not print, Arabic vowel marks and lengthening, Arabic letter forms, Bengali digits.
INVISIBLE = "[\u200b-\u200d\ufeff]"
ARABIC_MARKS = "[\u064b-\u065f\u0670\u0640]"
ARABIC_FORMS = ("آأإى", "اااي")
BENGALI_DIGITS = ("০১২৩৪৫৬৭৮৯", "0123456789")
APOSTROPHES = "[‘’ʼ`´]"
BREAKS = r"[\s\p{P}\p{S}]+"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Composed form. Only texts beyond ASCII need the Arrow function, but Spark runs it on every row, so callers split tables by non_ascii()."""
    return _nfc(text)


def non_ascii(text: Column) -> Column:
    return F.length(text) != F.octet_length(text)


def spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_arabic(text: Column) -> Column:
    """Without vowel marks and lengthening; Alif forms and final Ya as their plain letters."""
    return F.translate(F.regexp_replace(text, ARABIC_MARKS, ""), *ARABIC_FORMS)


def normalize(text: Column, apostrophes: bool = True) -> Column:
    """Lower case, invisible marks out, Arabic folded, Bengali digits as 0-9, one kind of apostrophe, single spaces."""
    out = F.translate(fold_arabic(F.regexp_replace(F.lower(text), INVISIBLE, "")), *BENGALI_DIGITS)
    return spaces(F.regexp_replace(out, APOSTROPHES, "'") if apostrophes else out)


def tokens(text: Column, stop: list[str] = (), pattern: str = BREAKS) -> Column:
    """Words of a normalised text; stop words go unless nothing else is there."""
    words = F.filter(F.split(text, pattern), lambda w: w != "")
    if not stop:
        return words
    rest = F.filter(words, lambda w: ~w.isin(*stop))
    return F.when(F.size(rest) > 0, rest).otherwise(words)


def endings(suffixes: list[str], rest: int = 2) -> list[str]:
    """Patterns for strip_first: a word that ends with a suffix and has `rest` characters before it."""
    return [f"^(.{{{rest},}}){s}$" for s in suffixes]


def strip_first(token: Column, patterns: list[str], longest: int = 3) -> Column:
    """What the first pattern that fits keeps, which is its one group; tokens of up to `longest` characters stay, and those that nothing fits."""
    kept = "".join(f"${i + 1}" for i in range(len(patterns)))
    return F.when(F.length(token) <= longest, token).otherwise(F.regexp_replace(token, "|".join(patterns), kept))


def stem(token: Column, suffixes: list[str], longest: int = 3, rest: int = 2) -> Column:
    """Without the first suffix of the list that leaves `rest` characters; tokens of up to `longest` characters stay."""
    return strip_first(token, endings(suffixes, rest), longest)


# Endings of Bengali words in the order they are tried, for words of the index and for words typed into a page.
# The letter yya is the single code point, so composed text, where it is two, keeps endings with it.
BENGALI_LONG = (
    "গুলোর গুলির সমূহ গুলো গুলি দেরকে দের খানা খানি গুলো\u09df গুলিতে ভাবে ধারী কারী সম্মত গুলোতে সমূহের "
    "টিতে টাতে টিকে টাকে টির টার েতে \u09dfের েটি ের"
).split()
BENGALI_SHORT = "\u09dfে টা টি জন র ে \u09df".split()
BENGALI_TYPED = (
    "গুলোতে গুলোর গুলোকে গুলো\u09df সমূহের সমূহ গুলির গুলিতে গুলো গুলি দেরকে দের েদেরকে েদের েরা টির টিকে টাতে টার টাকে "
    "খানা খানি ভাবে ধারী কারী সম্মত ের টি টা কে তে রা ে র \u09df \u09dfে"
).split()
BENGALI_CONSONANTS = "\u0995-\u09b9"
#: What ends in the object's ending loses it after a vowel, a sign or another ka; else the word itself ends in ka and loses the place's vowel.
BENGALI_OBJECT = [f"^(.+(?:[^{BENGALI_CONSONANTS}]|ক))কে$", "^(.{2,}ক)ে$"]


def stem_bengali(token: Column) -> Column:
    """Stem of a normalised word, as words of the index have it. Null and short words stay."""
    return strip_first(token, [*endings(BENGALI_LONG), *BENGALI_OBJECT, *endings(BENGALI_SHORT)])


def stem_bengali_typed(token: Column) -> Column:
    """The variant for words typed into a page: words of three letters are stemmed too, and of the endings for object and place only the vowel goes."""
    vowel = {"কে": "^(.{2,}ক)ে$", "তে": "^(.{2,}ত)ে$"}
    return strip_first(token, [vowel.get(s) or endings([s])[0] for s in BENGALI_TYPED], 2)


def processed(words: Column, canonical: Column, stemmed: Callable[[Column], Column], least: int = 2) -> Column:
    """Each word's canonical form, and behind it that form's stem where it is another and has `least` characters. canonical is a map of bounded size."""
    forms = F.transform(words, lambda w: F.coalesce(F.try_element_at(canonical, w), w))
    both = F.transform(forms, lambda f: F.struct(f.alias("form"), stemmed(f).alias("stem")))
    return F.flatten(F.transform(both, lambda b: F.when((b["stem"] != b["form"]) & (F.length(b["stem"]) >= least), F.array(b["form"], b["stem"])).otherwise(F.array(b["form"]))))


def script_counts(text: Column) -> dict[str, Column]:
    """Letters by script."""
    of = {"latin": "[A-Za-z]", "bengali": "[ঀ-৿]", "arabic": "[؀-ۿ]"}
    return {k: F.regexp_count(text, F.lit(p)) for k, p in of.items()}


def phonetic_key(token: Column, classes: dict[str, str], heads: dict[str, str]) -> Column:
    """A token's letters as their sound classes, those without one in upper case, each run of a class once; `heads` replaces beginnings of the result."""
    single = {k: v for k, v in classes.items() if len(v) == 1}
    longer = [(k, v) for k, v in classes.items() if len(v) > 1]
    silent = "".join(k for k, v in classes.items() if not v)
    out = F.upper(F.translate(token, "".join(single) + silent, "".join(single.values())))
    for k, v in longer:
        out = F.replace(out, F.upper(F.lit(k)), F.lit(v))
    out = F.regexp_replace(out, r"(.)\1+", "$1")
    for k, v in heads.items():
        out = F.regexp_replace(out, f"^{k}", v)
    return out


def phonetic_keys(words: Column, classes: dict[str, str], heads: dict[str, str], least: int = 2) -> Column:
    """Distinct keys of a text's words, of `least` characters or more."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: phonetic_key(w, classes, heads)), lambda k: F.length(k) >= least))


def html_to_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return spaces(out)


# Elements that go with what they hold, elements of which only the tags go, and addresses that run code.
UNSAFE_ELEMENTS = "script iframe object embed style svg math".split()
UNSAFE_TAGS = "base meta link form input button textarea select".split()
UNSAFE_ADDRESSES = ("javascript:", "vbscript:", r"data:(?:text/html|image/svg\+xml)")
#: What one pass of sanitising takes out, in order: each element up to its own end tag, then what is left of its tags.
UNSAFE = (
    *(p for e in UNSAFE_ELEMENTS for p in (rf"(?is)<{e}\b.*?</{e}>", rf"(?i)</?{e}\b[^>]*>")),
    rf"(?i)</?(?:{'|'.join(UNSAFE_TAGS)})\b[^>]*>",
    r"""(?i)\bon\w+\s*=\s*(?:'[^']*'|"[^"]*"|[^\s>]+)""",
    *(rf"""(?i){a}[^"'\s]*""" for a in UNSAFE_ADDRESSES),
)
_ANY_UNSAFE = "(?i)</?(?:" + "|".join([*UNSAFE_ELEMENTS, *UNSAFE_TAGS]) + r")\b|\bon\w+\s*=|" + "|".join(UNSAFE_ADDRESSES)


def sanitize(html: Column, passes: int = 5) -> Column:
    """Unsafe markup taken out again and again, as taking out can bring forth more. A pass is skipped where nothing is left to take out."""

    def once(text: Column) -> Column:
        for pattern in UNSAFE:
            text = F.regexp_replace(text, pattern, "")
        return text

    return F.trim(F.aggregate(F.sequence(F.lit(1), F.lit(passes)), html, lambda text, _: F.when(text.rlike(_ANY_UNSAFE), once(text)).otherwise(text)))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[spaces(F.coalesce(p, F.lit(""))) for p in parts]), 256)


def hash_uuid(digest: Column) -> Column:
    d = F.when(F.length(digest) >= 32, digest).otherwise(F.sha2(digest, 256))
    return F.concat_ws("-", *[F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


# Fixed value: the label and number that questions of the reference data begin with.
QUESTION_LABEL = r"^প্রশ্ন\s*(?:\([^)]+\)|[০-৯0-9/\s-]+)?\s*[:ঃ-]?\s*"


def slug(title: Column, key: Column, most: int = 70, least: int = 20, label: str = QUESTION_LABEL) -> Column:
    """Letters, digits and hyphens of a title and the beginning of a key; the key alone where the title has none.

    A title of more than `most` characters is cut at its last hyphen, if more than `least` stand before it.
    """
    tagless = F.regexp_replace(title, r"<[^>]*>", "")
    bare = F.trim(F.regexp_replace(tagless, label, ""))
    plain = F.lower(F.when(bare != "", bare).otherwise(tagless))
    joined = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}]+", "-"), r"^-+|-+$", "")
    at_hyphen = F.regexp_extract(joined, rf"^(.{{{least + 1},{most}}})-", 1)
    whole = F.when(F.length(joined) <= most, joined).when(at_hyphen != "", at_hyphen).otherwise(F.regexp_replace(F.substring(joined, 1, most), "-+$", ""))
    return F.when(F.coalesce(whole, F.lit("")) == "", key).otherwise(F.concat_ws("-", whole, F.substring(key, 1, 8)))


def title_of(text: Column, most: int = 120) -> Column:
    """The first line, cut."""
    return F.substring(F.substring_index(text, "\n", 1), 1, most)
