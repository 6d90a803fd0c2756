"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read as word classes: insult (I) and threat (H) heads, target (T), negation (N), reported speech (R). A row of
transducers reads it forwards, with cues that stand before a head, and another reads what these wrote backwards, with cues that
stand behind it ("I will kill you", "töte dich nicht", "an idiot, he said"). Each marks heads and adds its weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.labels import SAMPLE, held_out, sampled_texts

# Words of each class, in English, German, French and Spanish.
INSULTS = "idiot moron stupid pathetic loser clown scum trash worthless disgusting dumb imbecile jerk trottel arschloch dummkopf abschaum connard abruti ordure imbécile estúpido imbécil basura".split()
THREATS = "kill murder hurt destroy beat strangle stab töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself he him she her they them du dich dein ihr euch tu te toi vous ton votre tú usted ustedes vosotros".split()
NEGATIONS = "not never no nobody isn't aren't nicht kein keine niemals nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says called quoted reported wrote claims sagte sagt nannte schrieb dit appelé écrit dijo dice llamó escribió".split()
#: Lengths of beginnings of words that may be learned as insults, besides whole words (ending in $).
STEMS = (3, 4, 5, 6, 7, 8, 9)
#: A term is learned if so much of the rows that have it are toxic, and if this is too unlikely for chance among all terms
#: that are tried (log-likelihood ratio above the logarithm of their number, plus a margin). Terms of fewer rows aren't tried.
LEAST_PRECISION, MARGIN, LEAST_ROWS = 0.95, 5.0, 4
#: Terms are learned in up to so many rounds, each from the rows in which no term known by then occurs.
ROUNDS = 4
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """(state, input) -> (state, output, weight); inputs without a rule are passed on by `default` of the state, at no weight."""

    rules: dict[tuple[int, str], tuple[int, str, float]]
    default: dict[int, int] = field(default_factory=dict)
    start: int = 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.rules.get((state, symbol)) or (self.default.get(state, state), symbol, 0.0)


class Composed:
    """Transducers in a row, each reading what the one before writes; product states are made as they are met and kept."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.known: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str, float]] = {}

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
        found = self.known.get((state, symbol))
        if found is None:
            out, weight, new = symbol, 0.0, []
            for p, s in zip(self.parts, state, strict=True):
                s, out, w = p.step(s, out)
                new.append(s)
                weight += w
            found = self.known[state, symbol] = (tuple(new), out, weight)
        return found

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        state, outs, total = self.start, [], 0.0
        for x in symbols:
            state, out, weight = self.step(state, x)
            outs.append(out)
            total += weight
        return outs, total


#: Marks of a head: negated, reported, targeted; a head is I or H with some of them, in this order.
MARKS = "-~+"
HEADS = tuple(h + "".join(m for i, m in enumerate(MARKS) if bits >> i & 1) for h in "IH" for bits in range(8))


def _marked(head: str, mark: str) -> str:
    return head[0] + "".join(m for m in MARKS if m in head or m == mark)


def _within(cue: str, reach: int, mark: str, weight: float) -> Transducer:
    """Marks a head that follows a cue within `reach` words, unless it has the mark: state s is how many words the cue still reaches."""
    rules = {(s, cue): (reach, cue, 0.0) for s in range(reach + 1)}
    rules |= {(s, h): (s - 1, _marked(h, mark), weight) for s in range(1, reach + 1) for h in HEADS if mark not in h}
    return Transducer(rules, {s: max(s - 1, 0) for s in range(reach + 1)})


@dataclass
class Grammar:
    """Transducers that read a clause forwards, and those that read their output backwards."""

    forwards: Composed
    backwards: Composed

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        outs, before = self.forwards.run(symbols)
        outs, behind = self.backwards.run(outs[::-1])
        return outs[::-1], before + behind


def grammar() -> Grammar:
    """Insult and threat transducers (1 and 1.5 a head), then negation (takes 1 back), reported speech (half) and target (adds half)."""
    insult, threat = (Transducer({(0, h): (0, h, weight)}) for h, weight in (("I", 1.0), ("H", 1.5)))
    reported = Transducer({(s, "R"): (1, "R", 0.0) for s in (0, 1)} | {(1, h): (1, _marked(h, "~"), -0.5) for h in HEADS if "~" not in h})
    return Grammar(Composed(insult, threat, _within("N", 3, "-", -1.0), reported, _within("T", 5, "+", 0.5)), Composed(_within("N", 2, "-", -1.0), reported, _within("T", 3, "+", 0.5)))


#: What a head can have become, and so the counts that make a document's features; the last is the sum of clauses' weights.
OUTPUTS = HEADS


@dataclass
class ToxicityModel:
    terms: dict[str, str]
    weights: np.ndarray
    bias: float

    def pattern(self) -> str:
        """Insults and threats, at the beginning of a word."""
        stems = [re.escape(t) for t in self.terms if not t.endswith("$")]
        words = [re.escape(t.rstrip("$")) for t in [*self.terms, *INSULTS, *THREATS] if t.endswith("$") or t in INSULTS or t in THREATS]
        return "|".join([*stems, rf"(?:{'|'.join(sorted(set(words)))})(?:[^\pL]|$)"])

    def classes(self) -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
        """Classes of words, and beginnings of words by class; a learned term is an insult or a threat."""
        table = {w: c for c, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS), ("I", INSULTS)) for w in ws}
        stems = {c: tuple(t for t, kind in self.terms.items() if kind == c and not t.endswith("$")) for c in "IH"}
        return table | {t[:-1]: kind for t, kind in self.terms.items() if t.endswith("$")}, stems


def clause_features(text: str, table: dict[str, str], stems: dict[str, tuple[str, ...]], machine: Grammar) -> np.ndarray:
    """Counts of what heads became over all clauses, and the sum of the clauses' positive weights, all as log(1 + x)."""
    counts, total = Counter(), 0.0
    for clause in CLAUSE.split(text):
        symbols = [table.get(w) or next((c for c, begun in stems.items() if begun and w.startswith(begun)), "o") for w in WORD.findall(clause)]
        if "I" in symbols or "H" in symbols:
            outs, weight = machine.run(symbols)
            counts.update(outs)
            total += max(weight, 0.0)
    return np.log1p([*(counts[o] for o in OUTPUTS), total])


def _holds(lower: pa.Array, pattern: str) -> np.ndarray:
    """Whether a word of each text begins as the pattern says."""
    return pc.match_substring_regex(lower, rf"(?:^|[^\pL])(?:{pattern})").to_numpy(zero_copy_only=False)


def _features(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """A row per text. Only texts in which a head occurs at all are cut into clauses."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    hit = _holds(lower, model.pattern())
    out = np.zeros((len(texts), len(OUTPUTS) + 1))
    (table, stems), machine = model.classes(), grammar()
    for i in np.flatnonzero(hit):
        out[i] = clause_features(lower[int(i)].as_py(), table, stems, machine)
    return out


def learn_terms(rows: DataFrame, rounds: int = ROUNDS) -> dict[str, str]:
    """Words (ending in $) and beginnings of words that mark toxic rows of a sample (text, value), each as an insult (I) or a threat (H).

    This is sequential covering: rows that hold a known term explain themselves, so the next round learns from the others only. Few
    of those are toxic, and words of a language with few rows stand out against them that would not against all rows. It ends with a
    round that finds nothing.
    """
    found: dict[str, str] = {}
    for _ in range(rounds):
        new = _new_terms(rows, ToxicityModel(found, np.zeros(0), 0.0).pattern() if found else None)
        if not new:
            break
        found |= new
    kept: dict[str, str] = {}  # a beginning stands for all that begins with it
    for t in sorted(found, key=lambda t: (t.endswith("$"), len(t), t)):
        if not any(t[:n] in kept for n in range(1, len(t))):
            kept[t] = found[t]
    return kept


def _new_terms(rows: DataFrame, known: str | None) -> dict[str, str]:
    """Terms of the rows in which the pattern `known` occurs nowhere.

    Each task sends sums of its counts. A term that a target follows within two words more often than one stands before it takes
    that target as its object and is a threat, as in "kill you"; any other is an insult, as in "you idiot". A term that begins one of
    the fixed words is of its class. All terms that pass the test are learned: there are only as many as the sample's rows hold,
    which is what bounds them.
    """
    target = frozenset(TARGETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, behind, before = (Counter(), Counter()), Counter(), Counter()
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text").cast(pa.large_string()).fill_null(""))
            left = ~_holds(texts, known) if known else np.ones(len(texts), bool)
            for i in np.flatnonzero(left):
                value, found = bool(batch.column("value")[int(i)].as_py()), set()
                for clause in CLAUSE.split(texts[int(i)].as_py()):
                    words = WORD.findall(clause)
                    aimed = [w in target for w in words]
                    for at, w in enumerate(words):
                        terms = [*(w[:n] for n in STEMS if len(w) >= n), f"{w}$"]
                        found.update(terms)
                        if value and any(aimed[at + 1 : at + 3]):
                            behind.update(terms)
                        if value and any(aimed[max(at - 2, 0) : at]):
                            before.update(terms)
                seen[value].update(found)
                seen[value][""] += 1
        terms = list(seen[0] | seen[1])
        counts = [pa.array([c[t] for t in terms], pa.int64()) for c in (seen[1], seen[0], behind, before)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], names=["term", "toxic", "other", "behind", "before"])

    sums = [F.sum(c).alias(c) for c in ("toxic", "other", "behind", "before")]
    counted = stored(rows.mapInArrow(count, "term string, toxic long, other long, behind long, before long").groupBy("term").agg(*sums))
    total = counted.where("term = ''").first()
    if total is None or not total.toxic or not total.other:
        return {}
    tried = max(counted.where(F.col("toxic") + F.col("other") >= LEAST_ROWS).count(), 1)
    rate = total.toxic / (total.toxic + total.other)
    n, k, m = F.col("toxic") + F.col("other"), F.col("toxic"), F.col("other")
    ratio = k * F.log(k / (n * rate)) + F.when(m > 0, m * F.log(m / (n * (1 - rate)))).otherwise(0)
    good = counted.where((F.col("term") != "") & (n >= LEAST_ROWS) & (k > 0) & (k >= LEAST_PRECISION * n) & (ratio > math.log(tried) + MARGIN))
    fixed = [(w, c) for c, ws in (("I", INSULTS), ("H", THREATS)) for w in ws]
    alike = lambda t: next((c for w, c in fixed if (w == t[:-1] if t.endswith("$") else w.startswith(t))), None)
    return {r.term: alike(r.term) or ("H" if r.behind > r.before else "I") for r in good.select("term", "behind", "before").collect()}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a ridge on the weights."""
    full = np.c_[x, np.ones(len(x))]
    w, pull = np.zeros(full.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        hessian = full.T @ (full * (p * (1 - p) + 1e-6)[:, None]) + np.diag(pull)
        step = np.linalg.solve(hessian, full.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learns terms and weights on at most `sample` labelled rows that are not held out; only text and label are read.

    Without labelled rows the grammar's own weights decide.
    """
    rows = stored(sampled_texts(docs, labels, label_col, id_col, text_col, sample).select("text", "value"))
    model = ToxicityModel(learn_terms(rows), np.r_[np.zeros(len(OUTPUTS)), 3.0], -1.5)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(list(x), pa.list_(pa.float64()))], names=["value", "x"])

    found = sorted((r.value, tuple(r.x)) for r in rows.mapInArrow(featurise, "value int, x array<double>").collect())
    y = np.array([v for v, _ in found], float)
    if 0 < y.sum() < len(y):
        model.weights, model.bias = fit_weights(np.array([x for _, x in found]), y)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Per document: id_col, held_out, score (0 to 1), predicted (1 from 0.5 on), n_heads (insults and threats that matched).

    A clause, cut at sentence and line ends, is read as word classes by the composed transducers; a document's features are
    how often heads were plain, targeted, negated or reported, and the clauses' weights.

    Defined cases: a text without a head, null and empty ones too, has the score of the bias alone; very long texts are read
    whole, clause by clause; rows that are repeated are scored alike; terms that are learned alike often are all learned; an empty
    table gives an empty result; other columns are ignored. Labels of null value are not learned.
    """
    model = train_toxicity(docs, labels, id_col, text_col, label_col, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column("_text"), model)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
            heads = np.rint(np.expm1(x[:, :-1]).sum(axis=1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(heads)], names=["_id", "score", "predicted", "n_heads"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    scored = rows.mapInArrow(score, "_id long, score double, predicted int, n_heads long")
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", "predicted", "n_heads")
