"""Quality classifier: ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Words, text_chunks
from quillspark.llm.labels import SAMPLE, held_out, sampled_texts

#: Places of hashed features, in powers of two.
BITS = 14
ROUNDS, RATE, RIDGE = 200, 0.5, 1e-4
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND = np.full(256, 3)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 0


def token_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashed features per word: the word itself, and its shape with whether the word before is the same."""
    upper, symbol = (np.r_[0, np.cumsum(table[w.buf])] for table in (_UPPER, _SYMBOL))
    length = w.end - w.start
    marks = np.minimum(symbol[w.end] - symbol[w.start], 4)
    loud = (upper[w.end] - upper[w.start]) * 2 > length
    again = np.zeros(len(w.hash), np.int64)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[:-1][w.first[:-1] < len(again)]] = 0
    shape = ((((_KIND[w.buf[w.start]] * 4 + _KIND[w.buf[w.end - 1]]) * 5 + marks) * 2 + loud) * 2 + again) * 4 + np.minimum(length // 4, 3)
    places = 1 << BITS
    return (w.hash % np.uint64(places // 2)).astype(np.int64), places // 2 + (shape * 2654435761 % (places // 2))


@dataclass
class OrdinalModel:
    """P(grade <= grades[k]) = sigmoid(thresholds[k] - eta) with one eta per text: the mean of its features' weights."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - eta[:, None], -40, 40)))
        return np.diff(np.c_[np.zeros(len(eta)), below, np.ones(len(eta))], axis=1)


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], places: int = 1 << BITS, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> OrdinalModel:
    """Maximum likelihood by adaptive gradient steps; rows are (grade, features, shares). Thresholds stay ordered, as their distances are exponentials."""
    grades = sorted({g for g, _, _ in rows}) or [0]
    if len(grades) == 1:
        return OrdinalModel(grades, np.zeros(places), np.zeros(0))
    y = np.searchsorted(grades, [g for g, _, _ in rows])
    doc = np.repeat(np.arange(len(rows)), [len(f) for _, f, _ in rows])
    place, share = np.concatenate([f for _, f, _ in rows]), np.concatenate([s for _, _, s in rows])
    k = len(grades) - 1
    share_below = np.clip(np.array([(y <= i).mean() for i in range(k)]), 1e-3, 1 - 1e-3)
    cuts = np.log(share_below / (1 - share_below))
    raw = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))]
    w, seen, seen_raw = np.zeros(places), np.full(places, 1e-8), np.full(k, 1e-8)
    for _ in range(rounds):
        cuts = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        eta = np.bincount(doc, share * w[place], len(rows))
        padded = np.r_[-np.inf, cuts, np.inf]
        up, low = (1 / (1 + np.exp(-np.clip(padded[y + d] - eta, -40, 40))) for d in (1, 0))
        p = np.maximum(up - low, 1e-12)
        # -d log p / d eta, and / d cut
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_eta = (du - dl) / len(rows)
        g_cut = np.array([(-du[y == i]).sum() + dl[y == i + 1].sum() for i in range(k)]) / len(rows)
        g_w = np.bincount(place, share * g_eta[doc], places) + ridge * w / len(rows)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_raw = np.r_[tail[0], tail[1:] * np.exp(raw[1:])]
        seen, seen_raw = seen + g_w**2, seen_raw + g_raw**2
        w, raw = w - rate * 4 * g_w / np.sqrt(seen), raw - rate * g_raw / np.sqrt(seen_raw)
    return OrdinalModel(grades, w, np.cumsum(np.r_[raw[0], np.exp(raw[1:])]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, shares = [], []
        for lo, hi, w in text_chunks(batch.column("text"), lower=False):
            both = token_features(w)
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                found, n = np.unique(np.concatenate([f[a:b] for f in both]), return_counts=True)
                places.append(found.astype(np.int32).tobytes())
                shares.append((n / max(b - a, 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("value"), pa.array(places, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "value", "places", "shares"])


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample: int = SAMPLE) -> OrdinalModel:
    """Fits the model on a sample of at most `sample` labelled rows that are not held out; grades may be any ordered integers."""
    rows = sampled_texts(docs, labels, grade_col, id_col, text_col, sample).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = rows.mapInArrow(_featurise, "doc_id long, value int, places binary, shares binary").collect()
    rows = sorted(found, key=lambda r: (r.doc_id, r.value, r.places))
    return fit_ordinal([(r.value, np.frombuffer(r.places, np.int32), np.frombuffer(r.shares, np.float32)) for r in rows])


def score_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cutoff: int | None = None) -> DataFrame:
    """Per document: row (a struct of its columns), expected_grade and tail_probability, that of `cutoff` (by default the second lowest grade) or better.

    Defined cases: a text without words, null and empty ones too, has the lowest grade and tail probability 0; with fewer than
    two grades to learn from, every text with words has that grade, and tail probability 1; an empty table gives an empty
    result; other columns stay in the struct, so that no name of theirs can clash.
    """
    at = next((i for i, g in enumerate(model.grades) if g >= cutoff), len(model.grades)) if cutoff is not None else min(1, len(model.grades) - 1)
    grades = np.array(model.grades, float)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = [np.zeros(0)], [np.zeros(0)]
            for lo, hi, w in text_chunks(pc.struct_field(batch.column("row"), text_col), lower=False):
                n = np.diff(w.first)
                doc = np.repeat(np.arange(hi - lo), n)
                word, shape = token_features(w)
                eta = np.bincount(doc, model.weights[word] + model.weights[shape], hi - lo) / np.maximum(n, 1)
                p = model.probabilities(eta)
                expected.append(np.where(n > 0, p @ grades, grades[0]))
                tail.append(np.where(n > 0, p[:, at:].sum(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(expected)), pa.array(np.concatenate(tail))], names=["row", "expected_grade", "tail_probability"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def rate_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """Per document: id_col, held_out, expected_grade, tail_probability, kept (tail_probability >= least). See score_quality."""
    model = train_quality(docs, labels, id_col, text_col, grade_col, sample)
    scored = score_quality(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), model)
    return scored.select(F.col("row.id").alias(id_col), held_out(F.col("row.id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("kept"))
