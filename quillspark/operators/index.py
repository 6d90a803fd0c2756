"""The retrieval index: postings made in a document's own row, kept in segments with tombstones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.sources.files import stored

# What a field's words weigh in BM25 (title, tags, category, body).
BM25_WEIGHTS = {"A": 5.0, "B": 1.0, "C": 1.0, "D": 1.0}
#: A row per word and document: how often, how often by field weights, words of the document, first place, places by field.
POSTINGS = "term string, doc_id long, tf long, wtf double, len long, first int, fields array<struct<field: string, positions: array<int>>>"
#: A row per document with words: how many, a hash of its text, how often words of each hash place occur.
DOCUMENTS = "doc_id long, len long, text_md5 string, embedding array<double>"
#: A row per word: documents, and what bounds its part in any document's score: the largest weight, and the largest share of a document.
VOCABULARY = "term string, df long, top double, dense double"
#: A row per document with all that is said of it: postings as lists of the same length, one word after the other.
WHOLE = "doc_id long, len long, text_md5 string, embedding array<double>, term array<string>, tf array<long>, wtf array<double>, first array<int>, fields array<array<struct<field: string, positions: array<int>>>>"
#: Words that are grouped at once.
WORDS = 1 << 20


@dataclass
class Index:
    """What all retrieval starts from. See POSTINGS, DOCUMENTS and VOCABULARY; whole, where it is stored, has a document in one row (WHOLE)."""

    postings: DataFrame
    documents: DataFrame
    vocabulary: DataFrame
    whole: DataFrame | None = None

    @classmethod
    def of_whole(cls, whole: DataFrame, vocabulary: DataFrame) -> Index:
        return cls(_inlined(whole, ["term", "doc_id", "tf", "wtf", "len", "first", "fields"]), whole.select("doc_id", "len", "text_md5", "embedding"), vocabulary, whole)

    def rows(self, *columns: str) -> DataFrame:
        """These columns of the postings alone, so that no others are read."""
        return self.postings.select(*columns) if self.whole is None else _inlined(self.whole, columns)

    def of_pairs(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """(query_id, ...) with these columns of the postings of the documents of pairs (query_id, doc_id), which are stored, so that few are known to be few."""
        pairs = stored(pairs, "pairs")
        if self.whole is None:
            return pairs.join(self.postings.select(*{*columns, "doc_id"}), "doc_id").select("query_id", *columns)
        return _inlined(self.whole.select("doc_id", *[c for c in columns if c != "doc_id"]).join(pairs, "doc_id"), ["query_id", *columns])

    @property
    def by_field(self) -> DataFrame:
        """(term, doc_id, field, positions), a row per field."""
        return self.rows("term", "doc_id", "fields").select("term", "doc_id", F.inline("fields"))

    @property
    def in_fields(self) -> DataFrame:
        """(term, doc_id, field) without places, which are not read then."""
        return self.rows("term", "doc_id", "fields").select("term", "doc_id", F.explode("fields.field").alias("field"))


def _inlined(whole: DataFrame, columns: list[str]) -> DataFrame:
    lists = [c for c in columns if c in ("term", "tf", "wtf", "first", "fields")]
    rows = whole.select(*[c for c in columns if c not in lists], F.explode(F.arrays_zip(*lists)).alias("_p"))
    return rows.select(*[F.col("_p")[c].alias(c) if c in lists else F.col(c) for c in columns])


def hash_place(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


def _rows(ids: np.ndarray, hashes: pa.Array, words: pa.Array, ends: np.ndarray, weights: dict[str, float], dim: int) -> Iterator[pa.RecordBatch]:
    """Postings and document rows of some documents: words laid out field after field, ends of fields by document."""
    lengths = ends[:, -1].astype(np.int64)
    coded = words.dictionary_encode()
    code, n_terms = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    starts = np.r_[0, np.cumsum(lengths)]
    doc = np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(code)) - starts[doc] + 1
    field = (place[:, None] > ends[doc]).sum(axis=1)
    order = np.argsort(doc * n_terms + code, kind="stable")  # places stay in order, and so fields
    key, place, field = (doc * n_terms + code)[order], place[order].astype(np.int32), field[order]
    run = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    part = run | np.r_[True, field[1:] != field[:-1]] if len(key) else run
    at, parts = np.flatnonzero(run), np.flatnonzero(part)
    names, weight = pa.array(list(weights), pa.string()), np.array(list(weights.values()))
    own = key[at] // n_terms
    inner = pa.ListArray.from_arrays(np.r_[parts, len(key)].astype(np.int32), pa.array(place))
    structs = pa.StructArray.from_arrays([names.take(pa.array(field[parts])), inner], names=["field", "positions"])
    n = len(at)
    none = lambda kind, size: pa.nulls(size, kind)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(["postings"] * n, pa.string()), coded.dictionary.take(pa.array(key[at] % n_terms)) if n else none(pa.string(), 0), pa.array(ids[own]), pa.array(np.diff(np.r_[at, len(key)])), pa.array(np.add.reduceat(weight[field], at) if n else np.zeros(0)),
            pa.array(lengths[own]), pa.array(place[at]), pa.ListArray.from_arrays(np.r_[np.searchsorted(parts, at), len(parts)].astype(np.int32), structs), none(pa.string(), n), none(pa.list_(pa.float64()), n),
        ], names=_NAMES,
    )
    places = np.array([hash_place(t, dim) for t in coded.dictionary.to_pylist()] or [0])
    vectors = np.bincount(doc * dim + places[code], minlength=len(ids) * dim).astype(float) if len(code) else np.zeros(len(ids) * dim)
    some = np.flatnonzero(lengths > 0)
    n = len(some)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(["documents"] * n, pa.string()), none(pa.string(), n), pa.array(ids[some]), none(pa.int64(), n), none(pa.float64(), n), pa.array(lengths[some]), none(pa.int32(), n), none(pa.list_(structs.type), n),
            hashes.take(pa.array(some)), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, vectors.reshape(-1, dim)[some].ravel()),
        ], names=_NAMES,
    )


_NAMES = ["kind", "term", "doc_id", "tf", "wtf", "len", "first", "fields", "text_md5", "embedding"]
_SCHEMA = "kind string, term string, doc_id long, tf long, wtf double, len long, first int, fields array<struct<field: string, positions: array<int>>>, text_md5 string, embedding array<double>"


def index_rows(docs: DataFrame, id_col: str, text_col: str, fields: dict[str, Column], weights: dict[str, float] = BM25_WEIGHTS, dim: int = 32) -> DataFrame:
    """Postings and documents as rows of one table, by kind. A document's words are grouped where the document is: nothing is shuffled, and no word is a row of its own.

    Words of fields are laid out one after the other, so places go on from field to field. Null ids are left out, as are documents without
    words.
    """
    held = [F.coalesce(X.tokens(F.lower(c)), F.array().cast("array<string>")) for c in fields.values()]
    sizes = [reduce(lambda a, b: a + b, [F.size(h) for h in held[: i + 1]]) for i in range(len(held))]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text_col).alias("text_md5"), F.concat(*held).alias("words"), F.array(*sizes).alias("ends"))
    own = {f: weights.get(f, 0.0) for f in fields}

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("ends").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(own))
            total, at = np.cumsum(ends[:, -1], dtype=np.int64), 0
            while at < batch.num_rows:  # some documents, or a long one
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WORDS, "right")))
                part = batch.slice(at, to - at)
                yield from _rows(part.column("doc_id").to_numpy(), part.column("text_md5"), part.column("words").flatten(), ends[at:to], own, dim)
                at = to

    return rows.mapInArrow(group, _SCHEMA)


def _whole(ids: np.ndarray, lengths: np.ndarray, hashes: pa.Array, doc: np.ndarray, place: np.ndarray, field: np.ndarray, words: pa.Array, weights: dict[str, float], dim: int) -> pa.RecordBatch:
    """Rows of some documents. doc, place and field are those of words; a document's words stand in the order of their places."""
    coded = words.dictionary_encode()
    code, n_terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    key = doc * n_terms + code
    order = np.argsort(key, kind="stable")
    key, place, field = key[order], place[order].astype(np.int32), field[order]
    run = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    part = run | np.r_[True, field[1:] != field[:-1]] if len(key) else run
    at, parts = np.flatnonzero(run), np.flatnonzero(part)
    own, weight, n = key[at] // n_terms, np.array(list(weights.values())), len(at)
    inner = pa.ListArray.from_arrays(np.r_[parts, len(key)].astype(np.int32), pa.array(place))
    structs = pa.StructArray.from_arrays([pa.array(list(weights), pa.string()).take(pa.array(field[parts])), inner], names=["field", "positions"])
    fields = pa.ListArray.from_arrays(np.r_[np.searchsorted(parts, at), len(parts)].astype(np.int32), structs)
    some = np.flatnonzero(lengths > 0)
    listed = lambda values: pa.ListArray.from_arrays(np.r_[np.searchsorted(own, some), n].astype(np.int32), values)
    places = np.array([hash_place(t, dim) for t in coded.dictionary.to_pylist()] or [0])
    vectors = np.bincount(doc * dim + places[code], minlength=len(ids) * dim).astype(float)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[some]), pa.array(lengths[some]), hashes.take(pa.array(some)), pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * dim, vectors.reshape(-1, dim)[some].ravel()),
            listed(coded.dictionary.take(pa.array(key[at] % n_terms))), listed(pa.array(np.diff(np.r_[at, len(key)]))), listed(pa.array(np.add.reduceat(weight[field], at) if n else np.zeros(0))), listed(pa.array(place[at])), listed(fields),
        ], names=["doc_id", "len", "text_md5", "embedding", "term", "tf", "wtf", "first", "fields"],
    )


def whole_rows(docs: DataFrame, id_col: str, text_col: str, fields: dict[str, Column], weights: dict[str, float] = BM25_WEIGHTS, dim: int = 32) -> DataFrame:
    """The rows of index_rows with a document in one row (WHOLE), so that what is stored needs no sort, and what is asked of a document is answered where it is.

    Words come as text with single blanks between them and are split in Arrow.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), X.BREAKS, " "))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text_col).alias("text_md5"), *[flat(c).alias(f"_{f}") for f, c in fields.items()])
    own = {f: weights.get(f, 0.0) for f in fields}

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for f in own:
                text = batch.column(f"_{f}")
                split = pc.split_pattern(text, " ")
                held.append(pc.if_else(pc.equal(text, ""), pa.scalar([], split.type), split))
            counts = np.stack([pc.list_value_length(h).to_numpy(zero_copy_only=False).astype(np.int64) for h in held], axis=1)
            total, at = np.cumsum(counts.sum(axis=1)), 0
            while at < batch.num_rows:  # some documents, or a long one
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WORDS, "right")))
                n, n_docs = counts[at:to], to - at
                before = np.cumsum(n, axis=1) - n
                doc = np.concatenate([np.repeat(np.arange(n_docs), n[:, i]) for i in range(len(own))])
                place = np.concatenate([np.arange(n[:, i].sum()) + np.repeat(before[:, i] - np.cumsum(n[:, i]) + n[:, i], n[:, i]) + 1 for i in range(len(own))])
                field = np.repeat(np.arange(len(own)), n.sum(axis=0))
                words = pa.concat_arrays([h.slice(at, n_docs).flatten() for h in held])
                yield _whole(batch.column("doc_id").to_numpy()[at:to], n.sum(axis=1), batch.column("text_md5").slice(at, n_docs), doc, place, field, words, own, dim)
                at = to

    return rows.mapInArrow(group, WHOLE)


def vocabulary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.max("wtf").alias("top"), F.max(F.col("wtf") / F.col("len")).alias("dense"))


class SegmentedIndex:
    """An index in a folder, changed by adding segments.

    `add` writes new and changed documents as a segment, and for each of their ids a tombstone: what older segments say of it is dead.
    `delete` writes tombstones alone. Each change is a commit: its files first, its number in `commits` last, so one that breaks
    off is never seen, and its number is used again. Counts of documents by word are kept per commit, less those of the rows that it
    kills, so nothing is counted anew. `compact` writes what is alive as one segment. A document that is twice in one call counts once
    (the row with the greatest text).
    """

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", dim: int = 32):
        self.spark, self.path, self.fields, self.id_col, self.text_col, self.dim = spark, path.rstrip("/"), fields, id_col, text_col, dim

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def commits(self) -> list[tuple[int, int, str]]:
        """(number, first segment that counts, what it wrote) in order; a row per change."""
        return sorted((r.number, r.since, r.wrote) for r in self._read("commits", "number int, since int, wrote string").collect())

    def _commit(self, number: int, since: int, wrote: str) -> None:
        self.spark.createDataFrame([(number, since, wrote)], "number int, since int, wrote string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _state(self) -> tuple[int, int]:
        done = self.commits()
        return done[-1][:2] if done else (0, 1)

    def _alive(self, kind: str, schema: str, last: int, since: int) -> DataFrame:
        rows = [self.spark.read.schema(schema).parquet(f"{self.path}/segment-{n}/kind={kind}").withColumn("segment", F.lit(n)) for n in self._segments(last, since)]
        if not rows:
            return self.spark.createDataFrame([], schema)
        dead = self._tombstones(last, since)
        every = reduce(DataFrame.unionByName, rows)
        names = every.columns
        kept = every.join(dead.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & (F.col("segment") < F.col("at")), "left_anti")
        return kept.select(*[n for n in names if n != "segment"])

    def _segments(self, last: int, since: int) -> list[int]:
        return [n for n, _, wrote in self.commits() if since <= n <= last and "own" in wrote]

    def _tombstones(self, last: int, since: int) -> DataFrame:
        """(doc_id, at): the last commit that a document was changed or deleted in."""
        rows = self._read("tombstones", "doc_id long, at int").where(F.col("at").between(since, last))
        return rows.groupBy("doc_id").agg(F.max("at").alias("at"))

    def _lose(self, ids: DataFrame, number: int, last: int, since: int) -> None:
        """Writes tombstones, and how many documents each word loses by them."""
        ids.write.mode("overwrite").parquet(f"{self.path}/tombstones/at={number}")
        dead = self._alive("postings", "term string, doc_id long", last, since).join(ids, "doc_id", "left_semi")
        lost = dead.groupBy("term").agg((-F.count("*")).alias("df"), F.lit(0.0).alias("top"), F.lit(0.0).alias("dense"))
        lost.write.mode("overwrite").parquet(f"{self.path}/words-{number}/lost")

    def add(self, docs: DataFrame) -> None:
        """Inserts documents, and replaces those that are there."""
        last, since = self._state()
        number = last + 1
        once = docs.withColumn("_n", F.row_number().over(W.partitionBy(self.id_col).orderBy(F.col(self.text_col).desc_nulls_last()))).where("_n = 1").drop("_n")
        index_rows(once, self.id_col, self.text_col, self.fields, dim=self.dim).write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/segment-{number}")
        self._lose(once.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).cast("long").alias("doc_id")), number, last, since)
        if self._has(f"segment-{number}/kind=postings"):
            vocabulary_of(self.spark.read.schema(POSTINGS).parquet(f"{self.path}/segment-{number}/kind=postings")).write.mode("overwrite").parquet(f"{self.path}/words-{number}/own")
            self._commit(number, since, "own lost")
        else:
            self._commit(number, since, "lost")

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (a column doc_id) out; ids that are not there change nothing."""
        last, since = self._state()
        self._lose(ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct(), last + 1, last, since)
        self._commit(last + 1, since, "lost")

    def compact(self) -> None:
        """Writes what is alive as one segment; older ones are not read any more."""
        last, since = self._state()
        number = last + 1
        out = f"{self.path}/segment-{number}"
        self._alive("postings", POSTINGS, last, since).write.mode("overwrite").parquet(f"{out}/kind=postings")
        self._alive("documents", DOCUMENTS, last, since).write.mode("overwrite").parquet(f"{out}/kind=documents")
        vocabulary_of(self.spark.read.schema(POSTINGS).parquet(f"{out}/kind=postings")).write.mode("overwrite").parquet(f"{self.path}/words-{number}/own")
        self._commit(number, number, "own")

    def _has(self, name: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(conf).exists(folder)

    def read(self) -> Index:
        """The index of all documents that are alive. Bounds of words may be those of documents that are gone, which makes them no less bounds."""
        last, since = self._state()
        words = [self.spark.read.schema(VOCABULARY).parquet(f"{self.path}/words-{n}/{kind}") for n, _, wrote in self.commits() if since <= n <= last for kind in wrote.split()]
        every = reduce(DataFrame.unionByName, words) if words else self.spark.createDataFrame([], VOCABULARY)
        vocabulary = every.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"), F.max("dense").alias("dense")).where("df > 0")
        return Index(self._alive("postings", POSTINGS, last, since), self._alive("documents", DOCUMENTS, last, since), vocabulary)


__all__ = ["BM25_WEIGHTS", "DOCUMENTS", "POSTINGS", "VOCABULARY", "WHOLE", "Index", "SegmentedIndex", "hash_place", "index_rows", "vocabulary_of", "whole_rows"]
