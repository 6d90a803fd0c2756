"""Token ids in Arrow files of equal-length sequences."""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import shared_dir, stored

SEQUENCE = 2048
#: Sequences in a record batch of a file.
BATCH = 256
#: Parts and pieces whose ids a worker keeps; the frequent ones come early. Only speed depends on it.
CACHE = 150_000
#: Texts that are encoded together, for a bound on memory.
CHUNK = 1000
#: White space in Unicode: texts in which a blank has another beside it are encoded whole, see Encoder.
_GAP = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Bytes that a byte-level vocabulary writes as themselves; the others are moved up from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _letters() -> dict[int, str]:
    moved = (256 + i for i in range(256))
    return {b: chr(b) if b in set(_PRINTED) else chr(next(moved)) for b in range(256)}


class Encoder:
    """Ids of many texts by the tokenizers library, each distinct piece encoded once.

    A byte-level BPE encodes every piece of its published split pattern on its own. A blank between two other characters
    always begins a piece, so an Arrow column is cut there and only distinct parts are looked at further. Texts in which a
    blank stands next to other white space, and parts that hold a special token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _letters()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.blank = self.letters[32]
        #: Whether no special string can be in a word of letters behind a blank.
        self.apart = all(s.strip(" ") and not s.strip(" ").isalpha() for s in self.special)
        #: Ids of parts and of pieces: a piece that is a part of its own is the same string with the same ids.
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():  # letters stand for themselves
            coded = self.blank + piece[1:] if piece[0] == " " else piece.translate(self.letters)
        else:
            coded = piece.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.tokenize(coded)]).tobytes()
        if len(self.known) < CACHE:
            self.known[piece] = ids
        return ids

    def part(self, part: str) -> bytes:
        rest = part[1:]
        one = part[:1] == " " and rest.isalpha()  # one piece
        if one and self.apart and rest.isascii():
            ids = array(self.code, [t.id for t in self.tokenize(self.blank + rest)]).tobytes()
            if len(self.known) < CACHE:
                self.known[part] = ids
            return ids
        for s in self.special:
            if s in part:
                return self.whole(part).tobytes()
        if one:
            return self.piece(part)
        known, new = self.known.get, self.piece
        ids = b"".join([known(p) or new(p) for p in self.pattern.findall(part)])
        if len(self.known) < CACHE // 3:  # most are rare, as with a full stop at the end; their pieces are not
            self.known[part] = ids
        return ids

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's ids."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, f"(?: {_GAP})|(?:{_GAP} )|\\x{{fffd}}").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        parts = pc.split_pattern(plain, " ")
        first = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat = parts.flatten()
        lead = np.zeros(len(flat), bool)
        lead[first[:-1]] = True
        coded = flat.dictionary_encode()
        index, blank = coded.indices.to_numpy().copy(), pa.scalar(" ", pa.large_string())
        words = pc.binary_join_element_wise(blank, coded.dictionary, pa.scalar("", pa.large_string())).to_numpy(zero_copy_only=False).tolist()
        # a part that leads its text has no blank before it
        lead_of = {int(i): len(words) + k for k, i in enumerate(np.unique(index[lead]))}
        index[lead] = [lead_of[int(i)] for i in index[lead]]
        have, new = self.known.get, self.part
        known = [have(w) or new(w) for w in words] + [have(w) or new(w) for w in [words[i][1:] for i in lead_of]]
        pool = np.frombuffer(b"".join(known), self.kind)
        length = np.fromiter(map(len, known), np.int32, len(known)) // self.kind.itemsize
        at = np.cumsum(length, dtype=np.int32) - length
        n = length[index]
        ends = np.cumsum(n, dtype=np.int32)
        ids = pool[np.repeat(at[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        total = np.r_[0, ends]
        counts = total[first[1:]] - total[first[:-1]]
        if odd.any():
            begin = np.r_[0, np.cumsum(counts)]
            pieces = [self.whole(texts[i].as_py()) if odd[i] else ids[begin[i] : begin[i + 1]] for i in range(len(texts))]
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, counts


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def file_schema(sequence: int, wide: bool) -> pa.Schema:
    """ids; mask: true where an id stands, false in the padding of a file's last sequence; ends: true at a document's last id."""
    bits = pa.list_(pa.bool_(), sequence)
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), sequence)), ("mask", bits), ("ends", bits)])


class _Writer:
    """Packs ids into fixed-size-list batches of one Arrow file; the file appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str, sequence: int, wide: bool):
        self.fs, top = _filesystem(folder)
        self.fs.create_dir(top, recursive=True)
        self.final, self.temp = f"{top}/{name}", f"{top}/.{name}-{uuid.uuid4().hex}"
        self.sequence, self.kind = sequence, np.uint32 if wide else np.uint16
        self.schema = file_schema(sequence, wide)
        self.out = pa.ipc.new_file(self.fs.open_output_stream(self.temp), self.schema)
        self.ids, self.ends, self.held = [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids.astype(self.kind))
        self.ends.append(ends)
        self.held += len(ids)
        if self.held >= self.sequence * BATCH:
            self._flush(self.held // self.sequence * self.sequence)

    def _flush(self, most: int, pad: int = 0) -> None:
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        rest, rest_ends = ids[most:], ends[most:]
        ids, ends = np.r_[ids[:most], np.zeros(pad, self.kind)], np.r_[ends[:most], np.zeros(pad, bool)]
        mask = np.ones(most + pad, bool)
        mask[most:] = False
        step = self.sequence * BATCH
        for i in range(0, len(ids), step):
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[i : i + step]), self.sequence) for x in (ids, mask, ends)]
            self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.ids, self.ends, self.held = [rest], [rest_ends], len(rest)

    def close(self) -> None:
        if self.held:
            self._flush(self.held, -self.held % self.sequence)
        self.out.close()
        self.fs.move(self.temp, self.final)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """Encodes every text, appends end_id, and writes the ids in ascending order of id_col as Arrow files under `folder`.

    A range of ids makes one file (part-NNNNN.arrow) of record batches with fixed-size lists: `ids`, `mask`, `ends`. Every
    sequence has the same length, so sequence k of a memory-mapped file is a slice, without a copy or a decode. Only a
    file's last sequence is padded (mask false). Returns the files' index, one row per document in file order:
    part, id_col, place (in the part), path. The index is what reading needs besides the files.

    Defined cases: null text counts as empty and gives end_id alone; equal ids keep every row, ordered by text; null ids come
    first; an empty table gives no file; columns not named are ignored. A task that is run again writes the same file anew.
    """
    folder = folder or shared_dir(docs.sparkSession) + "-tokens"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    ranged = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, encoder, place = TaskContext.get().partitionId(), None, _encoder(tokenizer_path), 0
        wide = encoder.tokenizer.get_vocab_size() > 65536 or end_id > 65535
        path = f"{folder}/part-{part:05d}.arrow"
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                ids, counts = encoder.column(batch.column("_text").slice(at, CHUNK))
                last = np.cumsum(counts + 1) - 1
                full, ends = np.full(len(ids) + len(counts), end_id, np.uint32 if wide else np.uint16), np.zeros(len(ids) + len(counts), bool)
                ends[last] = True
                full[~ends] = ids
                writer = writer or _Writer(folder, f"part-{part:05d}.arrow", sequence, wide)
                writer.add(full, ends)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), batch.column("_id"), pa.array(range(place, place + n), pa.int64()), pa.array([path] * n, pa.string())], names=["part", "id", "place", "path"])
            place += n
        if writer:
            writer.close()

    return ranged.mapInArrow(write, "part int, id long, place long, path string").withColumnRenamed("id", id_col)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read_sequences(path: str, first: int, count: int) -> Iterator[tuple[np.ndarray, pa.FixedSizeListArray]]:
    """ids and mask of sequences first .. first + count - 1 of a local file, a pair per record batch.

    Both are views of the mapped file, nothing is copied or decoded: ids an array of numbers, the mask an Arrow array, as its
    flags are single bits.
    """
    with pa.memory_map(path.removeprefix("file://")) as source:
        reader = pa.ipc.open_file(source)
        size = reader.get_batch(0).num_rows
        for k in range(first // size, (first + count - 1) // size + 1):
            batch = reader.get_batch(k)
            lo, hi = max(first - k * size, 0), min(first + count - k * size, batch.num_rows)
            ids, mask = (batch.column(name).slice(lo, hi - lo) for name in ("ids", "mask"))
            yield ids.flatten().to_numpy(zero_copy_only=True).reshape(hi - lo, -1), mask


def read_token_files(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id_col, start (ids of all documents before it), n_tokens, ids_crc32.

    One task reads a file, batch by batch; a document that crosses batches is summed up as it comes. Files of earlier ranges
    shift a file's starts by their sums, one row per file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as source:
                    reader, count, crc, place, start = pa.ipc.open_file(source), 0, 0, 0, 0
                    for k in range(reader.num_record_batches):
                        piece = reader.get_batch(k)
                        ids, mask, ends = (piece.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "mask", "ends"))
                        ids = ids[mask].astype("<u4")
                        stops = np.flatnonzero(ends[mask]) + 1
                        out, lo = [], 0
                        for hi in stops.tolist():
                            crc, count = zlib.crc32(ids[lo:hi], crc), count + hi - lo
                            out.append((place, start, count, crc))
                            place, start, count, crc, lo = place + 1, start + count, 0, 0, hi
                        crc, count = zlib.crc32(ids[lo:], crc), count + len(ids) - lo
                        if out:
                            cols = list(zip(*out, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), *[pa.array(c, pa.int64()) for c in cols]], names=["part", "place", "start", "n_tokens", "ids_crc32"])

    files = index.select("part", "path").distinct()
    # about one file a task: as many tasks as files, a number that is not coalesced
    found = stored(files.repartition(max(files.count(), 1)).mapInArrow(read, "part int, place long, start long, n_tokens long, ids_crc32 long"))
    shift = found.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    shift = shift.select("part", F.coalesce(F.sum("_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    # merged, not broadcast: the index compresses so well as Parquet that its file size says little about its rows
    return found.join(index.select("part", "place", id_col).hint("merge"), ["part", "place"]).join(shift, "part").select(id_col, (F.col("start") + F.col("_shift")).alias("start"), "n_tokens", "ids_crc32")
