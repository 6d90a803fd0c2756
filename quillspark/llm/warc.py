"""WARC archives with an index, and reading selected records by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import shared_dir, stored
from quillspark.llm.token_files import _filesystem

#: A payload of fewer bytes is always stored.
LEAST_REVISIT = 1000
#: Ranges of one file that are less than GAP bytes apart are read together, up to READ bytes at once.
GAP, READ = 64 << 10, 8 << 20
#: Bytes of records that one task reads, where files are larger.
PART = 128 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset long, length long, url string, digest string, page_id long"


def _line(value: str | None) -> str:
    """A header value in one line: what could end it is percent-coded."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _record(page_id: int | None, url: str | None, body: bytes, sha1: bytes, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
        body = b""
    raw = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(raw) + coder.flush()


class _Archive:
    """An archive of this very attempt, open once a record comes: the index lists the files of attempts that Spark took, whatever others have left behind."""

    def __init__(self, folder: str):
        self.fs, self.top = _filesystem(folder)
        self.name, self.out, self.size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0
        self.path = f"{folder}/{self.name}"

    def add(self, raw: bytes) -> int:
        """Writes a record and returns its offset."""
        if self.out is None:
            self.fs.create_dir(self.top, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.top}/.{self.name}", compression=None)
        self.out.write(raw)
        self.size += len(raw)
        return self.size - len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.top}/.{self.name}", f"{self.top}/{self.name}")


_KINDS = {"path": pa.string(), "offset": pa.int64(), "length": pa.int64(), "url": pa.string(), "digest": pa.string(), "page_id": pa.int64(), "size": pa.int64()}


def _listed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for c, n in zip(cols, names, strict=True)], names=names)


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a WARC record per page and returns the index: path, offset, length, url, digest (hex SHA-1), page_id.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, that with the largest id is a response, the others are
    revisits that refer to it. Equality is that of SHA-1 and length. Each task first writes its pages as responses, into a draft; then
    index rows, which hold no payload, are grouped and joined by digest, and dealt by file: each draft is copied record by record, bytes
    as they are, with revisits in the place of the responses that turned out to be copies. So payloads are never shuffled, however
    many are repeated, and one that is hot costs a row per task.

    Defined cases: null html is an empty payload; null url is an empty URI; line breaks in a URL are percent-coded; a page id
    that is repeated with the same payload keeps one response per row of the largest id; a null id is written with an empty
    id and never referred to unless all of the group are null; ids are whole numbers; an empty table writes nothing; columns not named
    are ignored.
    """
    folder = folder or shared_dir(pages.sparkSession) + "-warc"
    draft = f"{folder}-draft-{uuid.uuid4().hex}"
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(draft)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                body = r["html"].encode()
                sha1 = hashlib.sha1(body)
                raw = _record(r["page_id"], r["url"], body, sha1.digest(), len(body), None, False)
                found.append((archive.path, archive.add(raw), len(raw), r["url"], sha1.hexdigest(), r["page_id"], len(body)))
            yield _listed(found, list(_KINDS))
        archive.close()

    first = stored(rows.mapInArrow(write, f"{INDEX}, size long"))
    same = first.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = first.join(same, ["digest", "size"], "left").withColumn("revisit", F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, names = _Archive(folder), list(_KINDS)[:-1]
        for batch in batches:
            by_path: dict[str, dict[tuple[int, int], dict]] = {}
            for r in batch.to_pylist():
                by_path.setdefault(r["path"], {})[r["offset"], r["length"]] = r
            for path, own in by_path.items():
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as source:
                    for lo, hi, held in ranges([k for k, r in sorted(own.items()) if not r["revisit"]]):
                        block, found = source.read_at(hi - lo, lo), []
                        for offset, length in held:
                            r = own[offset, length]
                            found.append((archive.path, archive.add(block[offset - lo : offset - lo + length]), length, r["url"], r["digest"], r["page_id"]))
                        yield _listed(found, names)
                found = []
                for r in own.values():
                    if r["revisit"]:
                        raw = _record(r["page_id"], r["url"], b"", bytes.fromhex(r["digest"]), r["size"], r["kept"], True)
                        found.append((archive.path, archive.add(raw), len(raw), r["url"], r["digest"], r["page_id"]))
                yield _listed(found, names)
        archive.close()

    out = stored(_dealt(marked.select(*_KINDS, "kept", "revisit")).mapInArrow(copy, INDEX))
    spark = pages.sparkSession
    gone = spark._jvm.org.apache.hadoop.fs.Path(draft)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return out


def _dealt(index: DataFrame) -> DataFrame:
    """Index rows by file and offset, about a task per file, or per PART bytes of larger ones; a number that is not coalesced, and no keys are sampled for ranges."""
    held = index.agg(F.countDistinct("path").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return index.repartition(max(held.files, -(-held.bytes // PART), 1), "path", F.floor(F.col("offset") / PART)).sortWithinPartitions("path", "offset")


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def ranges(records: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(from, to, records) of coalesced reads; records are (offset, length) in ascending order."""
    lo, hi, held = 0, 0, []
    for offset, length in records:
        if held and (offset - hi > GAP or offset + length - lo > READ):
            yield lo, hi, held
            held = []
        lo, hi = (lo if held else offset), max(hi if held else 0, offset + length)
        held.append((offset, length))
    if held:
        yield lo, hi, held


def read_warc(selected: DataFrame) -> DataFrame:
    """Reads the records that an index selects: path, offset, page_id, url, record_type, refers_to, payload, digest, payload_bytes.

    Index rows are dealt and sorted by file and offset; each task coalesces neighbouring ranges into reads of at most READ bytes (one
    longer record is read alone). payload is null for a revisit, digest and payload_bytes are those of the full payload and
    checked against the bytes of a response.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_path: dict[str, list[tuple[int, int]]] = {}
            for p, o, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                by_path.setdefault(p, []).append((o, n))
            for path, found in by_path.items():
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as source:
                    for lo, hi, held in ranges(sorted(found)):
                        block, out = source.read_at(hi - lo, lo), []
                        for offset, length in held:
                            h, body = _parse(block[offset - lo : offset - lo + length])
                            revisit, digest = h["WARC-Type"] == "revisit", base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                            if not revisit and hashlib.sha1(body).hexdigest() != digest:
                                raise ValueError(f"damaged record at {offset} of {path}")
                            uri = h["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                            out.append({"path": path, "offset": offset, "page_id": int(h["X-Page-Id"]) if h["X-Page-Id"] else None, "url": uri, "record_type": h["WARC-Type"], "refers_to": int(h["X-Refers-To-Page-Id"]) if revisit else None, "payload": None if revisit else body.decode(), "digest": digest, "payload_bytes": int(h["X-Payload-Length"])})
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64())])
    chosen = _dealt(selected.select("path", "offset", "length"))
    return chosen.mapInArrow(read, "path string, offset long, page_id long, url string, record_type string, refers_to long, payload string, digest string, payload_bytes long")
