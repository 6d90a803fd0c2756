"""Pieces that several training-data operators share: stored intermediate tables and word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. Where that is unset, a folder of this machine does in local mode only (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor then costs no recomputation, and the planner knows the table's real size.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame | None) -> None:
    """Deletes the folders of stored tables that nothing lazy is made of any more: what came of them has been stored itself."""
    for df in tables:
        files = df.inputFiles() if df is not None else []
        if files:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def swept(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of what is stored by now, which else waits until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, null as empty. lower() does the same on pure ASCII, where it is much faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- words of a whole Arrow column at once -------------------------------------------------------

#: Bytes of text whose words are hashed at once.
MOST = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), so that all bits of a sum of hashes spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _MULT and of _INV. Those of chunks of the usual size are kept; a longer text has its own."""
    if n <= len(_POWERS[0]):
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_MULT, _INV):
        x = np.full(max(n, MOST + 1), base, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, out=x))
    if n <= MOST + 1:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


class Words:
    """Words of several texts: `hash` per word, `start`/`end` bytes in `buf`, and words of text i at first[i]:first[i + 1]."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf = buf
        text = ~_SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)  # a word starts here, if the byte is part of a word
        edge[bounds] = True
        begins = text.copy()
        begins[1:] &= ~text[:-1] | edge[1:-1]
        ends = text.copy()
        ends[:-1] &= ~text[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        power, back = _powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))


def text_chunks(texts: pa.Array, lower: bool = True, most: int = MOST) -> Iterator[tuple[int, int, Words]]:
    """Runs of texts of about `most` bytes together: (from, to, words). A null text has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        part = data[off[i] : off[j]]
        yield i, j, Words(_LOWER[part] if lower else part, off[i : j + 1] - off[i])
        i = j


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end of the last."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, len(sorted_values)]
