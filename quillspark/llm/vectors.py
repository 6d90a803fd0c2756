"""Vectors of an Arrow column as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width_of(df: DataFrame, vector: Column) -> int:
    """The length that most vectors have, the larger one of two; 0 where there is none. Vectors of other lengths can't be compared with them."""
    found = df.select(F.size(vector).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()  # one row
    return found[0].n if found else 0


def usable(vectors: pa.Array, width: int, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold `width` numbers that are finite and below `most` in size, and these rows as doubles."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    fits = (lengths == width) & (width > 0)
    flat = vectors.filter(pa.array(fits)).flatten()
    values = pc.fill_null(pc.cast(flat, pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, max(width, 1))
    good = np.isfinite(values).all(axis=1) & (np.abs(np.nan_to_num(values)) < most).all(axis=1)
    fits[np.flatnonzero(fits)[~good]] = False
    return fits, values[good]
