"""What the vector operators share: which rows take part, numpy views of Arrow vectors, exact sums of whole numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 60


def finite(vector: str | Column) -> Column:
    """The vector is not null, not empty, and holds neither nulls nor NaN or infinity."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~odd, F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int:
    """The commonest length of a vector, the larger of two as common; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow column of vectors of d numbers, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def limbs(sums: Iterable[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(key, whole number of any size) -> rows (key, limb, value), a number being the sum of value * 2^(60 limb)."""
    keys, places, values = [], [], []
    for key, x in sums:
        place = 0
        while True:
            low = x if -(1 << 62) < x < 1 << 62 else x & ((1 << LIMB) - 1)
            keys.append(key), places.append(place), values.append(low)
            if low == x:
                break
            x, place = x >> LIMB, place + 1
    yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "limb": pa.array(places, pa.int32()), "value": pa.array(values, pa.int64())})


def summed(parts: DataFrame) -> dict[int, int]:
    """Exact sums by key of what `limbs` gave; as many rows come to the driver as there are keys and limbs."""
    out: dict[int, int] = {}
    for key, limb, value in parts.groupBy("key", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        out[key] = out.get(key, 0) + (int(value) << (LIMB * limb))
    return out
