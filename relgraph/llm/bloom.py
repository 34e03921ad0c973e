"""A Bloom filter of bounded size, to thin out rows before a join that decides exactly.

It has no false negatives, so a semi-join after it gives what the semi-join alone would; only
fewer rows are shuffled. Its bits are counted out to the number of keys, up to a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

BITS_PER_KEY, HASHES = 16, 4
#: 8 MB: the most that is ever sent to the driver and to the workers.
MOST_BITS = 1 << 26


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers for each key (a long), by double hashing."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    y = x * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
    y ^= y >> np.uint64(29)
    return np.stack([(x + np.uint64(i) * y) % np.uint64(bits) for i in range(HASHES)])


def maybe_in(keys: DataFrame) -> callable:
    """From a table of one long column, a function from a long Column to whether its value may be among them."""
    keys = keys.toDF("k").filter("k is not null")
    n = keys.count()
    bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (BITS_PER_KEY * n).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in batches:
            own[places(b.column(0).to_numpy(), bits).ravel()] = True
        words = np.packbits(own, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["w", "v"])

    rows = keys.mapInArrow(fill, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    words = np.zeros(bits // 64, "<i8")
    words[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(T.BooleanType())
    def may(k: pd.Series) -> pd.Series:
        at = places(k.to_numpy(np.int64), bits).astype(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).all(0))

    def test(c: Column) -> Column:
        return F.when(c.isNotNull(), may(F.coalesce(c, F.lit(0)))).otherwise(False)

    return test
