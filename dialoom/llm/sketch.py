"""Sketches of counts: summed in tasks, slice by slice, and read as one array.

A task counts into an array of fixed size and gives its slices as compressed
blocks. Blocks of one slice are added up in one stream, so no task holds more
than the sums of its slices and one batch, and the driver reads each slice once,
whatever the number of rows and tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Counters of a slice, and streams that add slices up.
SLICE, STREAMS = 4096, 32
SCHEMA = "slice int, block binary"


def blocks(counts: np.ndarray) -> pd.DataFrame:
    """The slices of an array of counts that hold any."""
    parts = counts.reshape(-1, SLICE)
    at = np.flatnonzero(parts.any(axis=1))
    return pd.DataFrame({"slice": at.astype(np.int32), "block": [zlib.compress(parts[i].astype(np.int64).tobytes(), 1) for i in at]})


def total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the blocks of all tasks, an array of `size` counts."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, block in zip(pdf["slice"], pdf["block"]):
                found = np.frombuffer(zlib.decompress(block), np.int64)
                sums[i] = sums[i] + found if i in sums else found
        if sums:
            yield pd.DataFrame({"slice": list(sums), "block": [zlib.compress(a.tobytes(), 1) for a in sums.values()]})

    out = np.zeros(size, np.int64)
    for row in parts.select("slice", "block").repartition(STREAMS, "slice").mapInPandas(add, SCHEMA).collect():
        out[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(zlib.decompress(row.block), np.int64)
    return out
