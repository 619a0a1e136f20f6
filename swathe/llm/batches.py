"""Arrow batches of rows that are sorted by a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a batch stream sorted by ``key``.

    A table ends with a group, once it has ``rows`` rows; only the rows of the
    last, unfinished group are carried on.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        end = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] <= keys[-1] else 0
        if end:
            yield table.slice(0, end)
        held = table.slice(end).to_batches()
        n = sum(map(len, held))
    if n:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def by_group(df: DataFrame, key: str, work: Callable[[pa.Table], pa.RecordBatch], schema: str, rows: int = 4096) -> DataFrame:
    """``work`` over tables of whole groups of the long column ``key``.

    The caller bounds the size of a group. One shuffle; every task sorts its
    rows and streams them, so many small groups cost no call each.
    """

    def run(batches):
        for table in whole_groups(batches, key, rows):
            yield work(table)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)
