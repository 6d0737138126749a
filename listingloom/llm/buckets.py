"""Keys of many rows dealt into buckets as packed arrays, so that a shuffle moves arrays and not single keys."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Keys that a task gathers before it hands them on.
GATHERED = 1 << 20


def count(spark: SparkSession) -> int:
    """Buckets for a shuffle: some per partition, so that they even out. The submitter sizes partitions by the input."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(keys: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket that has any: its number, and its part of the columns. The keys are hashes."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        yield int(b), [c[at] for c in columns]


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The arrays of many rows as one."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
