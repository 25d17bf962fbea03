"""Count vectors of fixed length: one a partition, merged in a tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Partitions whose vectors meet in one task of the tree.
FAN_IN = 16


def partition_vectors(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], length: int) -> DataFrame:
    """(v binary): a vector of ``length`` 64-bit counts for each partition of ``df``; ``add``
    adds a batch to it.  Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype="<i8")
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return df.mapInArrow(run, "v binary")


def merge(vectors: DataFrame, length: int) -> np.ndarray:
    """Their sum.  ``treeReduce`` adds them in executors; about ``FAN_IN`` of them reach the
    driver, however many partitions there are.  No vectors at all add to zeros."""
    sc = vectors.sparkSession.sparkContext
    found = vectors.rdd.map(lambda row: np.frombuffer(row[0], dtype="<i8"))
    parts = sc.union([found, sc.parallelize([np.zeros(length, dtype="<i8")], 1)])
    depth = max(2, math.ceil(math.log(parts.getNumPartitions(), FAN_IN)))
    return parts.treeReduce(lambda a, b: a + b, depth)
