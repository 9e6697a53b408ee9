"""Sums of numpy arrays over the Arrow blocks of a table: the step that gradient, Newton and histogram jobs share.

Each task adds up what a function makes of its blocks and gives one row. With many tasks these rows are added in
groups first, so that neither one task nor the driver sees a row per task of a large table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

# Rows of partial sums that the driver adds; more are added in groups of about the same number.
FAN = 64
_SCHEMA = "slot int, task int, total binary"


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a list column of one width as a matrix."""
    return np.asarray(lists.flatten(), dtype=float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores: a small table out of one file would keep one busy in every pass."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def block_sum(df: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], size: int, fan: int = FAN) -> np.ndarray:
    """The sum of `block(batch)`, a vector of `size` numbers, over all batches of `df`. Zeros for an empty table.

    Partial sums are added in the order of the tasks, so equal partitions give equal bits.
    """
    slots = math.ceil(df.rdd.getNumPartitions() / fan)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, TaskContext.get().partitionId()
        for batch in stream:
            if batch.num_rows:
                part = block(batch)
                total = part if total is None else total + part
        if total is not None:
            yield _row(task % slots, task, total)

    sums = df.mapInArrow(run, _SCHEMA)
    while slots > 1:
        slots = math.ceil(slots / fan)
        sums = sums.groupBy("slot").applyInArrow(_adder(slots), _SCHEMA)
    total = np.zeros(size)
    for row in sorted(sums.collect(), key=lambda r: r["task"]):
        total = total + np.frombuffer(row["total"])
    return total


def _row(slot: int, task: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([task], pa.int32()), pa.array([np.asarray(total, float).tobytes()])],
                                      ["slot", "task", "total"])


def _adder(slots: int) -> Callable[[pa.Table], pa.Table]:
    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = sum(np.frombuffer(t.as_py()) for t in rows.column("total"))
        return pa.Table.from_batches([_row(rows.column("slot")[0].as_py() % slots, rows.column("task")[0].as_py(), total)])

    return add
