"""Reliable lineage cuts for the iterative operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read from there.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a local session gets
    a temporary one; on a cluster, whose nodes don't share one, this raises.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="auralake-"))
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores where the input has fewer splits than there are cores.

    For kernels that cost more than the shuffle of their input; inputs of many splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to two tasks a core at least, which adaptive execution doesn't join."""
    return df.repartition(max(partitions(df), 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def pieces(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most_bytes`` each, one row at least."""
    if batch.num_rows:
        step = max(1, batch.num_rows * most_bytes // max(batch.nbytes, most_bytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def array_pieces(columns: tuple[pa.Array, ...], most_bytes: int = 4 << 20) -> Iterator[tuple[pa.Array, ...]]:
    """``pieces`` of columns of one length; a UDF over batches may return its results in smaller ones."""
    n = len(columns[0])
    step = max(1, n * most_bytes // max(sum(c.nbytes for c in columns), most_bytes))
    for at in range(0, n, step):
        yield tuple(c.slice(at, step) for c in columns)


def list_array(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A list column of numpy rows; None is null."""
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    values = np.concatenate([r for r in rows if r is not None and len(r)] or [np.zeros(0, np.int64)])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([r is None for r in rows] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def list_rows(column: pa.Array) -> list[np.ndarray | None]:
    """The rows of a list column without copies; null stays."""
    values, offsets, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [values[offsets[i] : offsets[i + 1]] if valid[i] else None for i in range(len(column))]
