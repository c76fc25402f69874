"""Lineage cuts and Arrow plumbing that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it has more than one in so many rows, so no table has more hot keys than this.
HOT_KEYS = 4096
#: Partitions of fewer rows aren't worth a file of their own, where the number of rows is known.
FILE_ROWS = 8192


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there.

    The folder is the cluster's ``spark.checkpoint.dir``. Where neither that
    setting nor a checkpoint folder exists, a local session gets a temporary one;
    on a cluster, whose nodes don't share one, this raises. Of at most ``rows`` narrow
    rows it writes no more files than they need; without that bound one a partition.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="auralake-"))
    return (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).checkpoint(eager=True)


def join_unique(many: DataFrame, one: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``many`` inner-joined to ``one``, which has each key once and in ``weight`` its rows among the ``total`` of ``many``.

    Hot keys, ``HOT_KEYS`` at most, are broadcast to where their rows lie; the
    others are shuffled. Null keys match nothing. ``weight`` is dropped.
    """
    hot = F.col(weight) * HOT_KEYS > total
    few, rest = F.broadcast(one.where(hot).drop(weight)), one.where(~hot).drop(weight)
    return many.join(few, on).unionByName(many.join(few.select(*on), on, "left_anti").join(rest, on))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([c for c in df.columns if c.lower() not in taken])


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """Add ``fields``, computed batch by batch; a column of the same name is replaced.

    ``compute`` is called once per task and returns the function of a batch.
    """
    kept = without(df, *[f.name for f in fields])
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = compute()
        for whole in batches:
            for batch in pieces(whole):
                arrays = [batch.column(i) for i in range(batch.num_columns)]
                added = of(batch)
                yield pa.RecordBatch.from_arrays([*arrays[: len(names)], *added], names=[*names, *[f.name for f in fields]])
        give_back()

    return kept.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system; Python workers stay alive between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def pieces(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most_bytes`` each, one row at least."""
    if batch.num_rows == 0:
        return
    parts = min(batch.num_rows, -(-batch.nbytes // most_bytes) or 1)
    step = -(-batch.num_rows // parts)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
