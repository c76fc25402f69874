"""Micro-batches with idempotent commits, and per-key state that survives restarts.

Offsets, state and sink share no memory with the driver: a query that is
restarted from its checkpoint goes on where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auralake.operators.ordered import advance


def read_growing(spark: SparkSession, path: str, schema, files_per_batch: int = 25, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as they come, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def commit_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append"):
    """Run ``write(batch, number)`` for what is there and stop; a batch that is repeated has the same number."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(root: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a repeated batch overwrites itself: one folder per batch number."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/batch={n}")


def running_means(stream: DataFrame, key: str, order: list[str], value: str, keep: float = 0.7) -> DataFrame:
    """(key, n, ewma) after each batch: the weighted mean that the first value seeds."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        for x in rows["value"]:
            mean = float(x) if n == 0 else keep * mean + (1 - keep) * float(x)
            n += 1
        state.update((n, mean))
        yield pd.DataFrame({"key": [name[0]], "n": [n], "ewma": [mean]})

    narrow = stream.select(F.col(key).alias("key"), *order, F.col(value).alias("value"))
    return narrow.groupBy("key").applyInPandasWithState(step, "key long, n long, ewma double", "n long, ewma double", "update", GroupStateTimeout.NoTimeout)


def limiter_states(stream: DataFrame, key: str, order: list[str], throttled: str, ceiling: int = 8, floor: int = 2, recover_after: int = 12) -> DataFrame:
    """(key, slots, successes, backoff, throttles) after each batch."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields = ("slots", "successes", "backoff", "throttles")
        now = dict(zip(fields, state.get if state.exists else (ceiling, 0, 0.0, 0), strict=True))
        for hit in pd.concat(list(batches)).sort_values(order)["throttled"]:
            advance(now, bool(hit), ceiling, floor, recover_after)
        state.update(tuple(now[f] for f in fields))
        yield pd.DataFrame({"key": [name[0]], **{f: [now[f]] for f in fields}})

    narrow = stream.select(F.col(key).alias("key"), *order, F.col(throttled).alias("throttled"))
    kinds = "slots int, successes int, backoff double, throttles int"
    return narrow.groupBy("key").applyInPandasWithState(step, f"key long, {kinds}", kinds, "update", GroupStateTimeout.NoTimeout)


def latest_urls(stream: DataFrame, key: str, url: str, at: str, expires: str, margin: str = "600 seconds") -> DataFrame:
    """The newest URL of each key; state older than the margin behind the watermark is dropped."""
    return stream.withWatermark(at, margin).groupBy(F.window(at, "1 hour"), key).agg(F.max_by(url, at).alias(url), F.max_by(expires, at).alias(expires))


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts by event time; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
