"""Ordered and window-like operators: peaks, lags, smoothing, folds, order statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auralake.operators.lineage import cut, partitions

DECAY = 0.08
#: 0.7 ** 2200 is zero in double precision, so older values have no weight.
EWMA_REACH = 2200


def decayed_peaks(df: DataFrame, keys: list[str], frame: str, value: str, decay: float = DECAY) -> DataFrame:
    """Rows at or above a threshold that each peak lifts to itself and every frame lowers by ``decay``.

    Closed form of the fold: raise each value by decay x frame, and a row is a
    peak if it reaches the running maximum of all before it.
    """
    lifted = F.col(value) + F.lit(decay) * F.col(frame)
    before = F.max(lifted).over(W.partitionBy(*keys).orderBy(frame).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (lifted >= F.col("_before"))).drop("_before")


def loudest(df: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """The place of the largest value of each key; the first on ties."""
    return df.groupBy(*keys).agg(F.max_by(place, F.struct(F.col(value), -F.col(place))).alias(place), F.max(value).alias(value))


def fan_out(peaks: DataFrame, keys: list[str], frame: str, order: str, value: str, targets: int = 4, reach: int = 63, bands: int = 6) -> DataFrame:
    """Each peak with the next ``targets`` whose frame distance is 1 to ``reach``; (keys, anchor_frame, anchor, target, delta).

    A frame holds at most one peak a band, so what follows within ``bands - 1 + targets`` rows is enough.
    """
    ahead = W.partitionBy(*keys).orderBy(frame, order).rowsBetween(1, bands - 1 + targets)
    later = F.collect_list(F.struct(F.col(frame).alias("frame"), F.col(value).alias("value"))).over(ahead)
    delta = lambda x: x["frame"] - F.col(frame)
    near = F.slice(F.filter("_later", lambda x: (delta(x) >= 1) & (delta(x) <= reach)), 1, targets)
    met = peaks.withColumn("_later", later).withColumn("_near", F.explode(near))
    return met.select(*keys, F.col(frame).alias("anchor_frame"), F.col(value).alias("anchor"), F.col("_near.value").alias("target"), (F.col("_near.frame") - F.col(frame)).alias("delta"))


def rising(df: DataFrame, keys: list[str], frame: str, value: str, lag: int = 4) -> DataFrame:
    """Whether a value exceeds the one ``lag`` frames back; rows without one are left out."""
    back = F.lag(value, lag).over(W.partitionBy(*keys).orderBy(frame))
    return df.withColumn("rising", F.col(value) - back > 0).where("rising is not null")


def flux(df: DataFrame, keys: list[str], frame: str, bin_: str, value: str) -> DataFrame:
    """Sum over bins of the rise since the frame before; (keys, frame, flux)."""
    back = F.lag(value, 1).over(W.partitionBy(*keys, bin_).orderBy(frame))
    return df.withColumn("_rise", F.when(back.isNotNull(), F.greatest(F.col(value) - back, F.lit(0.0)))).where("_rise is not null").groupBy(*keys, frame).agg(F.sum("_rise").alias("flux"))


def autocorrelation(df: DataFrame, keys: list[str], frame: str, value: str, first: int, last: int) -> DataFrame:
    """(keys, lag, score): mean product of centred values ``lag`` frames apart.

    A row meets those that follow at its lags in one sorted pass over its key; no side is broadcast or copied by lag.
    """
    own = W.partitionBy(*keys)
    known = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    wave = known.select(*keys, F.col(frame).cast("long").alias("f"), (F.col(value) - F.avg(value).over(own)).alias("x")).where("f is not null")
    later = F.collect_list(F.struct("f", "x")).over(own.orderBy("f").rangeBetween(first, last))
    met = wave.withColumn("_later", later).select(*keys, "f", "x", F.explode("_later").alias("_y"))
    return met.groupBy(*keys, (F.col("_y.f") - F.col("f")).alias("lag")).agg(F.avg(F.col("x") * F.col("_y.x")).alias("score"))


def frames(samples: Column, size: int, hop: int) -> Column:
    """Whole frames of an array."""
    n = F.floor((F.size(samples) - size) / hop).cast("int")
    starts = F.when(F.size(samples) >= size, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(samples, i * hop + 1, size))


def padded_segments(samples: Column, size: int, hop: int) -> Column:
    """Segments that cover an array, the last one filled with zeros; one at least."""
    more = F.ceil(F.greatest(F.size(samples) - size, F.lit(0)) / hop).cast("int")
    whole = F.concat(samples, F.array_repeat(F.lit(0.0), more * hop + size))
    return F.transform(F.sequence(F.lit(0), more), lambda i: F.slice(whole, i * hop + 1, size))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float = 0.7) -> DataFrame:
    """Exponentially weighted mean seeded by the first value, as a weighted sum.

    A row's weight falls by ``keep`` with each later row; rows whose weight is
    zero in double precision are left out, so a hot key is cut before its shuffle.
    """
    newest = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    aged = df.withColumn("_age", F.row_number().over(newest) - 1).where(F.col("_age") < EWMA_REACH).join(counted, keys)
    weight = F.pow(F.lit(keep), F.col("_age")) * F.when(F.col("_age") == F.col("_n") - 1, 1.0).otherwise(1.0 - keep)
    return aged.groupBy(*keys).agg(F.sum(weight * F.col(value)).alias("ewma"))


def throughput(df: DataFrame, keys: list[str], order: list[str], seconds: str, last: int = 50) -> DataFrame:
    """Completions a second over the ``last`` ones up to each row; null for one alone or no time."""
    recent = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - last, 0)
    span = F.max(seconds).over(recent) - F.min(seconds).over(recent)
    return df.withColumn("rate", F.when(span > 0, (F.count("*").over(recent) - 1) / span))


def smooth_votes(votes: DataFrame, keys: list[str], place: str, count: str) -> DataFrame:
    """Votes of each place with both neighbours; (keys, place) of the best, the smallest place on ties."""
    near = W.partitionBy(*keys).orderBy(place).rangeBetween(-1, 1)
    return votes.withColumn("_sum", F.sum(count).over(near)).groupBy(*keys).agg(F.max_by(place, F.struct(F.col("_sum"), -F.col(place))).alias(place), F.max("_sum").alias("votes"))


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """A state machine per key, run in order; one output row per input row.

    Rows are dealt by key and sorted within partitions, and a task streams
    through them with the state of one key at a time, so no group is gathered.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                row = dict(zip(names, row, strict=True))
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, start()
                out.append(step(state, row))
            yield pd.DataFrame(out)

    return df.repartition(partitions(df), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


LIMITER = "key long, event_id long, slots int, successes int, backoff double, throttles int"


def limiter(df: DataFrame, key: str, order: list[str], throttled: str, ceiling: int = 8, floor: int = 2, recover_after: int = 12) -> DataFrame:
    """Concurrency after each outcome: halved by a throttle, one slot more after enough successes.

    The jitter of the cool-down is the caller's: 0.75 to 1.25 times ``backoff``.
    """

    def start() -> dict:
        return {"slots": ceiling, "successes": 0, "backoff": 0.0, "throttles": 0}

    def step(s: dict, row: dict) -> dict:
        advance(s, bool(row["throttled"]), ceiling, floor, recover_after)
        return {"key": row["key"], "event_id": row["event_id"], **s}

    narrow = df.select(F.col(key).alias("key"), *order, F.col(throttled).alias("throttled"))
    return fold(narrow, ["key"], order, start, step, LIMITER)


def advance(s: dict, throttled: bool, ceiling: int, floor: int, recover_after: int) -> None:
    """One transition of the limiter's state."""
    if throttled:
        s.update(throttles=s["throttles"] + 1, successes=0, slots=max(floor, s["slots"] // 2), backoff=min(60.0, 2 * s["backoff"] or 5.0))
        return
    s.update(successes=s["successes"] + 1, backoff=0.0)
    if s["successes"] >= recover_after and s["slots"] < ceiling:
        s.update(slots=s["slots"] + 1, successes=0)


def order_statistics(df: DataFrame, value: str, places: dict[str, Callable[[int], int]]) -> DataFrame:
    """(name, value) at zero-based places of the sorted values, each a function of their number.

    Values are counted (partially, so ties cost nothing), dealt by range and
    summed up within ranges; only the totals of the ranges reach the driver.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranged = cut(counted.repartitionByRange(partitions(df), value).withColumn("part", F.spark_partition_id()))
    totals = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in totals)
    if not total:
        return df.sparkSession.createDataFrame([], df.select(F.lit("").alias("name"), value).schema)
    wanted = []
    for name, place in places.items():
        left = place(total)
        for part, n in totals:
            if left < n:
                wanted.append((name, part, left))
                break
            left -= n
    asked = df.sparkSession.createDataFrame(wanted, "name string, part int, at long")
    upto = F.sum("n").over(W.partitionBy("part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto)
    return placed.join(F.broadcast(asked), "part").where("at < upto and at >= upto - n").select("name", value)
