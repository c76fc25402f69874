"""Streaming forms, run over what is there and read back; each equals its batch form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.plans.registry import Tables, query, micros
from auralake.streaming import incremental


def _folder(t: Tables) -> str:
    """A new folder that all executors share."""
    root = t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="auralake-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _events(t: Tables) -> DataFrame:
    return incremental.read_growing(t.spark, f"{t.folder}/events*.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _settle(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    root = _folder(t)
    incremental.commit_batches(stream, f"{root}/progress", incremental.append_once(f"{root}/rows"), mode).awaitTermination()
    return t.spark.read.parquet(f"{root}/rows")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'error' GROUP BY user_id")
def st1_st2_st3_committed_batches(t: Tables) -> DataFrame:
    """Bounded batches committed one by one; the sums of what they hold."""
    kept = _settle(t, _events(t).where("event_type <> 'error'").select("user_id", "value"), "append")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, count(*) AS n, round(sum(pow(0.7::DOUBLE, age) * CASE WHEN age = n - 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * value), 6) AS ewma FROM a GROUP BY user_id""")
def st4_running_means(t: Tables) -> DataFrame:
    found = _settle(t, incremental.running_means(_events(t), "user_id", ["ts", "event_id"], "value"), "update")
    return found.groupBy(F.col("key").alias("user_id")).agg(F.max("n").alias("n"), F.round(F.max_by("ewma", "n"), 6).alias("ewma"))


@query()
def st4_limiter_states(t: Tables) -> DataFrame:
    hits = _events(t).withColumn("hit", F.col("event_type") == "error")
    found = _settle(t, incremental.limiter_states(hits, "user_id", ["ts", "event_id"], "hit", recover_after=2), "update")
    return found.select(F.col("key").alias("user_id"), "slots", "successes", "backoff", "throttles")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_windowed_counts(t: Tables) -> DataFrame:
    found = _settle(t, incremental.windowed_counts(_events(t), "ts", "1 hour", "1 hour", "event_type"), "update")
    return found.groupBy(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.max("n").alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, user_id, max(ts) AS at FROM events GROUP BY ALL")
def st5_latest_urls(t: Tables) -> DataFrame:
    urls = _events(t).withColumn("url", F.col("ts").cast("string")).withColumn("expires", F.col("ts"))
    found = _settle(t, incremental.latest_urls(urls, "user_id", "url", "ts", "expires"), "update")
    return found.groupBy(F.col("window.start").cast("timestamp_ntz").alias("hour"), "user_id").agg(F.max("expires").cast("timestamp_ntz").alias("at"))


@query("SELECT event_type AS status, count(*) AS n, round(sum(value), 4) AS elapsed FROM events GROUP BY event_type")
def s13_st6_event_log(t: Tables) -> DataFrame:
    """The run log written as JSON lines and read back as a stream."""
    from auralake.sources import tables

    root = _folder(t)
    tables.write_log(t.events.select(micros().alias("ts"), F.col("event_type").alias("status"), F.col("value").alias("elapsed_s")), f"{root}/log")
    kept = _settle(t, tables.read_log(t.spark, f"{root}/log", stream=True).select("status", "elapsed_s"), "append")
    return kept.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("elapsed_s"), 4).alias("elapsed"))
