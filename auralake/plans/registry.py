"""Registration of queries, and the views of the test tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators import recording, vectors
from auralake.operators.lineage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def micros(column: str = "ts") -> Column:
    """Epoch microseconds; the events' times have no zone and are taken as UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


class Tables:
    """The test tables by name, and what stands in for the catalogue's tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def tracks(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("id"),
            F.col("doc_id").cast("string").alias("source_track_id"),
            F.expr("CASE lang WHEN 'en' THEN 'NAVIDROME' WHEN 'de' THEN 'YTMUSIC' WHEN 'fr' THEN 'youtube' END").alias("source"),
            F.col("text").alias("title"),
            F.col("source").alias("artist"),
            F.col("n_chars").alias("duration_ms"),
            F.expr("CASE WHEN doc_id % 7 = 0 THEN '/data/files/' || doc_id || '.opus' END").alias("local_file_path"),
            F.expr("CASE WHEN doc_id % 3 = 0 THEN 'http://s.example/' || doc_id END").alias("stream_uri"),
        )

    @property
    def texts(self) -> DataFrame:
        """Documents for kernels that cost more than a shuffle of the texts."""
        return spread(self.documents.select("doc_id", "text"))

    @property
    def recordings(self) -> DataFrame:
        """One 32-bit word per token of a document."""
        return recording.token_words(self.texts.withColumnRenamed("doc_id", "id"), "id", "text")

    @property
    def asked_recordings(self) -> DataFrame:
        """The recordings whose id is divisible by 50."""
        return recording.token_words(self.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("id"), "text"), "id", "text")

    @property
    def features(self) -> DataFrame:
        """Six features of each part, by arithmetic on its key."""
        return self.part.selectExpr(
            "p_partkey AS id",
            "p_brand AS artist",
            "p_name AS title",
            "(p_partkey * 37 % 101) / 100.0D AS tempo",
            "(p_partkey * 7919 % 1000) / 1000.0D AS energy",
            "(p_partkey * 271 % 503) / 503.0D AS brightness",
            "(p_partkey * 1013 % 997) / 997.0D AS danceability",
            "(p_partkey * 31 % 200 - 100) / 100.0D AS key_x",
            "(p_partkey * 17 % 200 - 100) / 100.0D AS key_y",
        )

    @property
    def segments(self) -> DataFrame:
        return self.embeddings.selectExpr("vec_id div 5 AS track", "vec_id % 5 AS seg", "embedding", "label")

    @property
    def vector_tracks(self) -> DataFrame:
        return vectors.gather(self.segments, "track", "seg", "embedding")

    @property
    def peaks(self) -> DataFrame:
        """The largest value of each user, hour and event type."""
        hour = F.floor((F.floor(micros() / 1000000) - 1704067200) / 3600).cast("int")
        band = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")
        return self.events.select(F.col("user_id").alias("id"), hour.alias("frame"), band.alias("band"), "value").groupBy("id", "frame", "band").agg(F.max("value").alias("mag"))


TRACKS = """tracks AS (
  SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS source_track_id,
    CASE lang WHEN 'en' THEN 'NAVIDROME' WHEN 'de' THEN 'YTMUSIC' WHEN 'fr' THEN 'youtube' END AS source,
    text AS title, d.source AS artist, n_chars AS duration_ms,
    CASE WHEN doc_id % 7 = 0 THEN '/data/files/' || doc_id || '.opus' END AS local_file_path,
    CASE WHEN doc_id % 3 = 0 THEN 'http://s.example/' || doc_id END AS stream_uri
  FROM documents d)"""
RECORDINGS = r"""recordings AS (
  SELECT doc_id AS id, list_transform(list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda w: w <> ''),
    lambda w: CAST('0x' || substring(md5(w), 1, 8) AS BIGINT)) AS words FROM documents)"""
FEATURES = """features AS (
  SELECT p_partkey AS id, p_brand AS artist, p_name AS title, (p_partkey * 37 % 101) / 100.0::DOUBLE AS tempo,
    (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS energy, (p_partkey * 271 % 503) / 503.0::DOUBLE AS brightness,
    (p_partkey * 1013 % 997) / 997.0::DOUBLE AS danceability, (p_partkey * 31 % 200 - 100) / 100.0::DOUBLE AS key_x,
    (p_partkey * 17 % 200 - 100) / 100.0::DOUBLE AS key_y FROM part)"""
SEGMENTS = """segments AS (
  SELECT vec_id // 5 AS track, vec_id % 5 AS seg, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""
MAXSIM = """best AS (
  SELECT a.track AS query, b.track, a.seg, max(list_dot_product(a.v, b.v)) AS m FROM segments a, segments b
  WHERE a.track % 50 = 0 GROUP BY a.track, b.track, a.seg),
scored AS (SELECT query, track, avg(m) AS score FROM best GROUP BY query, track)"""
PEAKS = """peaks AS (
  SELECT user_id AS id, CAST((epoch_us(ts) // 1000000 - 1704067200) // 3600 AS INTEGER) AS frame,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS band,
    max(value) AS mag FROM events GROUP BY ALL)"""
DISTANCE = """sqrt(1.6 * (a.tempo - b.tempo) * (a.tempo - b.tempo) + 1.3 * (a.energy - b.energy) * (a.energy - b.energy)
  + 0.8 * (a.brightness - b.brightness) * (a.brightness - b.brightness) + 1.0 * (a.danceability - b.danceability) * (a.danceability - b.danceability)
  + 0.6 * ((a.key_x - b.key_x) * (a.key_x - b.key_x) + (a.key_y - b.key_y) * (a.key_y - b.key_y)))"""


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with its SQL if there is one."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
