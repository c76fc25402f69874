"""Schemas of the catalogue's tables, and typed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "tracks": "id string, sourceTrackId string, source string, title string, artist string, album string, durationMs long, streamUri string, localFilePath string",
    "fingerprints": "hash int, trackId string, anchorFrame int",
    "track_features": "trackId string, tempo double, energy double, brightness double, danceability double, keyX double, keyY double, version int, measuredAt long",
    "recording_fingerprints": "trackId string, subHashes binary, durationMs long, computedAt long",
    "recording_sub_hashes": "half int, trackId string",
    "track_embeddings": "trackId string, vector binary, dim int, model string, version int, computedAt long",
    "recording_links": "idA string, idB string, similarity double, linkedAt long",
    "track_lyrics": "trackId string, plainLyrics string, syncedLyrics string, source string, syncedAt long",
}
LOG = "ts double, event string, track string, source string, label string, status string, reason string, elapsed_s double, samples long, landmarks long, bpm int, energy int, key string"


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The JSON-lines run log, at rest or as it grows; lines that aren't JSON are rows of nulls."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG).option("mode", "PERMISSIVE").json(path)


def write_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """A similarity matrix as CSV with its names as header."""
    df.write.option("header", True).csv(path)
