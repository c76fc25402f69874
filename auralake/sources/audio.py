"""Raw audio blobs to samples, with a reason for what fails."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.operators.lineage import array_pieces, list_array, list_rows

RATE, SECONDS = 8000, 60
DECODED = T.StructType([T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("reason", T.StringType())])


def samples_of(blob: bytes | None, rate: int = RATE, seconds: int = SECONDS) -> tuple[np.ndarray, str]:
    """Mono samples of a WAV file or of raw little-endian floats, whole floats only, the first ``seconds``."""
    if blob is None:
        return np.empty(0, np.float32), "MISSING"
    if not blob:
        return np.empty(0, np.float32), "EMPTY"
    if blob[:4] == b"RIFF":
        try:
            with wave.open(io.BytesIO(blob)) as file:
                width, channels, found = file.getsampwidth(), file.getnchannels(), file.getframerate()
                data = file.readframes(file.getnframes())
            if width != 2:
                return np.empty(0, np.float32), "FAILED"
            x = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(axis=1) / 32768
            if found != rate and len(x):
                x = np.interp(np.arange(int(len(x) * rate / found)) * found / rate, np.arange(len(x)), x)
        except (wave.Error, EOFError, ValueError, ZeroDivisionError):
            return np.empty(0, np.float32), "FAILED"
    else:
        x = np.frombuffer(blob[: len(blob) // 4 * 4], "<f4")
    x = x[: rate * seconds].astype(np.float32)
    return x, "OK" if len(x) else "EMPTY"


@F.arrow_udf(DECODED)
def _decode(blobs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in blobs:
        for (part,) in array_pieces((batch,)):
            found = [samples_of(b) for b in part.to_pylist()]
            yield pa.StructArray.from_arrays([list_array([x for x, _ in found], pa.float32()), pa.array([r for _, r in found], pa.string())], names=["samples", "reason"])


def decode(blob: Column) -> Column:
    """(samples, reason) of an audio blob: OK, EMPTY, FAILED or MISSING."""
    return _decode(blob)


def signals_of(column: pa.Array) -> list[np.ndarray | None]:
    """Rows of samples of a column that holds them, or headerless unsigned 8-bit audio."""
    if pa.types.is_list(column.type):
        return [None if x is None else np.asarray(x, np.float32) for x in list_rows(column)]
    return [None if b is None else (np.frombuffer(b, np.uint8).astype(np.float32) - 128) / 128 for b in column.to_pylist()]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _unsigned(blobs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in blobs:
        for (part,) in array_pieces((batch,)):
            yield list_array(signals_of(part), pa.float32())


def unsigned_samples(blob: Column) -> Column:
    """Samples of headerless unsigned 8-bit audio."""
    return _unsigned(blob)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, reason) of the audio files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", decode(F.col("content")).alias("d")).select("path", "d.samples", "d.reason")
