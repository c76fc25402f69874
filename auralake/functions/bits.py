"""Packed integers: landmark hashes, sub-hash halves, big-endian blobs, popcounts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BITS = 32
HIGH_TAG = 1 << 16


def as_signed(value: Column) -> Column:
    """The signed 32-bit integer with the bits of an unsigned one."""
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def as_unsigned(value: Column) -> Column:
    return value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def landmark(anchor_bin: Column, target_bin: Column, delta: Column) -> Column:
    """Eight bits of each half bin number and six of the frame distance, in 22 bits."""
    half = lambda b: F.shiftright(b.cast("int"), 1).bitwiseAND(F.lit(255))
    return F.shiftleft(half(anchor_bin), 14).bitwiseOR(F.shiftleft(half(target_bin), 6)).bitwiseOR(delta.cast("int").bitwiseAND(F.lit(63)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _unpack(blobs: pa.Array) -> pa.Array:
    sound = [b if b is not None and len(b) % 4 == 0 else b"" for b in blobs.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in sound])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(sound), ">u4").astype(np.int64)))


def unpack_words(blob: Column) -> Column:
    """Unsigned 32-bit big-endian words of a blob as longs; a torn blob (or null) has none."""
    return _unpack(blob)


@F.arrow_udf(T.BinaryType())
def _pack(words: pa.Array) -> pa.Array:
    flat = words.flatten()
    held = flat.is_valid().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(held)])  # null words are left out
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 4 * before[np.concatenate([[0], ends])]
    data = flat.drop_null().to_numpy(zero_copy_only=False).astype(">u4").tobytes()
    return pa.array([data[at[i] : at[i + 1]] if v else None for i, v in enumerate(words.is_valid().to_pylist())], pa.binary())


def pack_words(words: Column) -> Column:
    """The big-endian blob of an array of unsigned 32-bit words."""
    return _pack(words)


def halves(words: Column) -> Column:
    """The distinct low and tagged high halves of 32-bit words, in order."""
    low = F.transform(words, lambda w: w.bitwiseAND(F.lit(0xFFFF)))
    high = F.transform(words, lambda w: F.shiftright(w, 16).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(HIGH_TAG)))
    return F.array_sort(F.transform(F.array_union(low, high), lambda h: h.cast("int")))


def agreement(differing: Column, words: Column) -> Column:
    """The share of equal bits, given the differing ones among so many words."""
    return 1.0 - differing / (words * WORD_BITS)
