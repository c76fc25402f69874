"""Packing by vector bin packing with the dot-product heuristic.

An example demands a vector: tokens, segments and loss-bearing tokens. A
sequence has a capacity in each. The open sequence takes, among the buffered
examples that fit in every dimension, the one whose demand has the largest
weighted dot product with what is left (Panigrahy et al., 2011); weights are the
inverse capacities. If none fits and cutting is allowed, the longest is cut to
fill the rest. Where another limit than that of tokens ends such a sequence, it
is filled anew to the largest power of two below, which needs no padding.

Every task packs its own rows, a bounded buffer at a time, so there is no
shuffle and a hot source is as good as any other. What remains when a task ends
is less than one sequence; it is dealt to sequences that hold powers of two,
which need no padding. Sequence ids are the partition's number, shifted by 40
bits, plus a count, so a task that is run again gives the same ids.

Defined results: a null or blank text is a document of the end id alone; a text of
more tokens than a sequence holds, however long, is cut. Rows
that repeat, or have no key, are packed each on its own. An empty table has no pieces. An item of
``pack_items`` that is over a capacity by itself gets a sequence of its own and
``oversize`` true; null demands count as zero. Columns other than those named
are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.session import give_back, pieces
from auralake.llm.wordpiece import SUFFIX, byte_alphabet

CAPACITY = 4096
MAX_SEGMENTS = 512
END_ID = 2
BUFFER_ITEMS = 1024
BUFFER_TOKENS = 4 << 20
CACHE_CHUNKS = 100_000
STEP_CHARACTERS = 1 << 18
SHIFT = 40


class PieceCoder:
    """The merges of a tokenizer file with word ends, run by the faster byte-pair core.

    A word's end is the byte 0xFF, which UTF-8 never holds. Ids are merge ranks in such files, and
    the merge of a last byte with the end comes before all others, so the same merges happen in the same order.
    """

    #: Composed Latin letters, which normalisation leaves alone, and one mark at most: the word and the mark are pieces.
    PLAIN = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {}
        for piece, rank in vocabulary.items():
            end = piece.endswith(SUFFIX) and piece != SUFFIX
            ranks[bytes(of[c] for c in (piece[: -len(SUFFIX)] if end else piece)) + b"\xff" * end] = rank
        self.core = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def of(self, chunk: bytes) -> bytes | None:
        """Ids of a plain chunk; None for any other."""
        plain = self.PLAIN.fullmatch(chunk.decode())
        if plain is None:
            return None
        word, mark = plain.groups()
        ids = self.core(word.lower().encode() + b"\xff")
        return array("I", ids + self.core(mark.encode() + b"\xff") if mark else ids).tobytes()


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and no token crosses it, so the ids of a
    text are those of its parts between ASCII white space, which are remembered:
    the newest in one table, the ones before in another, both bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            self.coder = PieceCoder(json.load(file)["model"]["vocab"]) if sys.byteorder == "little" else None

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; as many at a time as keep the tables small."""
        found, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size >= STEP_CHARACTERS:
                found += self._of(some)
                some, size = [], 0
        return found + self._of(some)

    def _of(self, texts: list[str | None]) -> list[bytes]:
        parts = [(t or "").encode("utf-8", "replace").split() for t in texts]
        if len(self.seen) > CACHE_CHUNKS:
            self.seen, self.before = {}, self.seen
        seen, before, other = self.seen, self.before, []
        for chunk in set().union(*parts).difference(seen):
            found = before.get(chunk) or (self.coder and self.coder.of(chunk))
            if found is None:
                other.append(chunk)
            else:
                seen[chunk] = found
        for at in range(0, len(other), 8192):
            some = other[at : at + 8192]
            for chunk, found in zip(some, self.tokenizer.encode_batch([c.decode() for c in some], add_special_tokens=False), strict=True):
                seen[chunk] = np.array(found.ids, "<u4").tobytes()
        end = np.array([END_ID], "<u4").tobytes()
        get = seen.__getitem__
        return [b"".join(map(get, p)) + end for p in parts]


@functools.cache
def token_ids(path: str) -> TokenIds:
    """One per Python worker, which keeps what it has seen from task to task."""
    return TokenIds(path)


class Packer:
    """Packs a stream of items; ``sequences`` are lists of (item, start, length)."""

    def __init__(self, capacity: tuple[int, int, int], cut: bool, room: int = BUFFER_ITEMS):
        self.capacity, self.cut = np.array(capacity, np.float64), cut
        self.need = np.zeros((room, 3))
        self.alive = np.zeros(room, bool)
        self.item, self.start = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.tokens = 0

    def full(self) -> bool:
        return bool(self.alive.all()) or self.tokens >= BUFFER_TOKENS

    def add(self, item: int, start: int, need: tuple[int, int, int]) -> None:
        slot = int(np.argmin(self.alive))
        self.need[slot], self.alive[slot], self.item[slot], self.start[slot] = need, True, item, start
        self.tokens += need[0]

    def _take(self, slot: int, length: int) -> tuple[int, int, int]:
        """(item, start, length) taken from a slot, whole or its first tokens."""
        piece = (int(self.item[slot]), int(self.start[slot]), length)
        whole = length == self.need[slot, 0]
        self.tokens -= length
        if whole:
            self.alive[slot] = False
        else:
            self.start[slot] += length
            self.need[slot, 0] -= length
            self.need[slot, 2] = min(self.need[slot, 2], self.need[slot, 0])
        return piece

    def sequence(self, tokens: int | None = None) -> list[tuple[int, int, int]]:
        """Fill and return one sequence, of at most so many tokens.

        With cutting it holds all of its tokens or a power of two, if every piece may bear loss for all of its own.
        """
        whole = int(min(self.capacity[0], tokens or self.capacity[0]))
        before = (self.need.copy(), self.alive.copy(), self.start.copy(), self.tokens)
        out = self._fill(whole)
        while self.cut and (size := sum(n for *_, n in out)) < whole and size & (size - 1):
            self.need, self.alive, self.start, self.tokens = (x.copy() if isinstance(x, np.ndarray) else x for x in before)
            whole = 1 << (size.bit_length() - 1)
            out = self._fill(whole)
        return out

    def _fill(self, tokens: int) -> list[tuple[int, int, int]]:
        left, out = self.capacity.copy(), []
        left[0], left[2] = tokens, min(tokens, left[2])
        while left[0] > 0 and self.alive.any():
            fits = self.alive & (self.need <= left).all(axis=1)
            if fits.any():
                score = np.where(fits, self.need @ (left / self.capacity**2), -1.0)
                slot = int(np.argmax(score))
                need = self.need[slot].copy()
                out.append(self._take(slot, int(need[0])))
                left -= need
            elif self.cut and left[1] >= 1 and min(left[0], left[2]) >= 1:
                slot = int(np.argmax(np.where(self.alive, self.need[:, 0], -1.0)))
                length = int(min(left[0], left[2], self.need[slot, 0]))
                out.append(self._take(slot, length))
                left -= (length, 1, length)
            else:
                break
        return out

    def drain(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences for all that is buffered; those not full hold a power of two if cutting is allowed."""
        while self.alive.any():
            most = None
            if self.cut and self.tokens < self.capacity[0]:
                most = 1 << (int(self.tokens).bit_length() - 1)
            found = self.sequence(most)
            if not found:
                break
            yield found


def pack_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Every token of plain text bears loss; ``vocabulary`` is a tokenizer file's path on every executor.
    """
    limits = (capacity, max_segments, capacity if max_loss is None else max_loss)
    whole = min(limits[0], limits[2])
    schema = T.StructType([df.select(key).schema.fields[0], *(T.StructField(n, T.LongType()) for n in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        packer = Packer(limits, cut=True)
        held: dict[int, tuple] = {}  # item: key, ids, tokens not yet placed
        rows: list[tuple] = []
        count = [0, TaskContext.get().partitionId() << SHIFT]

        def place(sequence: list[tuple[int, int, int]]) -> None:
            offset = 0
            for item, start, length in sequence:
                name, ids, rest = held[item]
                rows.append((name, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, count[1], offset))
                offset += length
                if rest == length:
                    del held[item]
                else:
                    held[item] = (name, ids, rest - length)
            count[1] += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.fieldNames())
            rows.clear()
            return batch

        kinds = None
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                kinds = kinds or [part.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                for name, ids in zip(part.column(0).to_pylist(), tokens.of(part.column(1).to_pylist()), strict=True):
                    item, count[0], size = count[0], count[0] + 1, len(ids) // 4
                    held[item] = (name, ids, size)
                    start = 0
                    while size - start >= whole:
                        place([(item, start, whole)])
                        start += whole
                    if start < size:
                        while packer.full():
                            place(packer.sequence())
                        packer.add(item, start, (size - start, 1, size - start))
                if rows:
                    yield flush()
        for sequence in packer.drain():
            place(sequence)
        if rows:
            yield flush()
        give_back()

    return df.select(key, text).mapInArrow(run, schema)


def pack_items(df: DataFrame, key: str, tokens: str, segments: str, loss: str, capacity: tuple[int, int, int]) -> DataFrame:
    """Place whole examples: (key, sequence_id, offset, tokens, oversize)."""
    schema = T.StructType([df.select(key).schema.fields[0], *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "tokens")), T.StructField("oversize", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, rows = Packer(capacity, cut=False), {}, []
        count = [0, TaskContext.get().partitionId() << SHIFT]
        kinds = None

        def place(sequence: list[tuple[int, int, int]], oversize: bool = False) -> None:
            offset = 0
            for item, _, length in sequence:
                rows.append((held.pop(item), count[1], offset, length, oversize))
                offset += length
            count[1] += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.fieldNames())
            rows.clear()
            return batch

        for batch in batches:
            kinds = kinds or [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            for name, *need in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                item, count[0] = count[0], count[0] + 1
                held[item] = name
                need = [n or 0 for n in need]
                if any(n > c for n, c in zip(need, capacity, strict=True)):
                    place([(item, 0, need[0])], True)
                    continue
                while packer.full():
                    place(packer.sequence())
                packer.add(item, 0, tuple(need))
            if rows:
                yield flush()
        for sequence in packer.drain():
            place(sequence)
        if rows:
            yield flush()

    return df.select(key, *(F.col(c).cast("long").alias(f"_{i}") for i, c in enumerate((tokens, segments, loss)))).mapInArrow(run, schema)


def op6_vector_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; a digest of each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(pack_documents(docs))


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
