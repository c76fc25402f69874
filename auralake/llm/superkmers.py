"""Substring dedup by super-k-mers.

A window is ``k`` consecutive words of a document. Its minimiser is the least
hash among its runs of ``m`` words, so equal windows have equal minimisers.
Consecutive windows that share one travel as one packed string, a super-k-mer,
to the bucket of that minimiser; there all windows are sorted and each group of
equal ones learns its smallest key. Windows of a larger key are removed.

Super-k-mers of a task and bucket are packed together and compressed, which
more than makes up for the words that neighbours share. Buckets are in
proportion to the text (``BUCKET_BYTES``), so none grows with the corpus. A
minimiser that a sample of the documents shows to be hot (over half a bucket's
worth of windows; there are at most twice as many as buckets) is kept out of the
buckets: its windows are grouped by two 64-bit hashes with a partially
aggregated minimum and joined back, which any number of tasks can share; the
minima of hot windows are broadcast to where these lie. The sample steers
traffic alone; no result depends on it.

Window equality is that of two independent 64-bit polynomial hashes over 64-bit
word hashes. Words are maximal runs of bytes other than ASCII white space.

Defined results: null, blank and short texts (fewer than ``k`` words) lose
nothing; texts may have any length. Rows with a null key neither cause nor suffer removal. Rows of one key
never remove each other's windows, so repeated rows are treated alike. Extra
columns are kept by ``dedup``, except that the outputs replace their namesakes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.session import append_columns, join_unique, materialise, pieces, without

WINDOW = 50
MINIMISER_WORDS = 8
FLUSH_BYTES = 32 << 20
BUCKET_BYTES = 4 << 20
HOT_SAMPLE_DOCS = 20_000
B1, B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, b in ((up, base), (down, pow(base, -1, 1 << 64))):
        out[0] = 1
        filled = 1
        while filled <= n:
            step = np.uint64(pow(b, filled, 1 << 64))
            take = min(filled, n + 1 - filled)
            out[filled : filled + take] = out[:take] * step
            filled += take
    return up, down


class Rolling:
    """Polynomial window hashes modulo 2**64, all windows at once."""

    def __init__(self, base: int):
        self.base, self.n = base, -1

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        n = len(values)
        if n > self.n:
            self.n = 2 * n + 1024
            self.up, self.down = _powers(self.base, self.n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=total[1:])
        return (total[length:] - total[: n + 1 - length]) * self.down[: n + 1 - length]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


class Splitter:
    """Cuts texts into super-k-mers."""

    def __init__(self, k: int, m: int):
        self.k, self.m, self.roll = k, min(m, k), Rolling(B1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def minimisers(self, hashes: np.ndarray) -> np.ndarray:
        """The minimiser of every window."""
        return sliding_min(_mix(self.roll.windows(hashes, self.m)), self.k - self.m + 1)

    def runs(self, minimisers: np.ndarray) -> tuple[list[int], list[int]]:
        """First and last-plus-one window of each run of equal minimisers."""
        cuts = (np.flatnonzero(minimisers[1:] != minimisers[:-1]) + 1).tolist()
        return [0, *cuts], [*cuts, len(minimisers)]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def hot_minimisers(docs: DataFrame, text: str, k: int, m: int, buckets: int, n: int) -> list[int]:
    """Minimisers that hold over half a bucket's worth of all windows, by a sample of the ``n`` documents."""
    if not n:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Splitter(k, m)
        for batch in batches:
            seen: dict[int, int] = {}
            for x in batch.column(0):
                words = _words(x.as_py())
                if len(words) >= k:
                    for value, times in zip(*np.unique(cut.minimisers(cut.hashes(words)), return_counts=True), strict=True):
                        seen[int(value)] = seen.get(int(value), 0) + int(times)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([*seen], np.uint64).view(np.int64)), pa.array([*seen.values()], pa.int64())], names=["minimiser", "n"])

    drawn = docs.select(text).sample(min(1.0, HOT_SAMPLE_DOCS / n), seed=7) if n > HOT_SAMPLE_DOCS else docs.select(text)
    counted = drawn.mapInArrow(run, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "minimiser").limit(2 * buckets).select("minimiser", "n").collect()
    total = counted.agg(F.sum("n")).first()[0] or 0
    # A long document alone is not hot: a hot minimiser is met in many.
    return [r["minimiser"] for r in top if r["n"] > max(total / (2 * buckets), 64 * k)]


def packed(docs: DataFrame, key: str, mark: str, text: str, k: int, m: int, buckets: int, hot) -> DataFrame:
    """(bucket, n, packed super-k-mers): keys, marks, first words and lengths, then the strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, squeeze = Splitter(k, m), zstandard.ZstdCompressor(level=6)
        aside = np.array(sorted(hot.value), np.int64).view(np.uint64)
        held: dict[int, list[tuple[int, int, int, bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for bucket, own in held.items():
                keys, marks, starts, strings = zip(*own, strict=True)
                head = np.array([keys, marks, starts], "<i8").tobytes()
                rows.append((bucket, len(own), squeeze.compress(head + b"\n".join(strings))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "n", "body"])

        for batch in batches:
            for part in pieces(batch, 8 << 20):
                for name, mark_, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    words = _words(x.as_py())
                    if name is None or len(words) < k:
                        continue
                    least = cut.minimisers(cut.hashes(words))
                    firsts, lasts = cut.runs(least)
                    values = least[firsts]
                    use = ~np.isin(values, aside) if len(aside) else np.ones(len(values), bool)
                    deal = (_mix(values) % np.uint64(buckets)).tolist()
                    for a, b, bucket, ok in zip(firsts, lasts, deal, use.tolist(), strict=True):
                        if ok:
                            string = b" ".join(words[a : b + k - 1])
                            size += len(string)
                            held.setdefault(bucket, []).append((name, mark_, a, string))
                    if size > FLUSH_BYTES:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.select(F.col(key).cast("long").alias(key), mark, text).mapInArrow(run, "bucket long, n long, body binary")


def _merge(keys, marks, starts, k: int) -> tuple[np.ndarray, ...]:
    """Windows of the same row that follow each other closely become one stretch of words."""
    order = np.lexsort((starts, marks, keys))
    keys, marks, starts = keys[order], marks[order], starts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] > starts[:-1] + k)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys))[: len(first)] - 1
    return keys[first], marks[first], starts[first], starts[last] + k


def bucket_windows(bodies: list[tuple[int, bytes]], k: int) -> tuple[np.ndarray, ...]:
    """(key, mark, first word, end) of the stretches of a bucket that a smaller key has too."""
    open_ = zstandard.ZstdDecompressor()
    one, two = Rolling(B1), Rolling(B2)
    parts = []
    for n, body in bodies:
        data = open_.decompress(body)
        keys, marks, starts = np.frombuffer(data, "<i8", 3 * n).reshape(3, n)
        strings = data[24 * n :].split(b"\n")
        sizes = np.array([s.count(b" ") + 1 for s in strings], np.int64)
        words = data[24 * n :].split()
        values = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # compared in this process alone
        del strings, words
        windows = sizes - k + 1
        row = np.repeat(np.arange(n), windows)
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
        parts.append((one.windows(values, k)[at], two.windows(values, k)[at], keys[row], marks[row], starts[row] + inside))
    h1, h2, keys, marks, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h1, kind="stable")
    s1, s2 = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(keys[order], np.flatnonzero(new))
    later = order[keys[order] > least[group]]
    return _merge(keys[later], marks[later], starts[later], k)


STRETCH = "key long, mark long, lo long, hi long"


def stretches(docs: DataFrame, key: str, mark: str, text: str, k: int, m: int, buckets: int | None = None) -> DataFrame:
    """(key, mark, lo, hi): stretches of words to be removed; they may overlap."""
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text).cast("long"))).first()
    buckets = buckets or -(-(size or 1) // BUCKET_BYTES)
    hot = hot_minimisers(docs, text, k, m, buckets, n)
    shared = spark.sparkContext.broadcast(hot)

    def search(bucket: pa.Table) -> pa.Table:
        bodies = list(zip(bucket.column("n").to_pylist(), bucket.column("body").to_pylist(), strict=True))
        return pa.table([pa.array(x) for x in bucket_windows(bodies, k)], names=["key", "mark", "lo", "hi"])

    found = packed(docs, key, mark, text, k, m, buckets, shared).groupBy("bucket").applyInArrow(search, STRETCH)
    if not hot:
        return found

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, one, two = Splitter(k, m), Rolling(B1), Rolling(B2)
        aside = np.array(sorted(shared.value), np.int64).view(np.uint64)
        for batch in batches:
            for name, mark_, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _words(x.as_py())
                if name is None or len(words) < k:
                    continue
                hashes = cut.hashes(words)
                at = np.flatnonzero(np.isin(cut.minimisers(hashes), aside))
                if len(at):
                    columns = (one.windows(hashes, k)[at].view(np.int64), two.windows(_mix(hashes), k)[at].view(np.int64), np.full(len(at), name), np.full(len(at), mark_), at)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "key", "mark", "lo"])

    # Both sides of the join are read anew, so that each has a shuffle of its own, whose hot partitions can be split.
    windows = materialise(docs.select(F.col(key).cast("long").alias(key), mark, text).mapInArrow(single, "h1 long, h2 long, key long, mark long, lo long"))
    least = materialise(windows.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("times")).where("least < most").drop("most"))
    later = join_unique(windows, least, ["h1", "h2"], "times", windows.count()).where("key > least")
    return found.unionByName(later.select("key", "mark", "lo", (F.col("lo") + k).alias("hi")))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = MINIMISER_WORDS, buckets: int | None = None, into: str = "kept") -> DataFrame:
    """``df`` with n_words, n_removed and the words kept, joined by one space. Keys are integers."""
    marked = without(df, "_mark", "_cut", "_key", "_same").withColumn("_mark", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = stretches(marked, key, "_mark", text, k, m, buckets)
    cuts = found.groupBy(F.col("key").alias("_key"), F.col("mark").alias("_same")).agg(F.collect_list(F.struct("lo", "hi")).alias("_cut"))
    joined = marked.join(cuts, (F.col(key).cast("long") == F.col("_key")) & (F.col("_mark") == F.col("_same")), "left").drop("_key", "_same", "_mark")

    def start():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            cuts_ = batch.column(batch.schema.get_field_index("_cut"))
            for x, cut in zip(batch.column(batch.schema.get_field_index(text)), cuts_, strict=True):
                words = _words(x.as_py())
                n = len(words)
                if cut.is_valid:
                    change = np.zeros(n + 1, np.int64)
                    flat = cut.values
                    np.add.at(change, flat.field("lo").to_numpy(), 1)
                    np.add.at(change, flat.field("hi").to_numpy(), -1)
                    stay = np.flatnonzero(np.cumsum(change[:n]) == 0)
                    words = [words[i] for i in stay.tolist()]
                out.append((n, n - len(words), b" ".join(words).decode()))
            return [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]

        return of

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(into, T.StringType())]
    return append_columns(joined, fields, start).drop("_cut")


def op9_superkmers(spark, sf_dir: str) -> DataFrame:
    """Every document less the windows of 50 words that a smaller doc_id has too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
