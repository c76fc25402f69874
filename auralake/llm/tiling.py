"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a seed, ``shortest`` tokens in a row, are
tiled: again and again the longest match of unmarked tokens is marked, found by
running Karp-Rabin hashes of decreasing length (Wise, 1993). The share of an
item's tokens under tiles is its coverage. Tiles may come in any order, so
passages that were shuffled are caught; with tiles of at least four words,
common phrases are not.

The benchmark is a stated query set. It is taken in blocks of at most about
``BLOCK_CHARS`` characters, by a hash of the item, each of which is collected
and broadcast; all documents are matched against every block where they lie,
without a shuffle. If there are several, what one block finds is written before
the next is collected, so the driver and every plan hold one at a time. An item
whose seeds in a document can't reach the threshold is skipped, which loses
nothing: tiles consist of seeds.

Memory is bounded by a text and a block. Seeds of a text are looked up once each,
however often they occur in it; only the left ends of matches are listed, not
all windows of a match, and where even these are many (``MOST_STARTS``), matches
are marked length by length from an index of the text's windows.

Tokens are runs of letters, digits and other non-ASCII characters of the
lower-cased text. Defined results: null, blank and short texts (fewer than
``shortest`` tokens) match nothing, as do such items; texts are taken whole,
however long, and so are items; rows that repeat are each reported; of matches
of equal length the first in the item, then in the document, is marked first.
Keys may be null. Extra columns are ignored by ``contaminated`` and kept by
``uncontaminated``. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.session import append_columns, materialise, pieces

SHORTEST = 4
COVERAGE = 0.6
LONGEST_SEARCH = 32
MOST_STARTS = 1 << 20
BLOCK_CHARS = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``length`` ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    mixed ^= mixed >> np.uint64(29)
    for k in range(length):
        total = total * BASE + mixed[k : k + n]
    return total


def _free(open_: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that are wholly open."""
    runs = np.concatenate([[0], np.cumsum(open_)])
    return np.flatnonzero(runs[length:] - runs[:-length] == length) if len(open_) >= length else np.empty(0, np.int64)


def _codes(ids: np.ndarray, open_: np.ndarray, starts: np.ndarray, closed: int) -> np.ndarray:
    """The token before each start, ``closed`` where there is none or it is marked."""
    return np.where((starts > 0) & open_[starts - 1], ids[starts - 1], closed)


def _starts(item: np.ndarray, text: np.ndarray, a_open: np.ndarray, b_open: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Left ends (item start, text start) of the matches of ``length`` or more open tokens; None if they are too many.

    The item's windows are sorted by hash and by the token before. A text window
    starts a match with those of its hash but for the ones whose token before is
    its own: these continue a match.
    """
    none = np.empty(0, np.int64)
    a, b = _free(a_open, length), _free(b_open, length)
    if not len(a) or not len(b):
        return none, none
    kinds, kind_a = np.unique(window_hashes(item, length)[a], return_inverse=True)
    hb = window_hashes(text, length)[b]
    kind_b = np.minimum(np.searchsorted(kinds, hb), len(kinds) - 1)
    met = kinds[kind_b] == hb
    b, kind_b = b[met], kind_b[met]
    if not len(b):
        return none, none
    span = np.int64(max(int(item.max()), int(text.max()), 0) + 3)
    coded = kind_a * span + _codes(item, a_open, a, -1) + 2
    order = np.argsort(coded, kind="stable")
    coded, a = coded[order], a[order]
    own = kind_b * span + _codes(text, b_open, b, -2) + 2
    edges = [np.searchsorted(coded, x, side) for x, side in ((kind_b * span, "left"), (own, "left"), (own, "right"), ((kind_b + 1) * span, "left"))]
    before, after = edges[1] - edges[0], edges[3] - edges[2]
    times = before + after
    if times.sum() > MOST_STARTS:
        return None
    right = np.repeat(b, times)
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    left = a[np.where(inside < np.repeat(before, times), np.repeat(edges[0], times) + inside, np.repeat(edges[2] - before, times) + inside)]
    same = np.ones(len(left), bool)
    for k in range(length):  # the hash is confirmed
        same &= item[left + k] == text[right + k]
    return left[same], right[same]


def _lengths(item: np.ndarray, text: np.ndarray, a_open: np.ndarray, b_open: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """How far each match goes on, from ``length`` tokens."""
    reach = np.full(len(left), length)
    going = np.arange(len(left))
    while len(going):
        i, j = left[going] + reach[going], right[going] + reach[going]
        going, i, j = (x[(i < len(item)) & (j < len(text))] for x in (going, i, j))
        going = going[(item[i] == text[j]) & a_open[i] & b_open[j]]
        reach[going] += 1
    return reach


def _by_length(item: np.ndarray, text: np.ndarray, a_open: np.ndarray, b_open: np.ndarray, length: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """Tiles of ``longest`` down to ``length`` tokens, marked one length after the other."""
    for n in range(longest, length - 1, -1):
        b = _free(b_open, n)
        hashes = window_hashes(text, n)[b]
        order = np.argsort(hashes, kind="stable")
        hashes, b = hashes[order], b[order]
        a = _free(a_open, n)
        wanted = window_hashes(item, n)[a]
        at = dict(zip(wanted.tolist(), np.searchsorted(hashes, wanted, "left").tolist(), strict=True))
        ends = np.searchsorted(hashes, wanted, "right").tolist()
        for i, h, end in zip(a.tolist(), wanted.tolist(), ends, strict=True):
            if not a_open[i : i + n].all():
                continue
            while at[h] < end:
                j = int(b[at[h]])
                if b_open[j : j + n].all() and (text[j : j + n] == item[i : i + n]).all():
                    a_open[i : i + n] = b_open[j : j + n] = False
                    yield i, j, n
                    break
                at[h] += 1  # what is marked stays so


def tile(item: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id sequences; ids under 0 never match."""
    a_open, b_open = item >= 0, text >= 0
    tiles: list[tuple[int, int, int]] = []
    search = max(shortest, min(LONGEST_SEARCH, len(item), len(text)))
    longest = min(len(item), len(text))
    while a_open.any() and b_open.any():
        starts = _starts(item, text, a_open, b_open, search)
        if starts is None:
            tiles += _by_length(item, text, a_open, b_open, search, longest)
        else:
            reach = _lengths(item, text, a_open, b_open, *starts, search)
            heap = list(zip((-reach).tolist(), starts[0].tolist(), starts[1].tolist(), strict=True))
            heapq.heapify(heap)
            while heap:
                n, i, j = heapq.heappop(heap)
                n = -n
                clear = a_open[i : i + n] & b_open[j : j + n]
                if clear.all():
                    a_open[i : i + n] = b_open[j : j + n] = False
                    tiles.append((i, j, n))
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], clear.astype(np.int8), [0]])))
                for lo, hi in edges.reshape(-1, 2).tolist():
                    if hi - lo >= search:
                        heapq.heappush(heap, (lo - hi, i + lo, j + lo))
        if search == shortest:
            break
        longest = search - 1
        search = max(shortest, search // 2)
    return tiles


class Block:
    """Test items with their vocabulary and seed table."""

    def __init__(self, items: list[tuple], shortest: int, least: float):
        self.shortest, self.least = shortest, least
        self.vocabulary: dict[bytes, int] = {}
        self.keys, self.items = [], []
        for key, text in items:
            found = words(text)
            if len(found) >= shortest:
                self.keys.append(key)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
        seeds = [window_hashes(x, shortest) for x in self.items]
        every = np.concatenate([np.empty(0, np.uint64), *seeds])
        order = np.argsort(every, kind="stable")
        self.seeds = every[order]
        self.seed_item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order] if seeds else order
        self.seed_at = np.concatenate([np.arange(len(s)) for s in seeds])[order] if seeds else order

    def of_text(self, text: str | None) -> Iterator[tuple[object, float, list[tuple[int, int, int]]]]:
        """(item key, coverage, tiles) of each item that the text covers to the threshold."""
        if not self.items or not text:
            return
        found = words(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        free = _free(ids >= 0, self.shortest)
        if not len(free):
            return
        hashes = window_hashes(ids, self.shortest)[free]
        order = np.argsort(hashes, kind="stable")
        hashes, free = hashes[order], free[order]
        opens = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        stops = np.append(opens[1:], len(hashes))
        # Each seed of the text once, with the places in items that hold it: at most the block's own number.
        lo, hi = np.searchsorted(self.seeds, hashes[opens], "left"), np.searchsorted(self.seeds, hashes[opens], "right")
        times = hi - lo
        if not times.any():
            return
        row = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        seed, item = np.repeat(np.arange(len(opens)), times), self.seed_item[row]
        order = np.argsort(item, kind="stable")
        row, seed, item = row[order], seed[order], item[order]
        cuts = [0, *(np.flatnonzero(np.diff(item)) + 1).tolist(), len(item)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = self.items[item[a]]
            reach = np.zeros(len(own) + 1, np.int64)
            starts = np.unique(self.seed_at[row[a:b]])
            np.add.at(reach, starts, 1)
            np.add.at(reach, np.minimum(starts + self.shortest, len(own)), -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < self.least * len(own):
                continue
            # Only the stretches of the text that seeds of this item cover can be tiled.
            at = np.concatenate([free[opens[x] : stops[x]] for x in np.unique(seed[a:b]).tolist()])
            near = np.unique((at[:, None] + np.arange(self.shortest)).ravel())
            gaps = np.flatnonzero(np.diff(near) > 1) + 1
            stretch = np.insert(ids[near], gaps, -1)
            places = np.insert(near, gaps, -1)
            tiles = tile(own, stretch, self.shortest)
            coverage = sum(t[2] for t in tiles) / len(own)
            if coverage >= self.least:
                yield self.keys[item[a]], coverage, [(i, int(places[j]), n) for i, j, n in tiles]


def count_blocks(benchmark: DataFrame, text: str, block_chars: int = BLOCK_CHARS) -> int:
    """The number of blocks of about ``block_chars`` characters each, of which a longer item is one."""
    total = benchmark.agg(F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()[0]
    return -(-total // block_chars)


def block(benchmark: DataFrame, k: int, n: int, key: str, text: str, shortest: int, least: float) -> Block:
    """Block ``k`` of ``n``."""
    part = benchmark.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == k).select(key, text).collect()
    return Block([tuple(r) for r in part], shortest, least)


TILES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_start", "doc_start", "length")]))
_TILES = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_start", "doc_start", "length")]))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    shortest: int = SHORTEST,
    least: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc key, item key, coverage, tiles) of every pair that reaches the threshold."""
    spark = docs.sparkSession
    names = [key, item if item.lower() != key.lower() else f"benchmark_{item}"]
    schema = T.StructType([T.StructField(names[0], docs.schema[key].dataType), T.StructField(names[1], benchmark.schema[item].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", TILES)])
    result = spark.createDataFrame([], schema)
    n = count_blocks(benchmark, item_text, block_chars)
    for k in range(n):
        shared = spark.sparkContext.broadcast(block(benchmark, k, n, item, item_text, shortest, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    rows = [(k.as_py(), *found) for k, t in zip(part.column(0), part.column(1), strict=True) for found in shared.value.of_text(t.as_py())]
                    if rows:
                        keys, items, shares, tiles = zip(*rows, strict=True)
                        stretches = [[dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in x] for x in tiles]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), pa.array(items), pa.array(shares, pa.float64()), pa.array(stretches, _TILES)], names=schema.fieldNames())

        found = docs.select(key, text).mapInArrow(run, schema)
        if n == 1:
            return found
        result = result.unionByName(materialise(found))
        shared.destroy()
    return result


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    shortest: int = SHORTEST,
    least: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that cover no item to the threshold."""
    columns, spark = docs.columns, docs.sparkSession
    n = count_blocks(benchmark, item_text, block_chars)
    if n == 0:
        return docs
    dirty = []
    for k in range(n):
        shared = spark.sparkContext.broadcast(block(benchmark, k, n, item, item_text, shortest, least))

        def start(shared=shared):
            def of(batch: pa.RecordBatch) -> list[pa.Array]:
                column = batch.column(batch.schema.get_field_index(text))
                return [pa.array([next(shared.value.of_text(x.as_py()), None) is None for x in column], pa.bool_())]

            return of

        clean = [T.StructField("_clean", T.BooleanType())]
        if n == 1:
            return append_columns(docs, clean, start).where("_clean").select(columns)
        named = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_m"), F.col(text).alias(text))
        dirty.append(materialise(append_columns(named, clean, start).where("not _clean").select("_k", "_m").distinct()))
        shared.destroy()
    found = dirty[0]
    for more in dirty[1:]:
        found = found.unionByName(more)
    return docs.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_m")), "left_anti")


def op5_greedy_tiling(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))
