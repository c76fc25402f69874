"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints, searched by vantage-point trees, and every link checked on
the whole shingle sets:

* A fingerprint has ``FP_BITS`` bits. In one of them a pair at 0.8 differs with a
  chance of 0.1875 at most (four shingles against five; 0.152 for long texts), so
  it lies within ``RADIUS`` of them but for a chance below 3e-9, and unrelated
  pairs differ in 256 +- 11. (64 bits don't tell them apart: 10 and 32 +- 4.)
* At that radius no vantage point tells unrelated texts apart, so a tree over all
  would compare all with all. What meets in a tree is dealt by ``BANDS`` bands of
  ``ROWS`` minima: each text is tied to the least text of each of its bands (the
  number of ties is linear for groups of any size), and the fingerprints of a
  component of ties are one search. A pair at 0.8 shares no band with a chance of
  (1 - 0.8 ** 6) ** 64, below 4e-9.
* The texts of fingerprints that the trees linked, one for equal shingle sets,
  meet and are linked exactly.

A component goes to one task if it has at most ``BLOCK`` bytes of text (a quarter
of it of fingerprints), else each two of its parts of about that size go to a
task of their own, whose links are joined by components again.

Links are transitive. Shingles and sets are identified by 64-bit hashes. A task
holds two parts of a component, or one text if that is larger. A component of c
parts takes c * (c + 1) / 2 tasks, so its cost grows faster than its size; copies
with equal shingle sets don't count towards it.

Defined results: words are those of SimHash; a text of fewer than five has one
shingle, all of it; null and blank texts are equal. Rows of equal key and text
are one. Of a group the row with the least key stays (null keys last), of those
the one with the least hash of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.components import components
from auralake.llm.session import append_columns, give_back, join_unique, materialise, shuffle_partitions
from auralake.llm.simhash import VantageTree

WIDTH = 5
LEAST = (4, 5)
BANDS, ROWS = 64, 6
FP_BITS, RADIUS = 512, 150
LEAF = 64
BLOCK = 8 << 20
SEED = 42
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_ADDED = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_PLACES = _RNG.integers(0, 1 << 63, max(WIDTH, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STREAMS = _RNG.integers(0, 1 << 63, FP_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0], np.uint64)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashed[j : j + n] * _PLACES[j]
    return np.unique(_mixed(total))


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, (_FACTORS * short[at : at + 512] + _ADDED).min(axis=1), out=low)
    minima = low.reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((minima * _PLACES[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set: a bit is 1 if it is set in over half of the shingles' hashes."""
    ones = np.zeros(FP_BITS, np.int64)
    for at in range(0, len(found), 255):  # as many as a byte counts
        hashed = _mixed(found[at : at + 255, None] + _STREAMS)
        ones += np.unpackbits(hashed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")


class WideTree(VantageTree):
    """A vantage-point tree over distinct fingerprints of several words."""

    @staticmethod
    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16)


def similar(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """For each of the fingerprints the index of one that stands for its group."""
    distinct, first, own = np.unique(points, axis=0, return_index=True, return_inverse=True)
    tree = WideTree(distinct, leaf)
    group = np.empty(len(distinct), np.int64)
    group[tree.order] = first[tree.order[tree.groups(radius)]]
    return group[own.reshape(-1)]


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each of the shingle sets the index of the first of its group."""
    group, alive = np.arange(len(sets)), np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    while len(alive):
        first, todo, alive = alive[0], [alive[0]], alive[1:]
        while todo and len(alive):
            own = sets[todo.pop()]
            n = len(own)
            fits = (sizes[alive] * LEAST[1] >= n * LEAST[0]) & (n * LEAST[1] >= sizes[alive] * LEAST[0])
            near = np.zeros(len(alive), bool)
            for i in np.flatnonzero(fits):
                other = sets[alive[i]]
                at = np.minimum(np.searchsorted(own, other), n - 1)
                shared = int((own[at] == other).sum())
                near[i] = shared * LEAST[1] >= (n + len(other) - shared) * LEAST[0]
            group[alive[near]] = first
            todo.extend(alive[near].tolist())
            alive = alive[~near]
    return group


def _least(band: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands and nodes in order, with the least node of each band."""
    order = np.lexsort((node, band))
    band, node = band[order], node[order]
    opens = np.append(True, band[1:] != band[:-1])
    return band, node, node[np.flatnonzero(opens)][np.cumsum(opens) - 1]


def _ties(rows: DataFrame) -> DataFrame:
    """(a, b): each set with the least set of each of its bands.

    Batches are reduced where they lie, so of a band that many sets share one row a batch is shuffled.
    """
    deal = 4 * shuffle_partitions(rows.sparkSession)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).flatten().to_numpy()
            band, node, least = _least(found, np.repeat(batch.column(0).to_numpy(), BANDS))
            tied = node != least
            first = ~tied & np.append(True, (band[1:] != band[:-1]) | (node[1:] != node[:-1]))
            pairs = np.unique(np.stack([node[tied], least[tied]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(band[first], pairs[:, 0])), pa.array(np.append(node[first], pairs[:, 1])), pa.array(np.arange(first.sum() + len(pairs)) >= first.sum())], names=["band", "node", "pair"])

    def tie(dealt: pa.Table) -> pa.Table:
        band, node, pair = (dealt.column(c).to_numpy() for c in ("band", "node", "pair"))
        _, own, least = _least(band[~pair], node[~pair]) if (~pair).any() else (None, node[:0], node[:0])
        found = np.unique(np.concatenate([np.stack([own, least], axis=1)[own != least], np.stack([band, node], axis=1)[pair]]), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    reduced = rows.select("node", "bands").mapInArrow(reduce, "band long, node long, pair boolean")
    return reduced.groupBy(F.pmod("band", F.lit(deal)).alias("deal")).applyInArrow(tie, "a long, b long")


def _cells(members: DataFrame, size: Column, block: int) -> tuple[DataFrame, bool]:
    """``members`` with the tasks (low, high, cell) that each goes to, and whether there is a component in parts.

    A component of more than ``block`` bytes is cut in parts, and a member goes to each task that has its part.
    """
    large = members.groupBy("tied").agg(F.ceil(F.sum(size) / block).alias("parts")).where("parts > 1")
    any_large = large.limit(1).count() > 0
    deal = 4 * shuffle_partitions(members.sparkSession)
    whole = F.array(F.struct(F.pmod(F.xxhash64("tied"), F.lit(deal)).alias("low"), F.lit(-1).cast("long").alias("high"), F.lit(0).cast("long").alias("cell")))
    if not any_large:
        return members.withColumn("cells", whole), False
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.struct(F.least(part, other).alias("low"), F.greatest(part, other).alias("high"), F.col("tied").alias("cell")))
    return members.join(large, "tied", "left").withColumn("cells", F.when(F.col("parts").isNull(), whole).otherwise(parts)).drop("parts"), True


def _met(dealt: DataFrame, any_large: bool, grouped: Callable[[list], np.ndarray]) -> DataFrame:
    """(node, root) of ``dealt`` (node, tied, body, cells); ``grouped`` links the bodies of a component that meet in a task."""

    def link(dealt: pa.Table) -> pa.Table:
        node, tie, body = dealt.column("node").to_numpy(), dealt.column("tied").to_numpy(), dealt.column("body")
        order = np.lexsort((node, tie))
        cuts = [0, *(np.flatnonzero(np.diff(tie[order])) + 1).tolist(), len(order)]
        found = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = node[order[lo:hi]]
            found.append((own, own[grouped([body[int(i)].as_py() for i in order[lo:hi]])]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        give_back()
        return pa.table({"node": a, "root": b, "parted": dealt.column("high").to_numpy() >= 0})

    dealt = dealt.select("node", "tied", "body", F.explode("cells").alias("at")).select("node", "tied", "body", "at.*")
    found = dealt.groupBy("cell", "low", "high").applyInArrow(link, "node long, root long, parted boolean")
    if any_large:
        found = materialise(found)
        found = found.where(~F.col("parted")).drop("parted").unionByName(components(found.where("parted"), "node", "root"))
    return found.select("node", "root")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """(k, mark, root) for every row of ``df``; mark is the hash of its text, root that of its group.

    ``block`` is the size in bytes of the parts of larger components; beyond
    ``radius`` bits between fingerprints nothing is linked.
    """
    named = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("mark"), F.col(text).alias("body"))

    def start():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            nodes, made, prints = [], [], []
            for x in batch.column(batch.schema.get_field_index("body")):
                found = shingles(x.as_py())
                nodes.append(set_id(found))
                made.append(bands(found).view(np.int64))
                prints.append(fingerprint(found).tobytes())
            return [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(made, pa.list_(pa.int64())), pa.array(prints, pa.binary())]

        return of

    fields = [T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.BinaryType())]
    rows = materialise(append_columns(named, fields, start).select("k", "mark", "node", "bands", "fp", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("size")))
    chosen = rows.groupBy("node").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "mark", "size", "fp")).alias("row"), F.count("*").alias("n"))
    total = max(rows.count(), 1)
    tied = materialise(components(_ties(rows)).join(chosen, "node").select("node", F.col("root").alias("tied"), "row.k", "row.mark", "row.size", "row.fp"))
    prints, any_large = _cells(tied.select("node", "tied", F.col("fp").alias("body")), F.lit(FP_BITS // 8), -(-block // 4))
    near = materialise(_met(prints, any_large, lambda found: similar(np.frombuffer(b"".join(found), "<u8").reshape(len(found), -1), radius)).where("node <> root"))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    members = materialise(near.join(tied.drop("tied", "fp"), "node").withColumnRenamed("root", "tied"))
    members, any_large = _cells(members, F.col("size"), block)
    members = members.select("node", "tied", "k", "mark", "cells")
    texts = named.join(members, named["k"].eqNullSafe(members["k"]) & (named["mark"] == members["mark"])).groupBy("node").agg(F.first(F.struct("tied", "body", "cells")).alias("row"))
    found = _met(texts.select("node", "row.*"), any_large, lambda found: linked([shingles(x) for x in found]))
    # Copies of one shingle set may be most of the rows: such sets get their roots where their rows lie.
    roots = chosen.select("node", "n").join(materialise(found), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n")
    return join_unique(rows.select("k", "mark", "node"), roots, ["node"], "n", total).select("k", "mark", "root")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` less all but the first of each group."""
    found = materialise(groups(df, key, text, block, radius))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "mark")).alias("row")).select(F.col("row.k").alias("_k"), F.col("row.mark").alias("_m"))
    stay = df.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_m")), "left_semi")
    repeated = found.groupBy("k", "mark").count().where("count > 1").limit(1).count()
    return stay.dropDuplicates([key, text]) if repeated else stay
