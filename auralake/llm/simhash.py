"""SimHash near-duplicates found by vantage-point trees.

Fingerprints within ``radius`` bits are linked and the connected components of
these links are the groups. The search is exact and has two levels of trees:

* A forest of routing trees deals the distinct fingerprints into shards. Each
  tree looks at one quarter of the bits: a pair within the radius differs by at
  most ``radius // 4`` bits in one quarter (pigeonhole), so the triangle bound of
  that tree is so much tighter. A node has a vantage point and a distance mu;
  fingerprints at up to mu + radius // 4 go to its near side, those beyond mu to
  its far side. Those between go to both, so the pair meets in some shard: if
  one of it lies near and one beyond, the latter is within the overlap.
* A shard is searched by a vantage-point tree over whole fingerprints. The points
  of a leaf go down it together, and a branch is pruned for those whose distance
  to the vantage point differs by more than the radius from all of the branch's.
  Leaves that are linked to each other already are not compared again. A shard
  returns one edge per linked fingerprint (a spanning star), never all pairs.

The routing trees are built on the driver from a sample, one fingerprint in
``SAMPLE_SHARE`` and at most ``SAMPLE``; a shard is planned to hold ``SHARD_ROWS``
fingerprints (more above ``SAMPLE * SAMPLE_SHARE`` of them, or where the
fingerprints can't be told apart). The sample decides how the work is dealt
out; no result depends on it. Shards hold 8 bytes a fingerprint.

Equal texts meet before the search, as one fingerprint; nothing about all
fingerprints is gathered on the driver. Fingerprints and groups that many rows
share are broadcast to their rows (at most 4096 of them), not shuffled.

Defined results: a null or blank text has no words and the fingerprint zero,
which links like any other. Texts may have any length. Rows that repeat are rows
of one component. A null doc_id takes part in linking, and a component's id is
the smallest doc_id that isn't null (null if there is none). Extra columns are
ignored by ``near_duplicates`` and kept by ``keep_first``. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.components import components
from auralake.llm.session import append_columns, join_unique, materialise

BITS = 64
SEED = 42
LEAF = 256
QUARTERS = 4
SHARD_ROWS = 4096
SAMPLE = 1 << 16
SAMPLE_SHARE = 64


def simhash(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """The fingerprint of a whole text over word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: len(words) - width].tolist()]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 4096):
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts[at : at + 4096], stops[at : at + 4096], strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class VantageTree:
    """A vantage-point tree over distinct 64-bit fingerprints under the Hamming distance.

    ``points`` are in tree order, ``order`` has the places they came from: those
    of a leaf are neighbours. ``branches`` counts inner nodes, ``pruned`` the
    visits of points that bounds have saved.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order, self.leaf = points.copy(), np.arange(len(points)), leaf
        self.nodes: list[tuple] = []
        self.leaves: list[tuple[int, int]] = []
        self.branches = self.pruned = 0
        if len(points):
            self._build(0, len(points))

    @staticmethod
    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b)

    def _build(self, lo: int, hi: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        part = self.points[lo:hi]
        if hi - lo > self.leaf:
            vantage = part[0].copy()
            far = self.far(part, vantage)
            order = np.argsort(far, kind="stable")
            far = far[order]
            # The cut nearest to the middle that keeps equal distances together.
            cuts = np.flatnonzero(far[1:] != far[:-1]) + 1
            cut = int(cuts[np.argmin(np.abs(cuts - (hi - lo) // 2))])  # the vantage point alone is at distance 0
            self.points[lo:hi], self.order[lo:hi] = part[order], self.order[lo:hi][order]
            spans = [(int(far[0]), int(far[cut - 1])), (int(far[cut]), int(far[-1]))]
            self.branches += 1
            self.nodes[me] = (vantage, lo + cut, hi, [(*span, self._build(a, b)) for span, (a, b) in zip(spans, ((lo, lo + cut), (lo + cut, hi)), strict=True)])
            return me
        self.nodes[me] = (None, lo, hi, [])
        self.leaves.append((lo, hi))
        return me

    def groups(self, radius: int) -> np.ndarray:
        """For each point the place of a point that stands for its linked group."""
        label = np.arange(len(self.points))
        for lo, hi in self.leaves:
            todo = [(0, np.arange(lo, hi))]
            while todo:
                node, who = todo.pop()
                vantage, cut, end, children = self.nodes[node]
                if vantage is None:
                    if end > lo:  # each two leaves meet once
                        self._compare(label, who, cut, end, radius)
                    continue
                far = self.far(self.points[who], vantage)
                for (least, most, child), stop in zip(children, (cut, end), strict=True):
                    if stop > lo:
                        near = (far + radius >= least) & (far <= most + radius)
                        self.pruned += len(who) - int(near.sum())
                        if near.any():
                            todo.append((child, who[near]))
        return label

    def _compare(self, label: np.ndarray, who: np.ndarray, lo: int, hi: int, radius: int) -> None:
        one = label[lo]
        if label[who[0]] == one and (label[who] == one).all() and (label[lo:hi] == one).all():
            return
        hits = np.flatnonzero(self.far(self.points[who][:, None], self.points[None, lo:hi]) <= radius)
        a, b = who[hits // (hi - lo)], hits % (hi - lo) + lo
        while True:
            ra, rb = label[a], label[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while (short := label[label]).tobytes() != label.tobytes():
                label[:] = short


def shard_edges(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of a shard with the one that stands for its group."""
    tree = VantageTree(np.unique(points))
    label = tree.groups(radius)
    moved = label != np.arange(len(label))
    return tree.points[moved], tree.points[label[moved]]


class RoutingTree:
    """Deals fingerprints into overlapping shards by the distances of one quarter of their bits."""

    def __init__(self, quarter: int, sample: np.ndarray, radius: int, most: float):
        self.shift, self.slack = quarter * (BITS // QUARTERS), radius // QUARTERS
        self.nodes: list[tuple] = []
        self.shards = 0
        self._build(self.of(sample), max(most, 16))

    def of(self, points: np.ndarray) -> np.ndarray:
        return (points >> np.uint64(self.shift)).astype(np.uint16)

    def _build(self, parts: np.ndarray, most: float) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        best = (0.9 * len(parts), None, None)
        if len(parts) > most:
            for vantage in parts[:4]:
                sizes = np.cumsum(np.bincount(np.bitwise_count(parts ^ vantage), minlength=BITS))
                near, far = sizes[np.minimum(np.arange(BITS) + self.slack, BITS - 1)], len(parts) - sizes
                mu = int(np.argmin(np.maximum(near, far)))
                best = min(best, (max(near[mu], far[mu]), int(vantage), mu), key=lambda x: x[0])
        _, vantage, mu = best
        if vantage is None:
            self.nodes[me] = (None, self.shards)
            self.shards += 1
        else:
            far = np.bitwise_count(parts ^ np.uint16(vantage))
            self.nodes[me] = (np.uint16(vantage), mu, self._build(parts[far <= mu + self.slack], most), self._build(parts[far > mu], most))
        return me

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places of its points)."""
        parts = self.of(points)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, who = todo.pop()
            if not len(who):
                continue
            found = self.nodes[node]
            if found[0] is None:
                yield found[1], who
                continue
            vantage, mu, near, beyond = found
            far = np.bitwise_count(parts[who] ^ vantage)
            todo += [(near, who[far <= mu + self.slack]), (beyond, who[far > mu])]


def routing_forest(sample: np.ndarray, share: float, radius: int, shard_rows: int) -> list[RoutingTree]:
    """One tree a quarter; a tree of one shard needs no others, since all pairs meet there."""
    forest = []
    for quarter in range(QUARTERS):
        forest.append(RoutingTree(quarter, sample, radius, shard_rows * share))
        if forest[-1].shards == 1:
            return forest[-1:]
    return forest


def fingerprints(df: DataFrame, text: str = "text", width: int = 4, into: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long with the same 64 bits."""

    def start():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [simhash(x.as_py(), width) for x in batch.column(batch.schema.get_field_index(text))]
            return [pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

        return of

    return append_columns(df, [T.StructField(into, T.LongType())], start)


def links(distinct: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, n: int | None = None) -> DataFrame:
    """(a, b) edges between the ``n`` distinct fingerprints (column fp) that span every group."""
    n = distinct.count() if n is None else n
    share = min(1 / SAMPLE_SHARE, SAMPLE / max(n, 1))
    low = F.xxhash64("fp").cast("double") < F.lit(2.0**64 * share - 2.0**63)
    drawn = [r["fp"] for r in distinct.where(low).select("fp").limit(2 * SAMPLE).collect()]
    forest = routing_forest(np.sort(np.array(drawn, np.int64)).view(np.uint64), share, radius, shard_rows)
    shared = distinct.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deal(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            points = np.concatenate(held).view(np.uint64)
            for number, tree in enumerate(shared.value):
                for shard, who in tree.route(points):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), shard * QUARTERS + number)), pa.array(points[who].view(np.int64))], names=["shard", "fp"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= 1 << 20:
                yield from deal(held)
                held = []
        if held:
            yield from deal(held)

    def search(shard: pa.Table) -> pa.Table:
        a, b = shard_edges(shard.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(route, "shard long, fp long").groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, mark, fp, root, component_id) for every row of ``df``.

    mark is a hash of the text, root a fingerprint that stands for the component.
    """
    docs = df.select(key, F.xxhash64(text).alias("mark"), text)
    docs = materialise(fingerprints(docs, text, width).select(key, "mark", "fp"))
    distinct = materialise(docs.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(distinct, radius, shard_rows, n)).select(F.col("node").alias("fp"), "root")
    members = materialise(distinct.join(roots, "fp").select("fp", "least", "root"))
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    grouped = join_unique(members, ids, ["root"], "n", members.count()).select("fp", "root", "component_id")
    # A fingerprint without links is its own group.
    own = F.col("root").isNull()
    named = distinct.join(grouped, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(own, F.col("least")).otherwise(F.col("component_id")).alias("component_id"), "n")
    return join_unique(docs, named, ["fp"], "n", total).select(key, "mark", "fp", "root", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``df`` of each component: that with the least key (nulls last), and of those the least hash of its text.

    Of rows of equal key and text one stays.
    """
    found = near_duplicates(df, key, text, width, radius)
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "mark")
    first = found.groupBy("root").agg(F.min(place).alias("row")).select(F.col("row.k").alias("_k"), F.col("row.mark").alias("_m"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_m")), "left_semi").dropDuplicates([key, text])


def op2_vantage_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
