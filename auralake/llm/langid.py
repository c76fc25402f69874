"""Language identification by nearest centroids.

A text is a unit vector of character n-gram counts (bytes of the lower-cased
letters, 1 to 3 long, hashed to ``DIM`` cells; ASCII marks and tokens with a
digit, which no language owns, count as blanks), weighted by log frequency and
inverse document frequency. Each language has up to four centroids, found by
spherical k-means among its examples; a text belongs to the language of the
centroid with the largest cosine. It is rejected if the cosine is below the
cut-off of that language.

Fitting takes at most ``SAMPLE_PER_LANGUAGE`` different labelled texts of each
language, those with the smallest hashes of key and text; this bound is the only
one, every label is learned. A text enters the model as its count vector of
``DIM`` numbers. Executors add up document frequencies and cluster, one language
a task; the driver gets one number a cell and at most four centroids of 32 kB a
language. The cut-off is half of the ``QUANTILE`` of the cosines that examples of
the language have to centroids of the other folds' examples; centroids of less
than ``SUPPORT`` of the examples go. So neither a few odd examples nor texts like
them widen a language. For texts of fewer than ``ENOUGH`` different n-grams it
falls with the root of their number, as cosines do.

Defined results: a null text or one without a letter (``\\p{L}``) is ``und`` with
score 0, and rejected. If all letters are in tokens with a digit, these count.
Ties go to the first language by name. Without any labelled text all are
``und``. Texts may have any length and are counted whole. Rows with a null key or
label aren't learned from; rows of equal key, text and label are learned once.
Columns with the name of an output are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from auralake.llm.session import append_columns, give_back, materialise

DIM = 8192
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 8
REJECT = 0.5
QUANTILE = 0.01
SUPPORT = 0.02
FOLDS = 4
ENOUGH = 100
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_CODE = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])[A-Za-z\x80-\xff]*+[0-9][0-9A-Za-z\x80-\xff]*+")
_BLANKS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text, all between its words folded to one blank."""
    whole = text.lower().encode("utf-8", "replace")
    words = _CODE.sub(b" ", whole).translate(_BLANKS).split() or whole.translate(_BLANKS).split()
    data = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8).astype(np.uint32)
    total = np.zeros(DIM)
    for at in range(0, len(data), 1 << 20):
        some = data[at : at + (1 << 20) + 2]
        n = min(len(some), 1 << 20)
        two = some[:-1] << 8 | some[1:]
        three = two[:-1] << 8 | some[2:]
        for salt, grams in ((1, some[:n]), (2, two[:n]), (3, three[:n])):
            cell = (grams + np.uint32(salt << 24)) * np.uint32(2654435761) >> np.uint32(19)
            total += np.bincount(cell, minlength=DIM)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


class Centroids:
    """idf weights, unit centroids, and for each centroid its language and cut-off."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, languages: list[str], cutoffs: list[float]):
        self.idf, self.centres, self.languages, self.cutoffs = idf.astype(np.float32), centres.astype(np.float32), languages, cutoffs

    def vector(self, found: np.ndarray) -> np.ndarray:
        weighted = np.log1p(found).astype(np.float32) * self.idf
        return weighted / (np.linalg.norm(weighted) or 1)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine from 0 to 1, rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        found = counts(text)
        cosines = self.centres @ self.vector(found)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, bool(score < self.cutoffs[best] * min(1.0, np.count_nonzero(found) / ENOUGH) ** 0.5)


def _cosines(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Without a matrix library, whose threads would each keep buffers in every worker."""
    return np.einsum("ij,kj->ik", rows, centres)


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means; seeds are far from each other. Those of few rows go."""
    centres = rows[:1]
    for _ in range(min(k, len(rows)) - 1):
        centres = np.vstack([centres, rows[np.argmin(_cosines(rows, centres).max(axis=1))]])
    for _ in range(ROUNDS):
        own = np.argmax(_cosines(rows, centres), axis=1)
        moved = [np.einsum("i,ij->j", (own == j).astype(rows.dtype), rows) if (own == j).any() else c for j, c in enumerate(centres)]
        centres = np.array([m / (np.linalg.norm(m) or 1) for m in moved])
    own = np.bincount(np.argmax(_cosines(rows, centres), axis=1), minlength=len(centres))
    return centres[own >= min(own.max(), SUPPORT * len(rows))]


def _cutoff(rows: np.ndarray) -> float:
    """A share of the low quantile of cosines to centroids that the rows had no part in."""
    if len(rows) < 2 * FOLDS:
        return REJECT * float(np.quantile(_cosines(rows, _cluster(rows, CENTROIDS)).max(axis=1), QUANTILE))
    fold = np.arange(len(rows)) % FOLDS
    least = [_cosines(rows[fold == j], _cluster(rows[fold != j], CENTROIDS)).max(axis=1) for j in range(FOLDS)]
    return REJECT * float(np.quantile(np.concatenate(least), QUANTILE))


def _examples(df: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(label, counts) of at most ``sample`` different rows of each label; written."""
    order = F.xxhash64(F.col(key), F.col(text))
    labelled = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), order.alias("at"), F.col(text).alias("body"))
    # Rows with low hashes, about half as many again as the sample: one narrow scan instead of a sort of all.
    share = F.least(F.lit(1.0), F.lit(1.5 * sample) / F.col("n"))
    low = labelled.groupBy("label").agg(F.approx_count_distinct("at").alias("n")).select("label", (share * 2.0**64 - 2.0**63).alias("low"))
    near = labelled.join(F.broadcast(low), "label").where("cast(at as double) <= low").drop("low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int]] = {}  # rows that repeat leave here, so a hot one isn't shuffled
        for batch in batches:
            for name, at, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = seen.setdefault(name.as_py(), set())
                if at.as_py() not in own:
                    own.add(at.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([at.as_py()]), pa.array([counts(body.as_py()).astype("<f4").tobytes()], pa.binary())], names=["label", "at", "counts"])

    drawn = near.mapInArrow(run, "label string, at long, counts binary").groupBy("label", "at").agg(F.min("counts").alias("counts"))
    ranked = drawn.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("at")))
    return materialise(ranked.where(F.col("nth") <= sample).select("label", "at", "counts"))


def _vectors(table: pa.Table) -> Iterator[np.ndarray]:
    """The count vectors of a label in the order of their hashes."""
    for i in np.argsort(table.column("at").to_numpy()).tolist():
        yield np.frombuffer(table.column("counts")[i].as_py(), "<f4")


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Centroids:
    """Learn from at most ``sample`` rows of each label with letters in the text."""
    examples = _examples(df, key, text, label, sample)

    def frequencies(table: pa.Table) -> pa.Table:
        have = sum((x > 0).astype(np.int64) for x in _vectors(table))
        return pa.table({"cell": pa.array(range(DIM), pa.int64()), "n": pa.array(have, pa.int64()), "rows": pa.array(np.full(DIM, len(table)), pa.int64())})

    held = examples.groupBy("label").applyInArrow(frequencies, "cell long, n long, rows long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    if not held:
        return Centroids(np.ones(DIM), np.zeros((0, DIM)), [], [])
    frequency = np.zeros(DIM)
    frequency[[r["cell"] for r in held]] = [r["n"] for r in held]
    idf = np.log((1 + held[0]["rows"]) / (1 + frequency)) + 0.05
    weigh = Centroids(idf, np.zeros((0, DIM)), [], []).vector

    def cluster(table: pa.Table) -> pa.Table:
        vectors = np.empty((len(table), DIM), np.float32)
        for i, x in enumerate(_vectors(table)):
            vectors[i] = weigh(x)
        found, cutoff = _cluster(vectors, CENTROIDS), _cutoff(vectors)
        del vectors
        give_back()
        columns = [[table.column("label")[0].as_py()] * len(found), range(len(found)), [c.astype("<f4").tobytes() for c in found], [cutoff] * len(found)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.float64()), strict=True)], names=["label", "nth", "centre", "cutoff"])

    rows = sorted(examples.groupBy("label").applyInArrow(cluster, "label string, nth long, centre binary, cutoff double").collect(), key=lambda r: (r["label"], r["nth"]))
    return Centroids(idf, np.stack([np.frombuffer(r["centre"], "<f4") for r in rows]), [r["label"] for r in rows], [r["cutoff"] for r in rows])


def identify(df: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected. The model is broadcast: at most four centroids of 32 kB a label."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def start():
        own = shared.value

        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [own.judge(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            return [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]

        return of

    return append_columns(df, fields, start)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_centroid_langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def recognised(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text is like that of some language."""
    columns = df.columns
    return identify(df, fit(df, key, text, label), text).where(~F.col("rejected")).select(columns)
