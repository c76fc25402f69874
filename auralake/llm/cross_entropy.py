"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents, share
one vocabulary and one smoothing; a document's score is its cross-entropy under
the target less that under the background, in nats a token (Moore and Lewis,
2010): the lower, the more like the target.

    p(w | v) = (n(v w) + MU p(w)) / (n(v) + MU),   p(w) = (n(w) + 1) / (N + V)

A document is START, its words, END; words and END are predicted. N counts
predictions, V is the number of different words, END included, in all documents.
A document that is scored is left out of the models that it was counted in: its
own counts are taken off first, so that a word that only this document holds is
as unknown to one model as to the other.

Counts are exact and never meet in one place. Documents are gathered into blocks
of bounded size. A block sends its distinct grams with their counts, sorted by a
64-bit hash and cut by ranges of it, as packed strings to buckets; a bucket adds
them up and answers each block with the totals of the grams that it asked for;
then blocks score their documents. So both models grow with the corpus, a gram
of any frequency is one entry of each block, and no task holds more than a block
or a bucket. Buckets are ``4 x spark.sql.shuffle.partitions``. Nothing comes to the
driver.

Defined results: a null or blank text has no tokens and null scores. Rows that
repeat count each and repeat their scores. A very long text is a block of its own. A document is a target if its label
is; null keys and labels of no document are no targets, and repeated labels
count once. Without targets the target model is uniform and scores stay defined.
An empty table gives an empty one. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.session import materialise

MU = 50.0
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Words never hold white space, so these hashes are no word's.
SHORTER = np.uint64(8)
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) >> SHORTER | np.uint64(1) for x in (b"<start> ", b"<end> "))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers by their place, which lie close for small ones."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()


class Grams:
    """The words and word pairs of a block: sorted distinct hashes, and where each token's are."""

    def __init__(self, texts: list[bytes | None]):
        parts, sizes = [], []
        for text in texts:
            found = (text or b"").split()
            sizes.append(len(found))
            if found:
                parts += [[int(START << SHORTER)], map(xxhash.xxh3_64_intdigest, found), [int(END << SHORTER)]]
        self.sizes = np.array(sizes, np.int64)
        spans = np.where(self.sizes > 0, self.sizes + 2, 0)
        one = np.fromiter(chain.from_iterable(parts), np.uint64, int(spans.sum())) >> SHORTER | np.uint64(1)
        # Odd hashes are words, even ones are pairs; a pair stands at its second word.
        two = one.copy()
        two[1:] = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        two ^= two >> np.uint64(29)
        two = two >> SHORTER & ~np.uint64(1)
        self.doc = np.repeat(np.arange(len(sizes)), spans)
        self.predicted = np.ones(len(one), bool)
        self.predicted[(np.cumsum(spans) - spans)[spans > 0]] = False
        pairs = two[self.predicted]
        self.distinct, place = np.unique(np.concatenate([one, pairs]), return_inverse=True)
        self.word = place[: len(one)]
        self.pair = place[len(one) :]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each distinct gram occurs in the chosen documents."""
        pick = chosen[self.doc]
        n = len(self.distinct)
        return np.bincount(self.word[pick], minlength=n) + np.bincount(self.pair[pick[self.predicted]], minlength=n)

    def own(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each token how often its gram occurs in its own document."""
        _, inverse, times = np.unique(doc * np.int64(len(self.distinct) + 1) + place, return_inverse=True, return_counts=True)
        return times[inverse]

    def losses(self, totals: np.ndarray, predictions: np.ndarray, vocabulary: int) -> np.ndarray:
        """Mean loss of each document: rows target, target less the document, background less the document."""
        doc, words_ = self.doc[self.predicted], self.word[self.predicted]
        before = self.word[np.flatnonzero(self.predicted) - 1]
        own_word, own_pair = self.own(self.word, self.doc), self.own(self.pair, doc)
        own_before = own_word[np.flatnonzero(self.predicted) - 1]
        own_word = own_word[self.predicted]
        length = self.sizes[doc] + 1
        out = np.full((3, len(self.sizes)), np.nan)
        held = self.sizes > 0
        for row, (model, less) in enumerate(((0, 0), (0, 1), (1, 1))):
            n = totals[model].astype(np.float64)
            # A document that isn't a target was never counted there; what leaving it out would give isn't used.
            take = lambda place, own: np.maximum(n[place] - less * own, 0)  # noqa: B023, E731
            alone = (take(words_, own_word) + 1) / (np.maximum(predictions[model] - less * length, 0) + vocabulary)
            loss = -np.log((take(self.pair, own_pair) + MU * alone) / (take(before, own_before) + MU))
            out[row, held] = np.bincount(doc, loss, len(self.sizes))[held] / (self.sizes[held] + 1)
        return out


def _blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """(block, keys, texts, raw): documents by the block, their lower-cased texts packed, raw bytes before; lengths of -1 stand for null."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("texts", T.BinaryType()), T.StructField("raw", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, held, size, count = zstandard.ZstdCompressor(level=3), [], 0, TaskContext.get().partitionId() << 32
        kind = None

        def block(number: int) -> pa.RecordBatch:
            keys, texts = zip(*held, strict=True)
            lengths = np.array([-1 if t is None else len(t) for t in texts], "<i8")
            body = squeeze.compress(lengths.tobytes() + b"".join(t or b"" for t in texts))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([list(keys)], pa.list_(kind)), pa.array([body], pa.binary()), pa.array([int(lengths.clip(0).sum())])], names=schema.fieldNames())

        for batch in batches:
            kind = batch.column(0).type
            for at in range(batch.num_rows):
                value = batch.column(1)[at].as_py()
                data = None if value is None else value.lower().encode("utf-8", "replace")
                held.append((batch.column(0)[at].as_py(), data))
                size += len(data or b"") + 64
                if size >= block_bytes:
                    yield block(count)
                    held, size, count = [], 0, count + 1
        if held:
            yield block(count)

    return docs.select(key, text).mapInArrow(run, schema)


def _texts(body: bytes, n: int) -> list[bytes | None]:
    data = zstandard.ZstdDecompressor().decompress(body)
    lengths = np.frombuffer(data, "<i8", n)
    ends = (8 * n + np.cumsum(np.maximum(lengths, 0))).tolist()
    return [None if size < 0 else data[end - size : end] for size, end in zip(lengths.tolist(), ends, strict=True)]


def _asked(marked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, n, body): the distinct grams of each block with their counts, by ranges of their hashes."""
    edges = np.array([(k << 56) // buckets for k in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, texts, targets, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), pc.list_value_length(batch.column(1)).to_pylist(), strict=True):
                grams = Grams(_texts(texts, size))
                target = np.zeros(size, bool)
                target[targets or []] = True
                every, good = grams.counts(np.ones(size, bool)), grams.counts(target)
                cuts = [0, *np.searchsorted(grams.distinct, edges).tolist(), len(grams.distinct)]
                rows = []
                for bucket, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a == b:
                        continue
                    gaps = np.diff(grams.distinct[a:b], prepend=np.uint64(0))
                    rows.append((bucket, block, b - a, squeeze.compress(_planes(gaps) + _planes(every[a:b]) + _planes(good[a:b]))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "n", "body"])

    return marked.select("block", "keys", "texts", "targets").mapInArrow(run, "bucket long, block long, n long, body binary")


ANSWER = "block long, bucket long, n long, body binary, words long, target long, background long"


def _answer(messages: pa.Table) -> pa.Table:
    """For each block's message the totals of its grams; the first also says what the bucket adds to the vocabulary and to both models."""
    open_, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    sizes = messages.column("n").to_pylist()
    grams, every, good = [], [], []
    for n, body in zip(sizes, messages.column("body").to_pylist(), strict=True):
        data = open_.decompress(body)
        grams.append(np.cumsum(_unplanes(data, n), dtype=np.uint64))
        every.append(_unplanes(data[8 * n :], n))
        good.append(_unplanes(data[16 * n :], n))
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = [np.bincount(place, np.concatenate(x), len(distinct)).astype(np.int64) for x in (good, every)]
    cuts = np.cumsum([0, *sizes]).tolist()
    bodies = [squeeze.compress(b"".join(_planes(t[place[a:b]]) for t in total)) for a, b in zip(cuts, cuts[1:], strict=False)]
    predicted = (distinct & np.uint64(1)).astype(bool) & (distinct != START)
    sums = [int(predicted.sum()), *(int(t[predicted].sum()) for t in total)]
    columns = [messages.column("block"), messages.column("bucket"), messages.column("n"), pa.array(bodies, pa.binary()), *(pa.array([x, *[0] * (len(sizes) - 1)], pa.int64()) for x in sums)]
    return pa.table(columns, names=["block", "bucket", "n", "body", "words", "target", "background"])


def _score(key: str, kind: T.DataType):
    """Scores a block's documents by the answers that it got; (key, n_tokens, ce_target, ce_left_out, ce_background)."""
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("ce_target", "ce_left_out", "ce_background"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(batch.num_rows):
                keys, texts, told = (batch.column(i).slice(at, 1) for i in range(3))
                keys, told = keys.flatten(), told.flatten()
                words_, target, background = (x or 0 for x in batch.column(3)[at].as_py())
                grams = Grams(_texts(texts[0].as_py(), len(keys)))
                totals, done = np.zeros((2, len(grams.distinct)), np.int64), 0
                for _, n, body in sorted(zip(*(told.field(c).to_pylist() for c in ("bucket", "n", "body")), strict=True)):
                    data = open_.decompress(body)
                    totals[0, done : done + n], totals[1, done : done + n] = _unplanes(data, n), _unplanes(data[8 * n :], n)
                    done += n
                found = grams.losses(totals, (target, background), words_)
                yield pa.RecordBatch.from_arrays([keys, pa.array(grams.sizes), *(pa.array(x, mask=np.isnan(x)) for x in found)], names=schema.fieldNames())

    return run, schema


def score_documents(docs: DataFrame, labels: DataFrame, chosen, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_tokens, ce_target, ce_background, ce_difference) of every row, each left out of the models that it is in."""
    hits = labels.where(chosen).where(F.col(key).isNotNull()).select(key).distinct()
    # Block numbers must not change once they are given, so the blocks are written.
    blocks = materialise(_blocks(docs, key, text, block_bytes))
    buckets = -(-(blocks.agg(F.sum("raw")).first()[0] or 1) // bucket_bytes)
    placed = blocks.select("block", F.posexplode("keys").alias("at", key))
    targets = placed.join(hits.hint("merge"), key, "left_semi").groupBy("block").agg(F.collect_list("at").alias("targets"))
    marked = blocks.join(targets.hint("merge"), "block", "left")
    answers = _asked(marked, buckets).groupBy("bucket").applyInArrow(_answer, ANSWER)
    told = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "body")).alias("told"))
    sums = answers.agg(F.array(F.sum("words"), F.sum("target"), F.sum("background"))).scalar()
    scored = blocks.join(told.hint("merge"), "block", "left").select("keys", "texts", "told", sums.alias("sums")).mapInArrow(*_score(key, docs.schema[key].dataType))
    # Labels grow with the documents, so neither side is broadcast, whatever its size.
    flagged = scored.join(hits.withColumn("_target", F.lit(True)).hint("merge"), key, "left")
    target = F.when(F.col("_target"), F.col("ce_left_out")).otherwise(F.col("ce_target"))
    return flagged.select(key, "n_tokens", target.alias("ce_target"), "ce_background", (target - F.col("ce_background")).alias("ce_difference"))


def op8_cross_entropy(spark, sf_dir: str) -> DataFrame:
    """Every document's loss difference between the good documents and all."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_documents(docs, labels, F.col("quality") == 1)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "ce_difference")))
