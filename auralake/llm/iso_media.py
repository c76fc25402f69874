"""Media columns: ISO base media containers in a binary column.

``encode_media`` stores a payload losslessly as 8-bit grey frames of 8 x 8
samples in an ISO container; ``probe_media`` walks the nested boxes of any such
container, decodes the sample tables and returns codec, duration and the byte
ranges of the keyframes without touching the payload; ``read_payload`` gathers
the samples again by those tables.

Defined results: a null payload is stored as the empty one, which is padded to
one frame of zeros. Payloads of 2 GiB and more get 64-bit boxes and offsets. A
null, empty or broken container gives null facts and a reason in ``error``;
nothing raises, and no table is expanded beyond the samples that the file can
hold. Samples in fragments (``moof``) aren't read, which is such a reason. Rows
are independent, so ties, repeated rows and empty tables need no rule. A column
that has the name of an output is replaced by it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.session import append_columns

FRAME = 64
TIMESCALE = 25
KEYFRAME_EVERY = 25
FRAMES_PER_CHUNK = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}

KEYFRAMES = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())]))
FACTS = [
    T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("keyframes", KEYFRAMES),
    T.StructField("error", T.StringType()),
]


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def _full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_STSD = _full(
    b"stsd",
    struct.pack(">I", 1),
    _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)),
)
_HDLR = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0")
_VMHD = _full(b"vmhd", bytes(8), flags=1)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the frame size."""
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def mux(payload: bytes) -> bytes:
    """A container of one raw grey track that holds ``payload``, a whole number of frames."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    rest = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK)] if rest == FRAMES_PER_CHUNK else [(1, rest)] if chunks == 1 else [(1, FRAMES_PER_CHUNK), (chunks, rest)]
    keys = np.arange(1, frames + 1, KEYFRAME_EVERY, dtype=">u4")
    wide = len(payload) >= 1 << 31

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (FRAME * FRAMES_PER_CHUNK)
        stbl = _box(
            b"stbl",
            _STSD,
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", first, each, 1) for first, each in runs]),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        trak = _box(
            b"trak",
            _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), _UNITY, struct.pack(">II", 8 << 16, 8 << 16), flags=3),
            _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _HDLR, _box(b"minf", _VMHD, _DINF, stbl)),
        )
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2)), trak)

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    base = len(_FTYP) + len(moov(0)) + len(head)
    return b"".join((_FTYP, moov(base), head, payload))


def boxes(data: bytes, at: int, end: int):
    """(kind, start of body, end of body) of the boxes in a range; ValueError if one is cut short."""
    while at < end:
        if at + 8 > end:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("truncated large box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} exceeds its parent")
        yield kind, at + head, at + size
        at += size


def tracks(data: bytes) -> list[dict]:
    """One dict per track: body ranges of the boxes below it, by kind."""
    found: list[dict] = []
    todo = [(0, len(data), None)]
    while todo:
        at, end, track = todo.pop()
        for kind, start, stop in boxes(data, at, end):
            into = track
            if kind == b"trak":
                into = {}
                found.append(into)
            elif into is not None:
                into.setdefault(kind, (start, stop))
            if kind in CONTAINERS:
                todo.append((start, stop, into))
    return found


def _numbers(data: bytes, span: tuple[int, int], skip: int, count: int, kind: str) -> np.ndarray:
    start, stop = span
    width = np.dtype(kind).itemsize
    if start + skip + count * width > stop:
        raise ValueError("sample table is cut short")
    return np.frombuffer(data, kind, count, start + skip).astype(np.int64)


def _sizes(data: bytes, track: dict) -> np.ndarray:
    """Bytes of every sample, from ``stsz`` or the compact ``stz2``."""
    if b"stsz" in track:
        uniform, n = struct.unpack_from(">II", data, track[b"stsz"][0] + 4)
        if not uniform:
            return _numbers(data, track[b"stsz"], 12, n, ">u4")
        if n > len(data) // uniform:
            raise ValueError("sample table exceeds the file")
        return np.full(n, uniform, np.int64)
    width, n = struct.unpack_from(">3xBI", data, track[b"stz2"][0] + 4)
    if width == 4:
        pairs = _numbers(data, track[b"stz2"], 12, (n + 1) // 2, "u1")
        return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]
    if width not in (8, 16):
        raise ValueError(f"sample sizes of {width} bits")
    return _numbers(data, track[b"stz2"], 12, n, ">u1" if width == 8 else ">u2")


def sample_table(data: bytes, track: dict) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and size of every sample of a track."""
    sizes = _sizes(data, track)
    n = len(sizes)
    kind = b"co64" if b"co64" in track else b"stco"
    chunks = struct.unpack_from(">I", data, track[kind][0] + 4)[0]
    at = _numbers(data, track[kind], 8, chunks, ">u8" if kind == b"co64" else ">u4")
    if chunks and (int(at.min()) < 0 or int(at.max()) > len(data)):
        raise ValueError("a chunk lies beyond the file")
    runs = struct.unpack_from(">I", data, track[b"stsc"][0] + 4)[0]
    table = _numbers(data, track[b"stsc"], 8, 3 * runs, ">u4").reshape(-1, 3)
    # A run lasts to the first chunk of the next; the file's own chunks bound them all.
    first = np.minimum(table[:, 0], chunks + 1)
    if runs and (first[0] != 1 or (np.diff(first) < 0).any()):
        raise ValueError("chunk runs are out of order")
    per_chunk = np.repeat(table[:, 1], np.diff(np.append(first, chunks + 1)))
    if int(per_chunk.sum()) != n:
        raise ValueError("chunk table and sample sizes disagree")
    ends = np.cumsum(sizes)
    firsts = np.cumsum(per_chunk) - per_chunk
    before = np.where(firsts > 0, ends[np.maximum(firsts - 1, 0)], 0) if n else firsts
    offsets = (ends - sizes) + np.repeat(at - before, per_chunk)
    if n and int((offsets + sizes).max()) > len(data):
        raise ValueError("a sample lies beyond the file")
    return offsets, sizes


def probe(data: bytes | None) -> dict:
    """Codec, timescale, duration, sample count and keyframe byte ranges of the first track."""
    out = dict.fromkeys(("codec", "timescale", "duration", "n_samples", "keyframes", "error"))
    if not data:
        return out | {"error": "no data"}
    try:
        track = next((t for t in tracks(data) if b"stsz" in t or b"stz2" in t), None)
        if track is None:
            return out | {"error": "samples in fragments" if any(kind == b"moof" for kind, *_ in boxes(data, 0, len(data))) else "no track"}
        start, _ = track[b"mdhd"]
        scale, length = struct.unpack_from(">IQ", data, start + 20) if data[start] else struct.unpack_from(">II", data, start + 12)
        entry = track[b"stsd"][0] + 8
        runs = struct.unpack_from(">I", data, track[b"stts"][0] + 4)[0]
        times = _numbers(data, track[b"stts"], 8, 2 * runs, ">u4").reshape(-1, 2)
        offsets, sizes = sample_table(data, track)
        if b"stss" in track:
            keys = _numbers(data, track[b"stss"], 8, struct.unpack_from(">I", data, track[b"stss"][0] + 4)[0], ">u4") - 1
            if len(keys) and (keys.min() < 0 or keys.max() >= len(offsets)):
                raise ValueError("a keyframe has no sample")
        else:
            keys = np.arange(len(offsets))
        return out | {
            "codec": data[entry + 4 : entry + 8].decode("latin-1"),
            "timescale": scale,
            "duration": int((times[:, 0] * times[:, 1]).sum()) or length,
            "n_samples": len(offsets),
            "keyframes": [{"offset": int(o), "size": int(s)} for o, s in zip(offsets[keys], sizes[keys], strict=True)],
        }
    except (ValueError, KeyError, IndexError, struct.error) as broken:
        return out | {"error": str(broken) if isinstance(broken, ValueError) else f"missing or short table: {broken}"}


def demux(data: bytes | None) -> bytes | None:
    """The samples of the first track in order; None if the tables can't be read."""
    if not data:
        return None
    try:
        track = next((t for t in tracks(data) if b"stsz" in t or b"stz2" in t), None)
        if track is None:
            return None
        offsets, sizes = sample_table(data, track)
    except (ValueError, KeyError, IndexError, struct.error):
        return None
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, len(offsets)) - 1
    return b"".join(data[int(offsets[a]) : int(offsets[b] + sizes[b])] for a, b in zip(firsts, lasts, strict=True))


def encode_media(df: DataFrame, payload: str, into: str = "media") -> DataFrame:
    """Add a container of the text or binary column ``payload``, zero-padded to whole frames."""

    def start():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(payload)).cast(pa.large_binary())
            return [pa.array([mux(pad(x.as_py() or b"")) for x in column], pa.binary())]

        return of

    return append_columns(df, [T.StructField(into, T.BinaryType())], start)


def probe_media(df: DataFrame, media: str = "media", payload: str | None = None) -> DataFrame:
    """Add the facts of each container, and its payload read back if a name for it is given."""
    fields = [*FACTS, *([T.StructField(payload, T.BinaryType())] if payload else [])]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.string()]

    def start():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            stored = [x.as_py() for x in batch.column(batch.schema.get_field_index(media))]
            facts = [probe(x) for x in stored]
            columns = [pa.array([f[k.name] for f in facts], kind) for k, kind in zip(FACTS, kinds, strict=True)]
            return [*columns, pa.array([demux(x) for x in stored], pa.binary())] if payload else columns

        return of

    return append_columns(df, fields, start)


def feature_text() -> Column:
    """The facts as one canonical string."""
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat(k["offset"].cast("string"), F.lit("+"), k["size"].cast("string"))), ",")
    return F.concat_ws("/", F.trim("codec"), F.concat("duration", F.lit(":"), "timescale"), F.col("n_samples").cast("string"), ranges)


def op1_iso_media(spark, sf_dir: str) -> DataFrame:
    """Every document as a container: digests of the payload read back and of the stored form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    probed = probe_media(encode_media(sized, "text").select("doc_id", "n_bytes", "media"), payload="payload")
    return probed.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature_text().alias("feature"),
    )
