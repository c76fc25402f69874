"""Odd inputs and larger tables: results against SQL, and what work and memory grow with."""

import math
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from auralake import plans
from auralake.functions import bits
from auralake.operators import radio, recording, relational, vectors
from auralake.sources import audio

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables written to ``folder``."""
    base = duckdb.connect()
    base.sql("SET timezone = 'UTC'; SET threads = 1")  # sums of one order, so that equal rows tie
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        base.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    want = base.sql(plans.ORACLE_SQL[name])
    order = [df.columns.index(c) for c in want.columns]
    return sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr), sorted(want.fetchall(), key=repr)


def vectors_of(tracks: dict[int, int], seed: int = 0, d: int = 4) -> dict:
    """Embeddings of tracks with so many segments each."""
    ids = [5 * t + s for t, n in tracks.items() for s in range(n)]
    v = np.random.default_rng(seed).normal(size=(len(ids), d)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}


def test_mean_pool_keeps_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    table = {"vec_id": pa.array([0, 5], pa.int64()), "embedding": pa.array([[1.0, -1e-7], [1.0, 1e-7]], pa.list_(pa.float32())), "label": pa.array([0, 0], pa.int32())}
    got, want = against_sql(spark, tmp_path, "a6_m28_mean_pool", embeddings=table)
    assert got == want
    signs = lambda rows: [[math.copysign(1, x) for x in u] for _, u in rows]
    assert signs(got) == signs(want) == [[1, -1], [1, 1]]


@pytest.mark.parametrize("tracks", [{0: 5, 1: 5, 2: 4, 3: 1}, {0: 5, 1: 2, 2: 3, 4: 5, 9: 5}, {0: 5}])
def test_self_consistency_of_short_tracks(spark, tmp_path, tracks):
    got, want = against_sql(spark, tmp_path, "r7_self_consistency", embeddings=vectors_of(tracks))
    assert len(got) == len(tracks) and repr(got) == repr(want)


def parts_of(ids) -> dict:
    ids = [int(i) for i in ids]
    return {"p_partkey": pa.array(ids, pa.int64()), "p_name": [f"n {i % 7}" for i in ids], "p_brand": [f"Brand#{i % 3}" for i in ids]}


def test_neighbours_at_equal_distances(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "o3_r10_neighbours", part=parts_of(range(12000)))
    assert len(got) == 5 * 240 and got == want


@pytest.mark.parametrize("ids", [range(4000), [0], [0, 50], [0, 50, 7, 7]])
def test_distance_ranges_return_one_row_a_query_and_task(spark, tmp_path, ids, monkeypatch):
    monkeypatch.setattr(radio, "BLOCK_QUERIES", 33)
    got, want = against_sql(spark, tmp_path, "j12_pair_distances", part=parts_of(ids))
    assert got == want


@pytest.mark.parametrize("name", ["m12_m13_maxsim_expression", "r3_w9_w10_decide", "r7_rank1_report", "r8_a11_x3_field_test"])
def test_scores_of_equal_and_short_tracks(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_TRACKS", 2)
    table = vectors_of({t: 1 + t % 5 if t % 9 == 4 else 5 for t in range(160)})
    v = vectors_of({t: 5 for t in range(40)}, seed=1)["embedding"].to_pylist()
    table["embedding"] = pa.array([v[i % 200] for i in table["vec_id"].to_pylist()], pa.list_(pa.float32()))  # tracks of equal remainders by 40 are copies
    got, want = against_sql(spark, tmp_path, name, embeddings=table)
    assert got == want


@pytest.mark.parametrize("same", [None, "id % 4", "CASE WHEN id % 3 > 0 THEN id % 5 END"])
def test_leaders_decide_what_all_scores_do(spark, same, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_TRACKS", 5)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-1, 2, size=(i % 3, 3)).astype(float).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, segments array<array<double>>").repartition(4)
    asked = df.where("id % 7 = 0")
    kept = vectors.leaders(asked, df, "id", None if same is None else F.expr(same))
    assert kept.count() <= 2 * 13 * 4
    known = None if same is None else df.selectExpr("id", f"{same} AS same")
    want = vectors.decide(vectors.score_all(asked, df, "id"), "id", known)
    assert sorted(vectors.decide(kept, "id").collect()) == sorted(want.collect())


def documents_of(texts) -> dict:
    """Documents of some texts, with odd ids among them."""
    n = len(texts)
    return {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}


ODD = [None, "", " \t\n", "a b c d", "x " * 90, "x\fy\vz\r\n" * 40, "\U0001f3b5 é"]


def prose(n: int) -> list:
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, rng.integers(1, 300)) % 500) for _ in range(n)]
    texts[50], texts[51], texts[52] = " ".join(f"v{i}" for i in range(120)), " ".join(f"v{i}" for i in range(7, 127)), "pad pad " + texts[100]
    return texts[: n - len(ODD)] + ODD


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name,absent",
    [
        ("j14_shared_halves", ["Exchange", "FileScan", "Join"]),
        ("a4_r5_candidates", ["FileScan", "lambdafunction"]),
        ("m10_m11_r6_alignment", ["posexplode", "lambdafunction"]),
        ("m9_a14_d1_halves", ["lambdafunction"]),
        ("s17_blob_codec", ["lambdafunction"]),
    ],
)
def test_recordings_of_odd_texts(spark, tmp_path, monkeypatch, name, absent):
    for limit, value in (("DENSE_SHARE", 2), ("DENSE_HALVES", 9), ("TILE_RECORDINGS", 7), ("TILE_HALVES", 300), ("CACHED_TOKENS", 5)):
        monkeypatch.setattr(recording, limit, value, raising=False)
    got, want = against_sql(spark, tmp_path, name, documents=documents_of(prose(260)))
    assert got == want
    plan = plan_of(plans.QUERIES[name](spark, str(tmp_path)))
    assert [x for x in absent if x in plan] == []


def test_blobs_of_many_words_take_time_in_proportion(spark):
    words = np.random.default_rng(6).integers(0, 1 << 32, 16000).tolist()
    df = spark.createDataFrame([(words,), ([],), (None,)], "w array<long>")
    through = df.select(bits.unpack_words(bits.pack_words(F.col("w"))).alias("w"))
    through.limit(1).collect()
    began = time.time()
    assert [list(r["w"]) for r in through.collect()] == [words, [], []]
    assert time.time() - began < 20


@pytest.mark.parametrize("name", ["m1_m4_m8_recording_words", "r13_r14_signal_analysis", "m24_m25_noisy_excerpts"])
def test_audio_goes_to_kernels_as_bytes(spark, tmp_path, name):
    """Samples of whole texts as arrays took over 1 GB of a worker."""
    texts = [None, "", "é" * 600] + ["word %d " % i * 500 for i in range(5)]
    if name in plans.ORACLE_SQL:
        got, want = against_sql(spark, tmp_path, name, documents=documents_of(texts))
        assert got == want
    else:
        pq.write_table(pa.table(documents_of(texts)), f"{tmp_path}/documents.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    assert len(df.collect()) == (5 if name.startswith("m24") else 6) and "_unsigned" not in plan_of(df)


def test_decoding_returns_pieces():
    batch = pa.array([b"abcd" * 1000, b"", None] * 4000)
    parts = list(audio._decode.func(iter([batch])))
    assert len(parts) > 3 and max(p.nbytes for p in parts) < 8 << 20
    whole = pa.chunked_array(parts).combine_chunks()
    assert whole.field("reason").to_pylist() == ["OK", "EMPTY", "MISSING"] * 4000
    assert whole.field("samples").value_lengths().to_pylist() == [1000, 0, 0] * 4000


def events_of(n: int, users: int) -> dict:
    rng = np.random.default_rng(7)
    start = np.datetime64("2024-01-01T00:00:00", "us")
    times = start + rng.integers(0, 200 * 3600, n).astype("timedelta64[s]").astype("timedelta64[us]")
    user = [None if u == users else int(u) for u in rng.integers(0, users + 1, n)]
    kinds = np.array(["click", "error", "purchase", "signup", "view"])[rng.integers(0, 5, n)]
    return {"event_id": pa.array(range(n), pa.int64()), "ts": pa.array(times), "user_id": pa.array(user, pa.int64()), "event_type": kinds.tolist(), "value": rng.integers(0, 1000, n) / 8, "props": ["{}"] * n}


def test_autocorrelation_joins_and_broadcasts_nothing(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "w5_autocorrelation", events=events_of(3000, 6))
    known = [r for r in want if r[0] is not None]
    assert got == known and len(got) == 6 * 22
    plan = plan_of(plans.QUERIES["w5_autocorrelation"](spark, str(tmp_path)))
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("ids", [None, [1, 1, 2, 2, 3, 4, 5, None, None]])
def test_tokens_are_counted_where_texts_lie(spark, tmp_path, ids):
    table = documents_of(["b a b", "C c", "x", None, "", "é e Z9", "..", "q", "q r"])
    if ids:
        table["doc_id"] = pa.array(ids, pa.int64())
    got, want = against_sql(spark, tmp_path, "t2_tokens", documents=table)
    assert got == want
    plan = plan_of(plans.QUERIES["t2_tokens"](spark, str(tmp_path)))
    assert ids or "hashpartitioning" not in plan


def test_pairs_of_a_large_group_are_made_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relational, "PAIR_ROWS", 16, raising=False)
    table = parts_of(range(400))
    table["p_brand"] = [None if i % 40 == 7 else f"Brand#{i % 40 // 39}" for i in range(400)]
    table["p_name"] = ["one name"] * 350 + [f"n {i // 2}" for i in range(50)]
    got, want = against_sql(spark, tmp_path, "r10_x1_duplicate_titles", part=table)
    assert len(got) > 50000 and got == want
    plan = plan_of(plans.QUERIES["r10_x1_duplicate_titles"](spark, str(tmp_path)))
    assert "REPARTITION_BY_NUM" in plan and "_part" in plan


@pytest.mark.parametrize("block", [3, 1024])
def test_duplicates_meet_in_parts(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_TRACKS", block)
    monkeypatch.setattr(vectors, "TILE_TRACKS", 2)
    table = vectors_of({t: 1 + t % 5 if t % 9 == 4 else 5 for t in range(150)}, d=16)
    got, want = against_sql(spark, tmp_path, "r4_m14_embedding_duplicates", embeddings=table)
    assert len(got) > 100 and got == want
    plan = plan_of(plans.QUERIES["r4_m14_embedding_duplicates"](spark, str(tmp_path)))
    assert "lambdafunction(aggregate" not in plan and "FlatMapGroupsInArrow" in plan


def test_maxsim_of_all_tracks_is_a_matrix_product(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "m12_m13_maxsim_expression", embeddings=vectors_of({t: 5 for t in range(60)}))
    plan = plan_of(plans.QUERIES["m12_m13_maxsim_expression"](spark, str(tmp_path)))
    assert got == want and "MapInArrow" in plan and "zip_with" not in plan
