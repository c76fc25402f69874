"""Relational operators, stores and jobs on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from auralake.functions import bits
from auralake.operators import jobs, maintenance, recording, relational
from auralake.sources.tables import SCHEMAS

TRACKS = [("t1", "NAVIDROME", "First", "Artist A", 180000), ("t2", "YTMUSIC", "Second", "Artist B", 200000), ("t3", "YTMUSIC", "Third", "Artist C", 240000)]


@pytest.fixture()
def store(spark, tmp_path):
    s = maintenance.Store(spark, f"file://{tmp_path}/store")
    s.publish("tracks", spark.createDataFrame(TRACKS, "id string, source string, title string, artist string, durationMs long"))
    return s


def pending(store):
    done = lambda name: store.read(name, SCHEMAS[name]).withColumnRenamed("trackId", "id")
    stages = {"landmarks": done("fingerprints"), "features": done("track_features").where("version = 1"), "recording": done("recording_fingerprints")}
    return {r["id"]: (r["landmarks"], r["features"], r["recording"]) for r in relational.pending_work(store.read("tracks"), stages).collect()}


SIX = {"tempo": 0.5, "energy": 0.8, "brightness": 0.4, "danceability": 0.6, "key_x": 0.7, "key_y": -0.2}
ANALYSED = "track_id string, duration_ms long, landmarks array<struct<hash int, anchor_frame int>>, words array<long>, features struct<tempo double, energy double, brightness double, danceability double, key_x double, key_y double>"


def test_index_run_from_empty_to_complete(spark, store):
    assert pending(store) == {k: (True, True, True) for k in ("t1", "t2", "t3")}
    batch = spark.createDataFrame([("t1", 180000, [(123, 0), (456, 4)], [0x11112222, 0x33334444, 0xAAAABBBB], SIX), ("t2", 200000, [(789, 1)], [], SIX)], ANALYSED)
    told = {r["table"]: r["rows"] for r in jobs.write_batch(store, batch, 1, 5).collect()}
    assert told == {"fingerprints": 3, "track_features": 2, "recording_fingerprints": 1, "recording_sub_hashes": 6}
    assert pending(store) == {"t2": (False, False, True), "t3": (True, True, True)}
    jobs.write_batch(store, batch, 1, 6)
    assert store.read("fingerprints").count() == 3 and store.read("recording_sub_hashes").count() == 6
    again = spark.createDataFrame([("t1", 180000, [], [0xF00DBEEF], None)], ANALYSED)
    jobs.write_batch(store, again, 1, 7)
    assert {r["half"] for r in store.read("recording_sub_hashes").collect()} == {0xBEEF, 0xF00D + 65536}
    assert store.read("track_features").count() == 2
    assert pending(store)["t3"] == (True, True, True)


def test_backfill_writes_once(spark, store):
    rows = [("t1", [1, 2]), ("t2", [0x11112222, 0x33334444, 0xAAAABBBB])]
    recs = spark.createDataFrame(rows, "trackId string, w array<long>").select("trackId", bits.pack_words(F.col("w")).alias("subHashes"), F.lit(1).cast("long").alias("durationMs"), F.lit(1).cast("long").alias("computedAt"))
    store.publish("recording_fingerprints", recs)
    store.publish("recording_sub_hashes", spark.createDataFrame([(1, "t1"), (65536, "t1"), (2, "t1")], SCHEMAS["recording_sub_hashes"]))
    gap = lambda: tuple(relational.gap(store.read("recording_fingerprints"), store.read("recording_sub_hashes"), "trackId").first())
    assert gap() == (2, 1)
    assert jobs.backfill_halves(store) == 6 and gap() == (2, 0) and jobs.backfill_halves(store) == 0


def test_null_keys_hide_nothing(spark, store):
    done = spark.createDataFrame([("ghost",), (None,)], "id string")
    assert relational.pending_work(store.read("tracks"), {"f": done}).count() == 3
    assert relational.missing(store.read("tracks"), done).count() == 3
    assert relational.pending_work(store.read("tracks"), {"f": False}).count() == 0
    assert relational.pending_work(store.read("tracks"), {"f": True}).count() == 3


def test_user_data_of_the_phone_wins(spark, tmp_path):
    desk, phone = (maintenance.Store(spark, f"file://{tmp_path}/{n}") for n in ("desk", "phone"))
    schema = "id string, title string, isLiked int, playCount int"
    phone.publish("tracks", spark.createDataFrame([("a", "x", 1, 7), ("b", "x", 1, 3), ("phone-only", "x", 0, None)], schema))
    desk.publish("tracks", spark.createDataFrame([("a", "A", 0, 0), ("b", "B", 0, 9), ("c", "C", 0, 1)], schema))
    phone.publish("history", spark.createDataFrame([(1,), (2,)], "id long"))
    desk.publish("history", spark.createDataFrame([(9,)], "id long"))
    told = {r["what"]: r["rows"] for r in maintenance.merge_user_data(desk, phone).collect()}
    assert told == {"tracks_only_on_phone": 1, "tracks_matched": 2, "history": 2}
    assert {r["id"]: (r["title"], r["isLiked"], r["playCount"]) for r in desk.read("tracks").collect()} == {"a": ("A", 1, 7), "b": ("B", 1, 3), "c": ("C", 0, 1)}
    assert sorted(r["id"] for r in desk.read("history").collect()) == [1, 2]
    assert desk.tables() == ["history", "tracks"] and desk.drop("history") and not desk.exists("history")


def test_reset_keeps_what_cannot_be_rebuilt(spark, store):
    store.publish("fingerprints", spark.createDataFrame([(1, "t1", 0)] * 5, SCHEMAS["fingerprints"]))
    store.publish("track_features", spark.createDataFrame([("t1",)], "trackId string"))
    assert [tuple(r) for r in maintenance.reset_derived(store, keep=["track_features"]).collect()] == [("fingerprints", 5)]
    assert store.read("fingerprints").count() == 0 and store.read("track_features").count() == 1 and store.read("tracks").count() == 3


class Stopped(Exception):
    pass


# Four folders are written, then the commit file, then it is moved, then old folders go.
@pytest.mark.parametrize("step", [2, 4, 5, 6])
def test_a_stop_at_any_step_keeps_all_old_or_all_new_rows(spark, store, step):
    """A batch of four tables, stopped after so many file operations, then done again."""
    first = spark.createDataFrame([("t1", 1, [(123, 0), (456, 4)], [0x11112222, 0x33334444], SIX)], ANALYSED)
    jobs.write_batch(store, first, 1, 5)
    names = ("fingerprints", "track_features", "recording_fingerprints", "recording_sub_hashes")
    rows = lambda: tuple(store.read(n).count() for n in names)
    old = rows()
    more = spark.createDataFrame([("t2", 1, [(5, 0)], [0x77778888], SIX), ("t1", 1, [(123, 0), (9, 9)], [0xF00DBEEF], None)], ANALYSED)
    count, real, write = [0], store._fs, store.write

    def counted(f):
        def run(*args):
            count[0] += 1
            if count[0] > step:
                raise Stopped
            return f(*args)

        return run

    class Files:
        def __getattr__(self, name):
            return getattr(real, name)

    files = Files()
    for n in ("create", "rename", "delete"):
        setattr(files, n, counted(getattr(real, n)))
    store._fs, store.write = files, counted(write)
    try:
        jobs.write_batch(store, more, 1, 6)
    except Stopped:
        pass
    store._fs, store.write = real, write
    assert rows() in (old, (4, 2, 2, 4))
    jobs.write_batch(store, more, 1, 7)
    assert rows() == (4, 2, 2, 4) and store.read("tracks").count() == 3
    again = {r["table"]: r["rows"] for r in jobs.write_batch(store, more, 1, 8).collect()}
    assert again["fingerprints"] == 0 and rows() == (4, 2, 2, 4)


def test_two_writers_cannot_take_one_commit(spark, store):
    other = maintenance.Store(spark, store.root)
    folder, _ = other.write("tracks", other.read("tracks").limit(1))
    taken = store._commits()
    store.publish("x", spark.range(3))
    other._commits = lambda: taken
    with pytest.raises(RuntimeError):
        other.commit({"tracks": folder})
    assert store.read("tracks").count() == 3 and store.ensure("y", "a int") and not store.ensure("x", "a int")


def test_repair_and_rewrite_tell_what_they_did(spark, store, tmp_path):
    marks = spark.createDataFrame([(i, "t1", i % 7) for i in range(500)], SCHEMAS["fingerprints"])
    store.publish("fingerprints", marks.unionByName(marks).repartition(4))
    assert maintenance.rewrite_table(store, "fingerprints", ["hash"], ["hash", "trackId", "anchorFrame"]) == 500
    store.publish("fingerprints", marks.repartition(4))
    file = sorted((tmp_path / "store" / store.path("fingerprints").rsplit("/", 1)[1]).glob("part-*.parquet"))[0]
    file.write_bytes(b"not parquet at all")
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    told = maintenance.repair(store, "fingerprints", SCHEMAS["fingerprints"], ["hash", "trackId", "anchorFrame"]).first()
    assert told["files"] == 4 and told["unreadable"] == 1 and 300 <= told["recovered"] < 500 and store.read("fingerprints").count() == told["recovered"]


def test_recovery_skips_damaged_files(spark, tmp_path):
    spark.createDataFrame([(i, "t1", i % 7) for i in range(500)], SCHEMAS["fingerprints"]).repartition(4).write.parquet(f"{tmp_path}/marks")
    files = sorted((tmp_path / "marks").glob("part-*.parquet"))
    files[0].write_bytes(b"not parquet at all")
    (tmp_path / "marks" / f".{files[0].name}.crc").unlink(missing_ok=True)
    found = maintenance.recover(spark, f"{tmp_path}/marks", SCHEMAS["fingerprints"], ["hash", "trackId", "anchorFrame"]).count()
    assert 300 <= found < 500


def test_integrity_and_counts(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, None, None), (3, "c", 9)], "id int, name string, parent int")
    got = {r["problem"]: r["rows"] for r in maintenance.integrity(df, "t", ["id"], ["name"], {"parent": spark.createDataFrame([(5,), (6,)], "p int")}).collect()}
    assert got == {"repeated key": 1, "null in a required column": 1, "parent refers to nothing": 1}
    assert {r["table"]: r["rows"] for r in maintenance.counts({"a": df, "b": None}).collect()} == {"a": 4, "b": None}


@pytest.mark.parametrize("width", [0, 1, 7, 100])
def test_band_join_is_a_range_join(spark, width):
    rng = random.Random(width)
    rows = [(i, rng.choice([rng.randint(-50, 300), 7])) for i in range(120)] + [(500, None), (None, 7)]
    got = sorted((min(r["a"], r["b"]), max(r["a"], r["b"]), r["gap"]) for r in relational.band_join(spark.createDataFrame(rows, "id int, v int"), "id", "v", width).collect())
    known = [(i, v) for i, v in rows if i is not None and v is not None]
    assert got == sorted((min(i, j), max(i, j), abs(v - w)) for (i, v), (j, w) in itertools.combinations(known, 2) if abs(v - w) <= width)


def test_maintained_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(relational.upsert(old, new, ["k"], "v")) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(relational.insert_ignore(old, new, ["k"], "v")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(relational.replace_children(old, new, "k")) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    patch = spark.createDataFrame([(1, None)], "k int, v string")
    assert [tuple(r) for r in relational.overwrite_columns(old, patch, "k", ["v"]).orderBy("k").collect()] == [(1, None), (2, "b")]


def test_halves_and_blobs(spark):
    rows = [([0x00010002, 0xABCD1234, 0],), ([0x11112222] * 50,), ([0x000000FF],), ([0x00FF0000],), ([],)]
    got = [set(r["h"]) for r in spark.createDataFrame(rows, "w array<long>").select(bits.halves(F.col("w")).alias("h")).collect()]
    assert got == [{2, 1 + 65536, 0x1234, 0xABCD + 65536, 0, 65536}, {0x2222, 0x1111 + 65536}, {255, 65536}, {0, 255 + 65536}, set()]
    blobs = spark.createDataFrame([(bytearray(b"\x12\x34\x56\x78"),), (bytearray(b"abc"),), (bytearray(),), (None,)], "b binary")
    assert [list(r["w"]) for r in blobs.select(bits.unpack_words(F.col("b")).alias("w")).collect()] == [[0x12345678], [], [], []]


def test_alignment_finds_a_shift(spark):
    rng = random.Random(6)
    a = [rng.getrandbits(32) for _ in range(300)]
    b = [x ^ 1 if i % 10 == 0 else x for i, x in enumerate(a[37:])]
    other = [rng.getrandbits(32) for _ in range(300)]
    df = spark.createDataFrame([(1, a), (2, b), (3, other), (4, [])], "id int, words array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4)], "a int, b int")
    got = {(r["a"], r["b"]): (r["similarity"], r["offset"]) for r in recording.align(pairs, df, "id", "words").collect()}
    assert got[1, 2] == (pytest.approx(1 - 27 / (263 * 32)), 37) and got[2, 1] == (pytest.approx(1 - 27 / (263 * 32)), -37)
    assert got[1, 3] == (0.0, 0) and got[1, 4] == (0.0, 0)
    before = pairs.selectExpr("a", "b", "0.5D AS similarity", "0 AS offset")
    kinds = {(r["a"], r["b"]): r["verdict"] for r in recording.verdicts(recording.align(pairs, df, "id", "words"), before).collect()}
    assert kinds[1, 2] == "rescued" and kinds[1, 3] == "missed"


def test_nearest_is_the_inverted_index(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(1 << 20) << 4 & 0xFFFF0FFF for _ in range(rng.randint(0, 40))]) for i in range(90)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, words array<long>").repartition(5)
    posted = recording.half_postings(df, "id", "words")
    want = relational.candidates(posted.where("id % 7 = 0"), posted, "half", "id", limit=5, least=2)
    got = recording.nearest(df.where("id % 7 = 0"), df, "id", "words", limit=5, least=2)
    rows_of = lambda x: sorted((r["query"], r["id"], r["hits"], r["rank"]) for r in x.collect())
    assert rows_of(got) == rows_of(want) and got.count() > 20


def test_lyrics_job(spark):
    tracks = spark.createDataFrame([("a", "Song", "X"), ("b", " song ", "x"), ("c", "Other", "X"), ("d", None, None)], "id string, title string, artist string")
    lyrics = spark.createDataFrame([("a", "words", None, "TAG", 1)], SCHEMAS["track_lyrics"])
    got = [tuple(r) for r in jobs.reuse_by_name(tracks, lyrics).collect()]
    assert got == [("b", "words", None, "TAG (reused)")]
    fetched = spark.createDataFrame([("a", None, "[00:01.00]hi\n[00:02.00]there", "", None), ("b", "  ", "", None, 4), ("c", " x ", None, "TAG", 4)], SCHEMAS["track_lyrics"])
    assert sorted(tuple(r) for r in jobs.lyrics_rows(fetched, F.lit(9)).collect()) == [("a", "hi\nthere", "[00:01.00]hi\n[00:02.00]there", "LRCLIB", 9), ("c", "x", None, "TAG", 4)]
