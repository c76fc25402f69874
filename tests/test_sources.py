"""Sources, resolvers, settings and streams."""

import io
import sqlite3
import wave

import numpy as np
from pyspark.sql import functions as F

from auralake.operators import ordered
from auralake.sources import audio, resolve, settings, sqlite, tables
from auralake.streaming import incremental


def test_paths_urls_and_tags(spark):
    rows = [("/data/user/files/x.opus",), ("/data/other/y",), ("/elsewhere/z",), (None,)]
    prefixes = [("/data/user", "/mnt/m/"), ("/data", "D:")]
    assert [r[0] for r in spark.createDataFrame(rows, "p string").select(resolve.map_path(F.col("p"), prefixes)).collect()] == ["/mnt/m/files/x.opus", "D:/other/y", "/elsewhere/z", ""]
    urls = ["https://a/b?expire=17&expires=4", "https://a/b?expires=5", "https://a/b?expire=soon", "https://a/b", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(resolve.expiry(F.col("u"))).collect()] == [17, 5, 0, 0, 0]
    cache = spark.createDataFrame([(1, 0), (2, 1600), (3, 1601)], "k int, expires long")
    assert [r["k"] for r in resolve.live(cache, F.lit(1000)).orderBy("k").collect()] == [1, 3]
    signed = spark.range(1).select(resolve.stream_url("http://h/", "u n", "pw", "s", F.lit("a b&c"))).first()[0]
    assert signed.startswith("http://h/rest/stream.view?u=u%20n&t=") and signed.endswith("&id=a%20b%26c")


def test_audio(spark):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as file:
        file.setnchannels(2)
        file.setsampwidth(2)
        file.setframerate(16000)
        file.writeframes((np.ones(3200) * 16384).astype("<i2").tobytes())
    blobs = [buffer.getvalue(), np.array([0.5, -0.5], "<f4").tobytes() + b"xyz", b"", None, b"RIFFbroken", b"ab"]
    df = spark.createDataFrame([(None if b is None else bytearray(b),) for b in blobs], "b binary")
    got = [(len(r["d"]["samples"]), r["d"]["reason"]) for r in df.select(audio.decode(F.col("b")).alias("d")).collect()]
    assert got == [(800, "OK"), (2, "OK"), (0, "EMPTY"), (0, "MISSING"), (0, "FAILED"), (0, "EMPTY")]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport A='x y'\nB = \"2\"\nC=3\nbroken\n")
    into = {"C": "kept"}
    assert settings.load([str(tmp_path / "none"), str(tmp_path / ".env")], into) == str(tmp_path / ".env")
    assert into == {"A": "x y", "B": "2", "C": "kept"} and settings.load([str(tmp_path / "none")], into) is None


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE tracks (id INTEGER PRIMARY KEY, title TEXT, d REAL, b BLOB)")
        c.executemany("INSERT INTO tracks VALUES (?, ?, ?, ?)", [(i, f"t{i}" if i % 3 else None, i / 2, bytes([i % 256])) for i in range(1000)])
        c.execute("CREATE TABLE empty (id INTEGER)")
    sqlite.register(spark)
    read = lambda name: spark.read.format("sqlite").option("path", path).option("dbtable", name).option("rows", 300).load()
    df = read("tracks")
    assert df.count() == 1000 and df.rdd.getNumPartitions() == 4 and [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "binary"]
    assert df.where("id >= 990 AND title IS NOT NULL").orderBy("id").select("id", "title").first() == (991, "t991")
    assert df.agg(F.sum("d")).first()[0] == sum(i / 2 for i in range(1000)) and read("empty").count() == 0


def test_sqlite_types_sparse_ids_and_columns(spark, tmp_path):
    path = str(tmp_path / "y.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id BIGINT, ok BOOLEAN, n NUMERIC(5, 2), f DOUBLE PRECISION, v VARCHAR(9), x)")
        c.executemany("INSERT INTO t (rowid, id, ok, n, f, v, x) VALUES (?, ?, ?, ?, ?, ?, ?)", [(r, i, i % 2, i / 4, i, f"v{i}", i) for i, r in enumerate([1, 2, 3, 10**6, 9 * 10**12])])
        c.execute("INSERT INTO t (id, ok, n, f, v, x) VALUES ('word', NULL, 'word', 1, x'41', 2.5)")
    sqlite.register(spark)
    read = lambda **o: spark.read.format("sqlite").options(path=path, dbtable="t", rows=2, **o).load()
    df = read()
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "bigint", "double", "double", "string", "string"]
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.where("id is not null").collect())) == [(i, i % 2, i / 4, float(i), f"v{i}", str(i)) for i in range(5)]
    assert tuple(df.where("id is null").first()) == (None, None, None, 1.0, "A", "2.5")
    assert read(columns="v, id").columns == ["id", "v"] and read(columns="id").count() == 6


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    rows = [(u, i, float(i * (u + 1) % 17), (i * 7 + u) % 5 == 0) for i in range(60) for u in range(3)]
    schema = "u long, event_id long, value double, hit boolean"
    source = f"file://{tmp_path}/in"
    outs = {}
    for part in (rows[:80], rows[80:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: incremental.read_growing(spark, source, schema, files_per_batch=1)
        for name, df in (("ewma", incremental.running_means(stream(), "u", ["event_id"], "value")), ("slots", incremental.limiter_states(stream(), "u", ["event_id"], "hit", recover_after=2))):
            rows_at = f"file://{tmp_path}/{name}"
            incremental.commit_batches(df, f"file://{tmp_path}/progress-{name}", incremental.append_once(rows_at), "update").awaitTermination()
            outs[name] = rows_at
    whole = spark.createDataFrame(rows, schema)
    want = {r["u"]: r["ewma"] for r in ordered.ewma(whole, ["u"], ["event_id"], "value").collect()}
    got = {r["key"]: r["x"] for r in spark.read.parquet(outs["ewma"]).groupBy("key").agg(F.max_by("ewma", "batch").alias("x")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    end = ordered.limiter(whole, "u", ["event_id"], "hit", recover_after=2).groupBy("key").agg(F.max_by("slots", "event_id").alias("x"))
    assert {r["key"]: r["x"] for r in spark.read.parquet(outs["slots"]).groupBy("key").agg(F.max_by("slots", "batch").alias("x")).collect()} == {r["key"]: r["x"] for r in end.collect()}


def test_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    tables.write_log(spark.createDataFrame([(1.0, "OK", 2.5)], "ts double, status string, elapsed_s double"), path)
    tables.write_log(spark.createDataFrame([(2.0, "checkpoint")], "ts double, event string"), path)
    got = tables.read_log(spark, path).orderBy("ts").collect()
    assert [(r["ts"], r["status"], r["event"]) for r in got] == [(1.0, "OK", None), (2.0, None, "checkpoint")]
