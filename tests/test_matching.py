"""The decision gate, MaxSim, duplicates; text and lyrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.functions import music
from auralake.functions import text as tx
from auralake.operators import search, vectors


@pytest.mark.parametrize(
    "ranked,same,accepted,margin",
    [
        ([(0.95, "1"), (0.40, "2")], {}, True, 0.55),
        ([(0.50, "1"), (0.20, "2")], {}, False, 0.30),
        ([(0.95, "1"), (0.93, "2")], {}, False, 0.02),
        ([(0.998, "n1"), (0.998, "y1"), (0.4, "n2")], {"n1": "a", "y1": "a", "n2": "b"}, True, 0.598),
        ([(0.998, "n1"), (0.998, "y1")], {"n1": "a", "y1": "a"}, True, 0.998),
    ],
)
def test_gate(spark, ranked, same, accepted, margin):
    scored = spark.createDataFrame([("q", k, s) for s, k in ranked], "query string, id string, score double")
    keys = spark.createDataFrame(list(same.items()) or [("none", "x")], "id string, same string")
    got = vectors.decide(scored, "id", keys).first()
    assert got["accepted"] == accepted and got["margin"] == pytest.approx(margin) and got["best"] == max(ranked)[1]
    assert vectors.decide(scored.where("false"), "id", keys).count() == 0


def test_matrix_products_equal_the_expression(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=(i % 4, 8)).tolist()) for i in range(40)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, segments array<array<double>>").repartition(3)
    fast = {(r["query"], r["id"]): r["score"] for r in vectors.score_all(df.where("id % 7 = 0"), df, "id").collect()}
    asked = df.where("id % 7 = 0").selectExpr("id AS query", "segments AS q")
    slow = df.join(asked, df["id"] >= 0).select("query", "id", F.coalesce(vectors.maxsim(F.col("q"), F.col("segments")), F.lit(0.0)).alias("score"))
    assert len(fast) == 6 * 41
    for r in slow.collect():
        assert fast[r["query"], r["id"]] == pytest.approx(r["score"])


def test_duplicates_at_the_defaults(spark):
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    base = rng.normal(size=(5, 16)) + 2
    rows = [("a", 100000, unit(base)), ("b", 103000, unit(base + 0.01)), ("c", 103001, unit(base)), ("d", 100000, unit(rng.normal(size=(5, 16)))), ("e", 0, unit(base)), ("f", 100000, None)]
    got = [(r["id_a"], r["id_b"]) for r in vectors.duplicates(spark.createDataFrame(rows, "id string, d long, segments array<array<double>>"), "id", "d").collect()]
    assert sorted(got) == [("a", "b"), ("b", "c")]


LRC = "[00:00.00]\n[00:03.14]Hello darkness my old friend\n[00:07.82]I've come to talk with you again\n[00:21.100]That was planted in my brain\nno stamp\n[1:02.00]short minute\n[01:00.5]bad fraction"


def test_timed_lines(spark):
    df = spark.createDataFrame([(LRC,), (None,), ("",)], "x string")
    got = [[(l["ts_ms"], l["text"]) for l in r["l"] or []] for r in df.select(tx.parse_lines(F.col("x")).alias("l")).collect()]
    assert got == [[(3140, "Hello darkness my old friend"), (7820, "I've come to talk with you again"), (21100, "That was planted in my brain")], [], []]


@pytest.mark.parametrize(
    "plain,synced,query,want",
    [
        (None, LRC, "darkness my old friend", (3140, "Hello darkness my old friend")),
        (None, LRC, "friend darkness", (3140, "Hello darkness my old friend")),
        (None, LRC, "Planted in my brain", (21100, "That was planted in my brain")),
        ("x\n  Left its seeds while I was sleeping ", None, "seeds while I was sleeping", (None, "Left its seeds while I was sleeping")),
        ("x", LRC, "  ", (None, "")),
        (None, None, "x", (None, "")),
    ],
)
def test_best_line(spark, plain, synced, query, want):
    df = spark.createDataFrame([(plain, synced)], "p string, s string")
    got = df.select(tx.best_line(F.col("p"), F.col("s"), F.lit(query)).alias("l")).first()["l"]
    assert tuple(got) == want


def test_search_and_snippets(spark):
    docs = spark.createDataFrame([(1, "Sound", "Duo", "hello darkness my old friend i come again"), (2, "Rhapsody", "Band", "caught in a landslide no escape from reality"), (3, "sound ", "duo", "Dárkness friend"), (4, "N", "M", None)], "id long, title string, artist string, text string")
    posted = search.postings(docs, "id", ["text"])
    found = lambda q: [r["id"] for r in search.search(posted, docs, "id", q, 10).collect()]
    assert found("darkness friend") == [1] and found("landslide esc") == [2] and found("supercalifragilistic") == [] and found(" !! ") == [] and found("DARKNESS") == [1]
    assert sorted(r["id"] for r in search.matches(posted, "id", "fri dark").collect()) == []
    snippet = search.with_snippet(docs.where("id = 1"), "text", "darkness fri").first()["snippet"]
    assert "<b>darkness</b>" in snippet and "<b>friend</b>" in snippet
    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)) + " needle end",)], "text string")
    assert search.with_snippet(long, "text", "needle").first()["snippet"].startswith("...") and search._snippet(None, ["x"]) == ""


def test_keys_and_formats(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.title_key(F.lit("Song (Official Video) (Live at X) - Élan!"))) == "songélan"
    assert one(tx.tag_key(F.lit(" Don’t Stop, It's "))) == "dont stop its"
    assert [one(tx.clock(F.lit(s))) for s in (0.0, 61.0, 3661.0, float("inf"), float("nan"), -1.0)] == ["00:00", "01:01", "1:01:01", "--:--", "--:--", "--:--"]
    assert one(tx.display_width(F.lit("a日本e\u0301"))) == 6 and one(tx.truncate(F.lit("abcdef"), 4)) == "abc…"
    assert one(tx.label(F.lit(""), F.lit("T"))) == "Unknown - T" and one(tx.full_name(F.lit(None).cast("string"), F.lit("T"))) is None
    assert [one(tx.reason_class(F.lit(r))) for r in ("DECODE_FAILED:x", " : y", "RATE_LIMITED")] == ["DECODE_FAILED", "UNKNOWN", "RATE_LIMITED"]
    assert one(music.distance({c: F.lit(0.0) for c in ("tempo", "energy", "brightness", "danceability", "key_x", "key_y")}, {"tempo": F.lit(1.0), "energy": F.lit(0.0), "brightness": F.lit(0.0), "danceability": F.lit(0.0), "key_x": F.lit(1.0), "key_y": F.lit(0.0)})) == pytest.approx((1.6 + 0.6) ** 0.5)
    said = ["HTTP Error 429: Too Many Requests", "Sign in to confirm you're not a bot", "Video unavailable", "This video is private", "The uploader has not made this video available in your country", "Sign in to confirm your age", "Requested format is not available", "boom"]
    got = [one(tx.failure_class(F.lit(m))) for m in said]
    assert got == ["RATE_LIMITED", "RATE_LIMITED", "UNAVAILABLE", "UNAVAILABLE", "GEO_BLOCKED", "AGE_RESTRICTED", "NO_AUDIO_FORMAT", "RESOLVE_ERROR"]
    assert tx.damage_summary(spark.createDataFrame([], "l string"), "l").first()["summary"] == "no problems"
