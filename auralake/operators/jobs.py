"""Composite jobs: the index checkpoint, sub-hash backfill, the lyrics job, the preflight report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.functions import bits
from auralake.functions import text as tx
from auralake.operators import maintenance, relational
from auralake.operators.lineage import cut


def write_batch(store: maintenance.Store, analysed: DataFrame, version: int, now_ms: int) -> DataFrame:
    """Store one batch of analysed tracks in one commit; (table, rows) that it inserted or replaced.

    ``analysed``: track_id, duration_ms, landmarks, words, features. Landmarks are
    added once, features and recordings replaced, halves replaced per track. A
    batch that is run again changes nothing. The analysis runs once.
    """
    from auralake.sources.tables import SCHEMAS

    analysed = cut(analysed)
    marks = analysed.select(F.inline("landmarks"), F.col("track_id").alias("trackId")).select("hash", "trackId", F.col("anchor_frame").alias("anchorFrame"))
    feats = analysed.where("features is not null").select(
        F.col("track_id").alias("trackId"),
        *[F.col(f"features.{a}").alias(b) for a, b in (("tempo", "tempo"), ("energy", "energy"), ("brightness", "brightness"), ("danceability", "danceability"), ("key_x", "keyX"), ("key_y", "keyY"))],
        F.lit(version).alias("version"),
        F.lit(now_ms).cast("long").alias("measuredAt"),
    )
    recordings = analysed.where(F.size("words") > 0).select(F.col("track_id").alias("trackId"), bits.pack_words(F.col("words")).alias("subHashes"), F.col("duration_ms").cast("long").alias("durationMs"), F.lit(now_ms).cast("long").alias("computedAt"))
    halves = analysed.where(F.size("words") > 0).select(F.explode(bits.halves(F.col("words"))).alias("half"), F.col("track_id").alias("trackId"))
    old = {n: store.read(n, SCHEMAS[n]) for n in ("fingerprints", "track_features", "recording_fingerprints", "recording_sub_hashes")}
    tracks = {n: df.join(new.select("trackId").distinct(), "trackId", "left_anti") for n, df, new in (("track_features", old["track_features"], feats), ("recording_fingerprints", old["recording_fingerprints"], recordings))}
    made = {
        "fingerprints": (relational.insert_ignore(old["fingerprints"], marks, ["hash", "trackId", "anchorFrame"]), old["fingerprints"]),
        "track_features": (relational.upsert(old["track_features"], feats, ["trackId"]), tracks["track_features"]),
        "recording_fingerprints": (relational.upsert(old["recording_fingerprints"], recordings, ["trackId"]), tracks["recording_fingerprints"]),
        "recording_sub_hashes": (relational.replace_children(old["recording_sub_hashes"], halves, "trackId"), old["recording_sub_hashes"].join(halves.select("trackId").distinct(), "trackId", "left_anti")),
    }
    written = {name: store.write(name, whole) for name, (whole, _) in made.items()}
    told = [(name, written[name][1] - stayed.count()) for name, (_, stayed) in made.items()]
    store.commit({name: folder for name, (folder, _) in written.items()})
    return store.spark.createDataFrame(told, "table string, rows long")


def backfill_halves(store: maintenance.Store) -> int:
    """Halves of recordings that have none yet; how many rows that wrote. Run again, it writes none."""
    from auralake.sources.tables import SCHEMAS

    recordings, halves = (store.read(n, SCHEMAS[n]) for n in ("recording_fingerprints", "recording_sub_hashes"))
    new = relational.missing(recordings, halves, "trackId").select(F.explode(bits.halves(bits.unpack_words(F.col("subHashes")))).alias("half"), "trackId")
    n = new.count()
    if n:
        store.publish("recording_sub_hashes", halves.unionByName(new))
    return n


def lyrics_rows(fetched: DataFrame, now_ms: Column) -> DataFrame:
    """Rows fit to store: text trimmed, blank ones dropped, plain text made from timed text, source and time filled in."""
    synced = F.nullif(F.trim("syncedLyrics"), F.lit(""))
    plain = F.coalesce(F.nullif(F.trim("plainLyrics"), F.lit("")), F.nullif(tx.plain_lines(synced), F.lit("")))
    return fetched.select(
        "trackId", plain.alias("plainLyrics"), synced.alias("syncedLyrics"), F.coalesce(F.nullif("source", F.lit("")), F.lit("LRCLIB")).alias("source"), F.coalesce("syncedAt", now_ms).cast("long").alias("syncedAt")
    ).where("plainLyrics is not null")


def payload(body: Column) -> Column:
    """(plainLyrics, syncedLyrics) of a lyrics service's JSON answer; null where it isn't one."""
    return F.from_json(body, "plainLyrics string, syncedLyrics string")


def reuse_by_name(tracks: DataFrame, lyrics: DataFrame, key: str = "id", title: str = "title", artist: str = "artist") -> DataFrame:
    """Lyrics for tracks without any, from a track of the same name; the smallest source track wins."""
    lacking = tracks.join(lyrics.select(F.col("trackId").alias(key)), key, "left_anti")
    known = lyrics.join(tracks.select(F.col(key).alias("trackId"), title, artist), "trackId")
    named = known.select(tx.key(F.col(title)).alias("_t"), tx.key(F.col(artist)).alias("_a"), "trackId", "plainLyrics", "syncedLyrics", "source")
    one = relational.first(named, ["_t", "_a"], "trackId").drop("trackId")
    return lacking.select(F.col(key).alias("trackId"), tx.key(F.col(title)).alias("_t"), tx.key(F.col(artist)).alias("_a")).join(one, ["_t", "_a"]).select("trackId", "plainLyrics", "syncedLyrics", F.concat(F.regexp_replace("source", r"( \(reused\))+$", ""), F.lit(" (reused)")).alias("source"))


def preflight(tables: dict[str, DataFrame | None], recordings: DataFrame, halves: DataFrame) -> DataFrame:
    """(what, rows): the row count of each table, and recordings whose halves aren't indexed."""
    gap = relational.gap(recordings, halves, "trackId")
    return maintenance.counts(tables).withColumnRenamed("table", "what").unionByName(gap.select(F.explode(F.array(F.struct(F.lit("recordings").alias("what"), F.col("total").alias("rows")), F.struct(F.lit("recordings without halves").alias("what"), F.col("missing").alias("rows")))).alias("x")).select("x.*"))
