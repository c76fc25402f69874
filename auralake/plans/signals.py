"""Ordered operators, array and bit formulas, signal kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.functions import bits, music
from auralake.operators import ordered, radio, recording, signal
from auralake.plans.registry import FEATURES, PEAKS, RECORDINGS, Tables, query, micros
from auralake.plans.relations import HALVES, SHARED


@query(f"""WITH {PEAKS}, w AS (SELECT *, max(mag + 0.08::DOUBLE * frame) OVER (PARTITION BY id, band ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM peaks)
SELECT id, frame, band, mag FROM w WHERE before IS NULL OR mag + 0.08::DOUBLE * frame >= before""")
def w1_decayed_peaks(t: Tables) -> DataFrame:
    return ordered.decayed_peaks(t.peaks, ["id", "band"], "frame", "mag")


@query(f"""WITH {PEAKS}, r AS (SELECT *, row_number() OVER (PARTITION BY id, frame ORDER BY mag DESC, band) AS nth FROM peaks) SELECT id, frame, band, mag FROM r WHERE nth = 1""")
def w2_band_argmax(t: Tables) -> DataFrame:
    return ordered.loudest(t.peaks, ["id", "frame"], "band", "mag")


@query(f"""WITH {PEAKS}, d AS (SELECT id, band, frame, mag - lag(mag, 4) OVER (PARTITION BY id, band ORDER BY frame) > 0 AS rising FROM peaks) SELECT id, band, frame, rising FROM d WHERE rising IS NOT NULL""")
def w3_lag_difference(t: Tables) -> DataFrame:
    return ordered.rising(t.peaks, ["id", "band"], "frame", "mag").select("id", "band", "frame", "rising")


@query(f"""WITH {PEAKS}, d AS (SELECT id, frame, greatest(mag - lag(mag) OVER (PARTITION BY id, band ORDER BY frame), 0) AS rise, lag(mag) OVER (PARTITION BY id, band ORDER BY frame) AS p FROM peaks)
SELECT id, frame, round(sum(rise), 6) AS flux FROM d WHERE p IS NOT NULL GROUP BY id, frame""")
def w4_positive_flux(t: Tables) -> DataFrame:
    return ordered.flux(t.peaks, ["id"], "frame", "band", "mag").withColumn("flux", F.round("flux", 6))


@query(f"""WITH {PEAKS}, s AS (SELECT id, frame, sum(mag) AS x FROM peaks GROUP BY id, frame), c AS (SELECT id, frame, x - avg(x) OVER (PARTITION BY id) AS x FROM s),
k AS (SELECT a.id, b.frame - a.frame AS lag, avg(a.x * b.x) AS score FROM c a JOIN c b ON a.id = b.id AND b.frame - a.frame BETWEEN 10 AND 31 GROUP BY ALL)
SELECT id, CAST(lag AS INTEGER) AS lag, round(score, 2) AS score FROM k""")
def w5_autocorrelation(t: Tables) -> DataFrame:
    summed = t.peaks.groupBy("id", "frame").agg(F.sum("mag").alias("x"))
    return ordered.autocorrelation(summed, ["id"], "frame", "x", 10, 31).select("id", F.col("lag").cast("int").alias("lag"), (F.round(F.col("score") * 100) / 100).alias("score"))  # rounded as SQL does


@query(f"""WITH {RECORDINGS} SELECT id, CAST(CASE WHEN len(words) >= 64 THEN (len(words) - 64) // 16 + 1 ELSE 0 END AS INTEGER) AS n_frames,
  CAST(greatest(CAST(ceil(greatest(len(words) - 64, 0) / 32.0) AS BIGINT), 0) + 1 AS INTEGER) AS n_segments,
  CASE WHEN len(words) >= 64 THEN words[((len(words) - 64) // 16) * 16 + 1] END AS last_frame_starts FROM recordings""")
def w6_w7_frames_and_segments(t: Tables) -> DataFrame:
    found = t.recordings.withColumn("f", ordered.frames(F.col("words"), 64, 16))
    return found.select("id", F.size("f").alias("n_frames"), F.size(ordered.padded_segments(F.col("words"), 64, 32)).alias("n_segments"), F.try_element_at(F.try_element_at("f", F.lit(-1)), F.lit(1)).alias("last_frame_starts"))


@query(f"""WITH {RECORDINGS} SELECT id, list_sum(words[(len(words) - 12) // 2 + 1 : (len(words) - 12) // 2 + 12])::BIGINT AS total FROM recordings WHERE len(words) >= 16""")
def w8_middle_window(t: Tables) -> DataFrame:
    long = t.recordings.where(F.size("words") >= 16)
    return long.select("id", F.aggregate(signal.middle(F.col("words"), 12), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(pow(0.7::DOUBLE, age) * CASE WHEN age = n - 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * value), 6) AS ewma FROM a GROUP BY user_id""")
def w11_ewma(t: Tables) -> DataFrame:
    return ordered.ewma(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value").withColumn("ewma", F.round("ewma", 6))


@query("""WITH s AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 AS sec FROM events),
r AS (SELECT user_id, event_id, count(*) OVER w AS n, max(sec) OVER w - min(sec) OVER w AS span FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round(CASE WHEN span > 0 THEN (n - 1) / span END, 9) AS rate FROM r""")
def w12_throughput(t: Tables) -> DataFrame:
    timed = t.events.select("user_id", "event_id", "ts", (micros() / 1e6).alias("sec"))
    return ordered.throughput(timed, ["user_id"], ["ts", "event_id"], "sec").select("user_id", "event_id", F.round("rate", 9).alias("rate"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def w13_running_total(t: Tables) -> DataFrame:
    upto = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.round(F.sum("value").over(upto), 4).alias("total"))


@query()
def w14_queue_walk(t: Tables) -> DataFrame:
    return radio.walk(t.features, "id", 0, 20).withColumn("distance", F.round("distance", 6))


@query()
def w15_limiter(t: Tables) -> DataFrame:
    found = ordered.limiter(t.events.withColumn("hit", F.col("event_type") == "error"), "user_id", ["ts", "event_id"], "hit", recover_after=2)
    return found.withColumnRenamed("key", "user_id")


@query(f"""WITH {PEAKS}, v AS (SELECT id, frame // 6 AS place, count(*) AS n FROM peaks GROUP BY ALL),
s AS (SELECT id, place, sum(n) OVER (PARTITION BY id ORDER BY place RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS votes FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, place) AS nth FROM s) SELECT id, CAST(place AS BIGINT) AS place, votes FROM r WHERE nth = 1""")
def w16_smoothed_votes(t: Tables) -> DataFrame:
    votes = t.peaks.groupBy("id", F.expr("frame div 6").alias("place")).agg(F.count("*").alias("n"))
    return ordered.smooth_votes(votes, ["id"], "place", "n")


@query("""WITH r AS (SELECT source, avg(n_chars) AS rate FROM documents WHERE source <> 'src3' GROUP BY source), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT round((sum(n * rate) + coalesce(sum(CASE WHEN rate IS NULL THEN n END) * (SELECT avg(rate) FROM r), 0)) / 6, 4) AS seconds FROM n LEFT JOIN r USING (source)""")
def w17_eta(t: Tables) -> DataFrame:
    from auralake.operators import stats

    rates = t.documents.where("source <> 'src3'").groupBy("source").agg(F.avg("n_chars").alias("rate"))
    remaining = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return stats.eta(remaining, rates, "source", 6).withColumn("seconds", F.round("seconds", 4))


@query(f"""WITH {PEAKS}, r AS (
  SELECT a.id, a.frame AS anchor_frame, a.band * 40 + 3 AS lo, b.band * 90 + 7 AS hi, b.frame - a.frame AS delta,
    row_number() OVER (PARTITION BY a.id, a.frame, a.band ORDER BY b.frame, b.band) AS nth FROM peaks a JOIN peaks b ON a.id = b.id AND b.frame - a.frame BETWEEN 1 AND 63)
SELECT id, anchor_frame, CAST((((lo >> 1) & 255) << 14) | (((hi >> 1) & 255) << 6) | (delta & 63) AS INTEGER) AS hash FROM r WHERE nth <= 4""")
def m5_m7_landmark_hashes(t: Tables) -> DataFrame:
    met = ordered.fan_out(t.peaks, ["id"], "frame", "band", "band", bands=5)
    return met.select("id", "anchor_frame", bits.landmark(F.col("anchor") * 40 + 3, F.col("target") * 90 + 7, F.col("delta")).alias("hash"))


@query(f"""WITH {PEAKS} SELECT id, frame, sum(1::BIGINT << band)::BIGINT AS word FROM peaks WHERE mag > 20 GROUP BY id, frame""")
def m8_bit_words(t: Tables) -> DataFrame:
    return t.peaks.where("mag > 20").groupBy("id", "frame").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("band"))).alias("word"))


@query(f"WITH {HALVES} SELECT id, CAST(half AS INTEGER) AS half FROM halves")
def m9_a14_d1_halves(t: Tables) -> DataFrame:
    return recording.half_postings(t.recordings, "id", "words").select("id", "half")


@query(f"WITH {RECORDINGS} SELECT id, words FROM recordings")
def s17_blob_codec(t: Tables) -> DataFrame:
    through = bits.unpack_words(bits.pack_words(F.col("words")))
    return t.recordings.select("id", F.when(F.col("words").isNotNull(), through).alias("words"))


ALIGNED = f"""{SHARED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id) AS rank FROM hits),
pairs AS (SELECT query AS a, id AS b FROM ranked WHERE rank <= 3), spread AS (SELECT id, unnest(words) AS value, generate_subscripts(words, 1) - 1 AS at FROM recordings),
rare AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY id, value) AS n FROM spread) x WHERE n <= 32),
votes AS (SELECT p.a, p.b, l.at - r.at AS o, count(*) AS n FROM pairs p JOIN rare l ON l.id = p.a JOIN spread r ON r.id = p.b AND r.value = l.value WHERE abs(l.at - r.at) <= 400 GROUP BY ALL),
smooth AS (SELECT a, b, o, sum(n) OVER (PARTITION BY a, b ORDER BY o RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM votes),
best AS (SELECT a, b, o FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY v DESC, o) AS nth FROM smooth) x WHERE nth = 1),
near AS (SELECT a, b, o + d AS o FROM best, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS d) y),
compared AS (SELECT n.a, n.b, n.o, count(*) AS len, sum(bit_count(xor(l.value, r.value))) AS differing FROM near n JOIN spread l ON l.id = n.a JOIN spread r ON r.id = n.b AND r.at = l.at - n.o GROUP BY ALL),
alike AS (SELECT a, b, o, CASE WHEN len >= 20 THEN 1.0::DOUBLE - differing / (32.0::DOUBLE * len) ELSE 0.0 END AS s FROM compared),
every AS (SELECT n.a, n.b, n.o, coalesce(s, 0.0) AS s FROM near n LEFT JOIN alike x ON x.a = n.a AND x.b = n.b AND x.o = n.o),
found AS (SELECT a, b, s, o FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, o) AS nth FROM every) x WHERE nth = 1)"""


@query(f"""WITH {ALIGNED} SELECT p.a, p.b, coalesce(s, 0) AS similarity, CAST(coalesce(o, 0) AS INTEGER) AS "offset" FROM pairs p LEFT JOIN found f ON f.a = p.a AND f.b = p.b""")
def m10_m11_r6_alignment(t: Tables) -> DataFrame:
    words = t.recordings
    pairs = recording.nearest(t.asked_recordings, words, "id", "words", limit=3, least=1).select(F.col("query").alias("a"), F.col("id").alias("b"))
    return recording.align(pairs, words, "id", "words", least=20)


@query(f"""WITH {FEATURES} SELECT id, round(least(greatest((p_bpm - 60) / 120, 0), 1), 6) AS tempo, CAST(round_even(tempo * 120 + 60, 0) AS BIGINT) AS bpm, CAST(floor((tempo * 120 + 60) / 10) * 10 AS BIGINT) AS bucket,
  CAST(round_even(energy * 100, 0) AS BIGINT) AS energy_pct FROM (SELECT *, (id % 300)::DOUBLE AS p_bpm FROM features) x""")
def m16_m23_m27_tempo(t: Tables) -> DataFrame:
    return t.features.select(
        "id",
        F.round(music.tempo((F.col("id") % 300).cast("double")), 6).alias("tempo"),
        music.bpm(F.col("tempo")).alias("bpm"),
        (F.floor((F.col("tempo") * 120 + 60) / 10) * 10).cast("long").alias("bucket"),
        F.bround(F.col("energy") * 100).cast("long").alias("energy_pct"),
    )


@query("""SELECT p_partkey AS id, round(cos(((p_partkey * 7) % 12) * (2 * pi() / 12)) * least(p_size / 40.0::DOUBLE, 1), 6) AS x, round(sin(((p_partkey * 7) % 12) * (2 * pi() / 12)) * least(p_size / 40.0::DOUBLE, 1), 6) AS y,
  CASE WHEN abs(cos(((p_partkey * 7) % 12) * (2 * pi() / 12)) * least(p_size / 40.0::DOUBLE, 1)) < 0.05 AND abs(sin(((p_partkey * 7) % 12) * (2 * pi() / 12)) * least(p_size / 40.0::DOUBLE, 1)) < 0.05 THEN 'Unknown' ELSE ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][p_partkey % 12 + 1] END AS name FROM part""")
def m17_m18_keys(t: Tables) -> DataFrame:
    x, y = music.key_point(F.col("p_partkey") % 12, F.col("p_size") / 40.0)
    return t.part.select(F.col("p_partkey").alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), music.key_name(x, y).alias("name"))


@query("""SELECT user_id, round(CASE WHEN r > 0 THEN least(greatest((20 * log10(r) + 40) / 34, 0), 1) ELSE 0 END, 6) AS energy,
  CAST(floor(69 + 12 * log2((100 + user_id) / 440.0::DOUBLE)) % 12 AS INTEGER) AS pitch_class, round(CASE WHEN v > 0 THEN least(greatest((m - a) / v, 0), 1) ELSE 0 END, 6) AS pulse
FROM (SELECT user_id, sqrt(avg(value * value / 250000)) AS r, max(value) AS m, avg(value) AS a, var_pop(value) AS v FROM events GROUP BY user_id) x""")
def m19_m21_m22_measures(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value") / 250000)).alias("r"), F.max("value").alias("m"), F.avg("value").alias("a"), F.var_pop("value").alias("v"))
    return g.select("user_id", F.round(music.energy(F.col("r")), 6).alias("energy"), music.pitch_class((F.col("user_id") + 100).cast("double")).alias("pitch_class"), F.round(music.pulse(F.col("m"), F.col("a"), F.col("v")), 6).alias("pulse"))


@query(f"""WITH {PEAKS} SELECT id, round(avg(c) / 5, 6) AS brightness FROM (SELECT id, frame, sum(mag * band) / sum(mag) AS c FROM peaks GROUP BY id, frame HAVING sum(mag) > 0) x GROUP BY id""")
def m20_brightness(t: Tables) -> DataFrame:
    centroids = t.peaks.groupBy("id", "frame").agg((F.sum(F.col("mag") * F.col("band")) / F.sum("mag")).alias("c"), F.sum("mag").alias("s")).where("s > 0")
    return centroids.groupBy("id").agg(F.round(F.avg("c") / 5, 6).alias("brightness"))


def _whole_signal(text: str) -> Column:
    """All bytes of a document as unsigned 8-bit audio."""
    return F.encode(text, "utf-8")


@query("SELECT doc_id, CAST(greatest((strlen(text) - 1024) // 256 + 1 - 4, 0) AS INTEGER) AS n_words FROM documents WHERE strlen(text) >= 1024")
def m1_m4_m8_recording_words(t: Tables) -> DataFrame:
    """The number of recording words of documents played as sound; their values are held against known digests in tests."""
    some = t.texts.where("octet_length(text) >= 1024").select("doc_id", signal.analyse(_whole_signal("text"), "words").alias("a"))
    return some.select("doc_id", F.size("a.words").alias("n_words"))


@query()
def r13_r14_signal_analysis(t: Tables) -> DataFrame:
    """Landmarks and features of documents played as sound."""
    some = t.texts.where("octet_length(text) >= 1024").select("doc_id", signal.analyse(_whole_signal("text"), "landmarks", "features").alias("a"))
    return some.select("doc_id", F.size("a.landmarks").alias("n_landmarks"), F.round("a.features.energy", 6).alias("energy"), F.round("a.features.brightness", 6).alias("brightness"))


@query()
def m24_m25_noisy_excerpts(t: Tables) -> DataFrame:
    """Excerpts mixed with seeded noise at 10 dB."""
    clean = signal.excerpt_bytes(_whole_signal("text"), F.lit(0.0), F.lit(0.25))
    noisy = signal.with_noise(clean, signal.white_noise(F.lit(500), F.col("doc_id")), F.lit(10.0))
    return t.texts.where("octet_length(text) >= 2000").select("doc_id", noisy.alias("x")).select("doc_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double")), 3).alias("total"))
