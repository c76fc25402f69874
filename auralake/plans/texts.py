"""Search, lyrics lines, keys and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.functions import text as tx
from auralake.operators import jobs, search
from auralake.plans.registry import TRACKS, Tables, query, micros

TOKENS = r"tokens AS (SELECT doc_id AS id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents)"


def _postings(t: Tables) -> DataFrame:
    return search.postings(t.texts.withColumnRenamed("doc_id", "id"), "id", ["text"])


@query(f"""WITH {TRACKS}, {TOKENS}, m AS (SELECT id FROM tokens GROUP BY id HAVING bool_or(term = 'the') AND bool_or(term = 'andanea') OR bool_or(term = 'the') AND bool_or(starts_with(term, 'andan'))),
pool AS (SELECT t.id, t.title, t.artist FROM tracks t JOIN m ON m.id = t.id ORDER BY t.id LIMIT 40),
named AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(artist)) ORDER BY id) AS nth FROM pool)
SELECT id, title, artist FROM named WHERE nth = 1 ORDER BY id LIMIT 20""")
def t1_j9_o7_search(t: Tables) -> DataFrame:
    return search.search(_postings(t), t.tracks.select("id", "title", "artist"), "id", "The andan", 20)


@query(f"WITH {TOKENS} SELECT id, count(*) AS n, count(DISTINCT term) AS terms, min(term) AS first, max(term) AS last FROM tokens GROUP BY id")
def t2_tokens(t: Tables) -> DataFrame:
    """Counts of each document's tokens, taken where its text lies; only ids of several rows have their terms shuffled."""
    docs = t.texts.withColumnRenamed("doc_id", "id")
    repeated = t.documents.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("_rows")).where((F.col("_rows") > 1) | F.col("id").isNull()).select("id")
    counted = lambda posted: posted.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"), F.min("term").alias("first"), F.max("term").alias("last"))
    posted = lambda df: search.postings(df, "id", ["text"])
    shared = not repeated.isEmpty()
    alone = docs.join(repeated, "id", "left_anti").where("id IS NOT NULL") if shared else docs
    found = alone.select("id", tx.tokens(F.col("text")).alias("x")).where("size(x) > 0").select("id", F.size("x").cast("long").alias("n"), F.size(F.array_distinct("x")).cast("long").alias("terms"), F.array_min("x").alias("first"), F.array_max("x").alias("last"))
    if not shared:
        return found
    return found.unionByName(counted(posted(docs.join(repeated, docs["id"].eqNullSafe(repeated["id"]), "left_semi"))))


@query(r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g')), lambda x: x <> '') AS terms FROM documents""")
def t3_query_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.query_terms(F.col("text")).alias("terms"))


@query()
def t4_r12_snippets(t: Tables) -> DataFrame:
    found = t.documents.withColumnRenamed("doc_id", "id").join(search.matches(_postings(t), "id", "the andan"), "id", "left_semi")
    return search.with_snippet(found, "text", "the andan").select("id", "snippet")


def _lyrics(t: Tables) -> DataFrame:
    """One timed lyrics text per conversation; a turn is a line, its time 1.53 s a turn."""
    ms = (F.col("turn") * 1530).cast("long")
    stamp = F.format_string("[%02d:%02d.%02d]", F.floor(ms / 60000), F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100)
    line = F.concat(stamp, F.translate("text", "\n", " "))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "\n").alias("synced"))


@query("""SELECT conv_id, CAST(turn * 1530 AS INTEGER) AS ts_ms, trim(replace(text, chr(10), ' ')) AS text FROM conversations WHERE trim(replace(text, chr(10), ' ')) <> ''""")
def t5_o5_timed_lines(t: Tables) -> DataFrame:
    return _lyrics(t).select("conv_id", F.explode(tx.parse_lines(F.col("synced"))).alias("l")).select("conv_id", "l.ts_ms", "l.text")


@query("SELECT conv_id, md5(string_agg(trim(replace(text, chr(10), ' ')), chr(10) ORDER BY turn)) AS plain FROM conversations WHERE trim(replace(text, chr(10), ' ')) <> '' GROUP BY conv_id")
def t6_plain_lines(t: Tables) -> DataFrame:
    return _lyrics(t).select("conv_id", F.md5(tx.plain_lines(F.col("synced"))).alias("plain"))


@query("""WITH l AS (SELECT conv_id, turn * 1530 AS ts, trim(replace(text, chr(10), ' ')) AS x FROM conversations),
e AS (SELECT conv_id, min(ts) FILTER (WHERE contains(lower(x), 'of the')) AS exact, min(ts) FILTER (WHERE contains(lower(x), 'of') AND contains(lower(x), 'the')) AS every FROM l GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(exact, every) AS INTEGER) AS ts_ms, coalesce(l.x, '') AS line FROM e LEFT JOIN l ON l.conv_id = e.conv_id AND l.ts = coalesce(exact, every)""")
def t7_r12_matching_line(t: Tables) -> DataFrame:
    return search.with_line(_lyrics(t).withColumn("plain", F.lit(None).cast("string")), "plain", "synced", "Of the").select("conv_id", "ts_ms", "line")


@query(r"""SELECT doc_id, lower(regexp_replace(regexp_replace(text || CASE doc_id % 3 WHEN 0 THEN ' (Official Video)' WHEN 1 THEN ' (Lyrics)' ELSE ' (Live at X)' END, '(?i)\((?:audio|visualiz[\p{L}\p{N}_]+|lyrics?|official[^)]*|live[^)]*|remaster[^)]*)\)', '', 'g'), '[^\p{L}\p{N}_]+', '', 'g')) AS title,
  trim(regexp_replace(lower(replace(replace(text, '’', ''), '''', '')), '[^\p{L}\p{N}_\s]', '', 'g')) AS tag, lower(trim(coalesce(lang, ''))) AS key FROM documents""")
def t8_t9_t10_keys(t: Tables) -> DataFrame:
    title = F.concat(F.col("text"), F.expr("CASE doc_id % 3 WHEN 0 THEN ' (Official Video)' WHEN 1 THEN ' (Lyrics)' ELSE ' (Live at X)' END"))
    return t.documents.select("doc_id", tx.title_key(title).alias("title"), tx.tag_key(F.col("text")).alias("tag"), tx.key(F.col("lang")).alias("key"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source || ' - ' || lang END AS full_name, CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE source END || ' - ' || CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE lang END AS label,
  CASE doc_id % 3 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'UNKNOWN' ELSE 'plain' END AS reason FROM documents""")
def t11_t12_labels(t: Tables) -> DataFrame:
    artist = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    return t.documents.select(
        "doc_id",
        tx.full_name(artist, F.col("lang")).alias("full_name"),
        tx.label(artist, F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))).alias("label"),
        tx.reason_class(F.expr("CASE doc_id % 3 WHEN 0 THEN ' HTTP : 404' WHEN 1 THEN ' :x' ELSE 'plain' END")).alias("reason"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '--:--' WHEN event_id >= 3600 THEN printf('%d:%02d:%02d', event_id // 3600, event_id % 3600 // 60, event_id % 60) ELSE printf('%02d:%02d', event_id // 60, event_id % 60) END AS clock,
  printf('%02d:%02d', event_id * 37 // 60000, event_id * 37 // 1000 % 60) AS stamp FROM events""")
def t13_t16_clock(t: Tables) -> DataFrame:
    seconds = F.when(F.col("event_id") % 9 == 0, F.lit(-1.0)).otherwise(F.col("event_id"))
    return t.events.select("event_id", tx.clock(seconds).alias("clock"), tx.stamp(F.col("event_id") * 37).alias("stamp"))


@query("SELECT doc_id, CAST(5 + length(text) AS INTEGER) AS width, CASE WHEN length(text) > 12 THEN substring(text, 1, 11) || '…' ELSE text END AS short, md5(text) AS md5 FROM documents")
def t14_t15_x4_width_and_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.display_width(F.concat(F.lit("\u65e5\u672ce\u0301"), "text")).alias("width"), tx.truncate(F.col("text"), 12).alias("short"), F.md5("text").alias("md5"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, strftime(ts, '%H:%M:%S') AS stamp FROM events")
def t17_epoch(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.floor(micros() / 1000).cast("long").alias("ms"), F.date_format("ts", "HH:mm:ss").alias("stamp"))


@query("""WITH have AS (SELECT d.doc_id, lower(trim(d.source)) AS a, lower(trim(d.lang)) AS l, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1),
one AS (SELECT a, l, min(doc_id) AS src FROM have GROUP BY a, l)
SELECT d.doc_id AS "trackId", 'words of ' || o.src AS "plainLyrics", 'TAG (reused)' AS source FROM documents d JOIN one o ON lower(trim(d.source)) = o.a AND lower(trim(d.lang)) = o.l WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.doc_id = d.doc_id)""")
def j15_r11_reuse_by_name(t: Tables) -> DataFrame:
    """Lyrics that tracks without any take from tracks of their name."""
    tracks = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("artist"))
    lyrics = t.labels.where("toxic = 1").select(F.col("doc_id").alias("trackId"), F.concat(F.lit("words of "), "doc_id").alias("plainLyrics"), F.lit(None).cast("string").alias("syncedLyrics"), F.lit("TAG (reused)").alias("source"))
    return jobs.reuse_by_name(tracks, lyrics).select("trackId", "plainLyrics", "source")
