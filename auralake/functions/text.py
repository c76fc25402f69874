"""Text keys, formats and parsers as expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of resolver messages in order of priority, and their patterns; the first that matches counts.
FAILURES = [
    ("RATE_LIMITED", r"429|too many requests|rate.?limit|sign in to confirm.*not a bot"),
    (
        "UNAVAILABLE",
        r"video unavailable|private video|video is private|removed by the uploader|does not exist|has been terminated|"
        r"no longer available|unable to (?:extract|download) (?:video|webpage) data",
    ),
    ("GEO_BLOCKED", r"available in your country|geo.?restrict|blocked it in your country|not available from your location"),
    ("AGE_RESTRICTED", r"age.?restrict|confirm your age|inappropriate for some users"),
    ("NO_AUDIO_FORMAT", r"requested format is not available|no video formats found"),
]
# Bracketed title parts that don't tell recordings apart.
QUALIFIER = r"(?i)\((?:audio|visualiz[\p{L}\p{N}_]+|lyrics?|official[^)]*|live[^)]*|remaster[^)]*)\)"
STAMPED = r"^\[(\d{2}):(\d{2})\.(\d{2,3})\](.*)$"


def key(value: Column) -> Column:
    """Case and outer blanks don't count; null is the empty key."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def title_key(value: Column) -> Column:
    """A title less its bracketed qualifiers and all but word characters, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, QUALIFIER, ""), r"[^\p{L}\p{N}_]+", ""))


def tag_key(value: Column) -> Column:
    """A tag without apostrophes and punctuation."""
    plain = F.lower(F.translate(value, "’'", ""))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", ""))


def label(artist: Column, title: Column, unknown: str = "Unknown") -> Column:
    """``artist - title`` with defaults for null and empty parts."""
    named = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(unknown))
    return F.concat(named(artist), F.lit(" - "), named(title))


def full_name(artist: Column, title: Column) -> Column:
    """``artist - title``; null if either is."""
    return F.concat(artist, F.lit(" - "), title)


def reason_class(reason: Column) -> Column:
    """What stands before the first colon."""
    head = F.trim(F.split(F.coalesce(reason, F.lit("")), ":")[0])
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("UNKNOWN"))


def failure_class(message: Column, otherwise: str = "RESOLVE_ERROR") -> Column:
    found = F.lit(otherwise)
    for name, pattern in reversed(FAILURES):
        found = F.when(message.rlike(f"(?i){pattern}"), name).otherwise(found)
    return found


# Kinds of damage by what their lines contain; the first that fits counts.
DAMAGE = [("invalid page number", "invalid page number"), ("out of order", "rowid out of order"), ("depth differs", "page depth differs")]


def damage_kind(line: Column) -> Column:
    found = F.lit("other")
    for part, name in reversed(DAMAGE):
        found = F.when(F.contains(line, F.lit(part)), name).otherwise(found)
    return found


def damage_summary(df: DataFrame, line: str) -> DataFrame:
    """One row: kinds of damage with their numbers, by name; ``no problems`` without lines."""
    kinds = df.groupBy(damage_kind(F.col(line)).alias("kind")).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat("kind", F.lit(" x"), F.col("n").cast("string"))))
    return kinds.agg(F.coalesce(F.nullif(F.array_join(parts, " · "), F.lit("")), F.lit("no problems")).alias("summary"))


def clock(seconds: Column) -> Column:
    """mm:ss, h:mm:ss from an hour on, --:-- for what is no duration."""
    s = seconds.cast("double")
    whole = F.floor(F.when(F.isnan(s) | (s < 0) | (s == float("inf")), F.lit(0)).otherwise(s)).cast("long")
    r = whole % 60
    h, m = F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long")
    odd = s.isNull() | F.isnan(s) | (s < 0) | (s == float("inf"))
    return F.when(odd, "--:--").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def stamp(ms: Column) -> Column:
    """mm:ss of milliseconds; null stays null."""
    total = F.floor(ms / 1000).cast("long")
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d", F.floor(total / 60).cast("long"), total % 60))


def truncate(value: Column, width: int) -> Column:
    """At most ``width`` characters, the last one an ellipsis if any were cut."""
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width - 1), F.lit("…"))).otherwise(value)


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters that their decompositions start with."""
    of = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    of = {c: plain for c, plain in of.items() if plain != c and plain.isascii()}
    return "".join(of), "".join(of.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), *_accents())


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without diacritics."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """Terms of a search: blank-separated, cleaned, empty ones dropped."""
    cleaned = F.transform(F.split(F.lower(query), r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_]", ""))
    return F.filter(cleaned, lambda t: t != "")


def parse_lines(lyrics: Column) -> Column:
    """Timed lines of a lyrics text as (ts_ms, pos, text), by time and then place."""
    lines = F.transform(F.split(lyrics, r"\r\n|\r|\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("pos")))
    stamped = F.filter(lines, lambda s: s["line"].rlike(STAMPED))

    def read(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s["line"], STAMPED, i)
        fraction = part(3).cast("int") * F.when(F.length(part(3)) == 2, 10).otherwise(1)
        return F.struct((part(1).cast("int") * 60000 + part(2).cast("int") * 1000 + fraction).alias("ts_ms"), s["pos"].alias("pos"), F.trim(part(4)).alias("text"))

    return F.array_sort(F.filter(F.transform(stamped, read), lambda s: s["text"] != ""))


def plain_lines(lyrics: Column) -> Column:
    """The words of timed lyrics without their stamps."""
    return F.array_join(F.transform(parse_lines(lyrics), lambda s: s["text"]), "\n")


def best_line(plain: Column, synced: Column, query: Column) -> Column:
    """(ts_ms, text): a timed line with the phrase, else one with all words, else a plain line with the phrase."""
    phrase = F.lower(F.trim(query))
    words = F.filter(F.split(phrase, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    timed = parse_lines(synced)
    out = lambda ts, text: F.struct(ts.cast("int").alias("ts_ms"), text.alias("text"))
    first = lambda found: F.get(found, F.lit(0))
    exact = first(F.filter(timed, lambda s: F.contains(F.lower(s["text"]), phrase)))
    every = first(F.filter(timed, lambda s: (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.lower(s["text"]), w))))
    loose = first(F.filter(F.transform(F.split(plain, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: F.contains(F.lower(x), phrase)))
    none = out(F.lit(None), F.lit(""))
    return (
        F.when(F.coalesce(phrase, F.lit("")) == "", none)
        .when(exact.isNotNull(), out(exact["ts_ms"], exact["text"]))
        .when(every.isNotNull(), out(every["ts_ms"], every["text"]))
        .when(loose.isNotNull(), out(F.lit(None), loose))
        .otherwise(none)
    )


def display_width(value: Column) -> Column:
    """Terminal columns: two for wide East Asian characters, none for combining marks."""
    bare = F.regexp_replace(value, r"\p{M}", "")
    wide = r"[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"
    return F.length(bare) + F.length(bare) - F.length(F.regexp_replace(bare, wide, ""))
