"""Prefix full-text search and lyrics lines.

Texts become postings once; a search filters them by its terms, which Spark
pushes below the aggregation, and keeps documents that match every term. The
last term matches as a prefix. Terms are cleaned, so operators are plain words;
a term of punctuation alone is dropped.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.functions import text as tx
from auralake.operators.relational import first


def terms(query: str) -> list[str]:
    """The terms of a search string."""
    cleaned = [re.sub(r"[^\w]", "", t) for t in (query or "").lower().split()]
    return [t for t in cleaned if t]


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, key, place, pos): every token of the columns."""
    out = None
    for place, column in enumerate(columns):
        part = docs.select(F.posexplode(tx.tokens(F.col(column))).alias("pos", "term"), key, F.lit(place).alias("place")).select("term", key, "place", "pos")
        out = part if out is None else out.unionByName(part)
    return out


def matches(posted: DataFrame, key: str, query: str) -> DataFrame:
    """Keys of the documents that hold every term, the last one as a prefix."""
    wanted = terms(query)
    if not wanted:
        return posted.select(key).where("false")
    spark = posted.sparkSession
    folded = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "i int, t string").orderBy("i").select(tx.fold(F.col("t"))).collect()]
    hits = [(F.col("term") == t) if i < len(folded) - 1 else F.startswith(F.col("term"), F.lit(t)) for i, t in enumerate(folded)]
    asked = hits[0]
    for h in hits[1:]:
        asked = asked | h
    found = posted.where(asked).groupBy(key).agg(*[F.max(h).alias(f"t{i}") for i, h in enumerate(hits)])
    for i in range(len(hits)):
        found = found.where(F.col(f"t{i}"))
    return found.select(key)


def search(posted: DataFrame, entities: DataFrame, key: str, query: str, limit: int, title: str = "title", artist: str = "artist") -> DataFrame:
    """Entities that match, in order of their keys, one of each (title, artist), ``limit`` at most.

    As many as twice the limit are looked at before equal names are dropped.
    """
    pool = entities.join(matches(posted, key, query), key, "left_semi").orderBy(key).limit(2 * limit)
    named = pool.withColumn("_t", tx.key(F.col(title))).withColumn("_a", tx.key(F.col(artist)))
    return first(named, ["_t", "_a"], key).drop("_t", "_a").orderBy(key).limit(limit)


_TOKEN = re.compile(r"[^\W_]+")


def _snippet(text: str, wanted: list[str], size: int = 12) -> str:
    spots = list(_TOKEN.finditer(text or ""))
    hit = [any(m[0].lower() == t if i < len(wanted) - 1 else m[0].lower().startswith(t) for i, t in enumerate(wanted)) for m in spots]
    if not spots:
        return ""
    counts = [sum(hit[i : i + size]) for i in range(max(1, len(spots) - size + 1))]
    at = counts.index(max(counts))
    end = min(len(spots), at + size)
    out, last = [], spots[at].start() if at else 0
    for m, marked in zip(spots[at:end], hit[at:end], strict=True):
        out += [text[last : m.start()], f"<b>{m[0]}</b>" if marked else m[0]]
        last = m.end()
    return ("..." if at else "") + "".join(out) + ("..." if end < len(spots) else text[last:])


def with_snippet(found: DataFrame, text: str, query: str) -> DataFrame:
    """Add the stretch of at most twelve tokens with most matches, these marked."""
    wanted = terms(query)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _snippet(t, wanted))

    return found.withColumn("snippet", run(F.col(text)))


def with_line(found: DataFrame, plain: str, synced: str, query: str) -> DataFrame:
    """Add ts_ms and line of the lyrics line that fits the query best."""
    return found.withColumn("_line", tx.best_line(F.col(plain), F.col(synced), F.lit(query))).select("*", F.col("_line.ts_ms").alias("ts_ms"), F.col("_line.text").alias("line")).drop("_line")
