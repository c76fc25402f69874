"""Joins, set maintenance and dedup as DataFrame rewrites.

None of these collects a group or relies on one side being small: aggregates are
partial before they are shuffled, and joins stay equi-joins, which AQE splits
where a key is hot. Null keys never match; what that means is said at each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auralake.operators.lineage import dealt

#: Rows of a group of agreeing rows that meet all its rows in one task.
PAIR_ROWS = 1024


def pending_work(entities: DataFrame, stages: dict[str, DataFrame | bool], key: str = "id") -> DataFrame:
    """Rows of ``entities`` that some stage has yet to do, with one boolean flag per stage.

    A stage is the table of what it has done (``key`` column), or a constant for
    one that is off (False) or has no table yet (True). Null keys in a done table
    hide nothing.
    """
    out, flags = entities, []
    for flag, done in stages.items():
        if isinstance(done, bool):
            out = out.withColumn(flag, F.lit(done))
        else:
            mark = f"_{flag}"
            out = out.join(done.select(key).distinct().withColumn(mark, F.lit(True)), key, "left").withColumn(flag, F.col(mark).isNull()).drop(mark)
        flags.append(F.col(flag))
    return out.where(reduce(Column.__or__, flags))


def without_stage(pending: DataFrame, off: str, flags: list[str]) -> DataFrame:
    """Pending work once a stage is switched off."""
    return pending.withColumn(off, F.lit(False)).where(reduce(Column.__or__, [F.col(f) for f in flags]))


def missing(entities: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return entities.join(done.select(key), key, "left_anti")


def gap(entities: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """(total, missing) in one row."""
    marked = entities.select(key).join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("_done").isNull()).alias("missing"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their keys; of several new ones the last by ``order``."""
    batch = last(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(batch.select(keys), keys, "left_anti").unionByName(batch)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` hasn't; of several the first by ``order``."""
    batch = first(new, keys, order) if order else new.dropDuplicates(keys)
    return old.unionByName(batch.join(old.select(keys), keys, "left_anti").select(old.columns))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key that occurs in ``new`` make way for the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def overwrite_columns(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of matched rows are overwritten, by null as well; the others stay."""
    side = patch.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(side, key, "left")
    return joined.select([F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def first(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The first row of each key: a partially aggregated minimum, so a hot key is no hot task."""
    by = F.struct(*([order] if isinstance(order, str) else order))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row")).select(*keys, "_row.*").select(df.columns)


def last(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    by = F.struct(*([order] if isinstance(order, str) else order))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*keys, "_row.*").select(df.columns)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(into, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(into) <= k)


def band_join(df: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """(a, b, gap): each pair of keys whose values are at most ``width`` apart, once, a before b by (value, key).

    A range join as an equi-join: a row looks for partners in its own cell of
    ``width`` and in the next, so rows are doubled on one side alone.
    """
    step = max(width, 1)
    cell = F.floor(F.col(value) / step)
    known = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"), cell.alias("cell"))
    low = known.select(F.col("k").alias("a"), F.col("v").alias("va"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    high = known.select(F.col("k").alias("b"), F.col("v").alias("vb"), "cell")
    near = (F.col("vb") - F.col("va")).between(0, width) & ((F.col("vb") > F.col("va")) | (F.col("b") > F.col("a")))
    return low.join(high, "cell").where(near).select("a", "b", (F.col("vb") - F.col("va")).alias("gap"))


def pairs_within(df: DataFrame, keys: list[str], key: str, carried: list[str] | None = None) -> DataFrame:
    """(a, b), a < b, of rows that agree on ``keys``, with ``carried`` columns of both as x_a and x_b; null keys agree with nothing.

    The pairs are as many as they are, so they are made by all cores: groups of one row
    go first, and of a large group ``PAIR_ROWS`` rows at a time meet all the others.
    """
    columns = [(key, "a", "b"), *((c, f"{c}_a", f"{c}_b") for c in carried or [])]
    size = F.count("*").over(W.partitionBy(*keys))
    known = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*keys, key]])).withColumn("_size", size).where("_size > 1")
    parts = F.ceil(F.col("_size") / PAIR_ROWS).cast("int")
    left = known.select(*keys, F.pmod(F.xxhash64(key), parts).cast("int").alias("_part"), *[F.col(c).alias(x) for c, x, _ in columns])
    right = known.select(*keys, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), *[F.col(c).alias(y) for c, _, y in columns])
    on = [*keys, "_part"]
    return dealt(left, *on).join(dealt(right, *on).hint("merge"), on).where("a < b")


def shared_counts(queries: DataFrame, postings: DataFrame, term: str, key: str) -> DataFrame:
    """(query, key, hits): terms that a query shares with another key, through the inverted index."""
    asked = queries.select(term, F.col(key).alias("query")).distinct()
    return asked.join(postings.select(term, key).distinct(), term).where(F.col("query") != F.col(key)).groupBy("query", key).agg(F.count("*").alias("hits"))


def candidates(queries: DataFrame, postings: DataFrame, term: str, key: str, limit: int = 20, least: int = 4) -> DataFrame:
    """The ``limit`` keys that share most terms with each query, then those with ``least`` or more."""
    ranked = top_per_group(shared_counts(queries, postings, term, key), ["query"], [F.desc("hits"), F.asc(key)], limit)
    return ranked.where(F.col("hits") >= least)


def blocks(queries: DataFrame, key: str, rows: int = 4096):
    """A stated query set in collected blocks of about ``rows`` rows, dealt by a hash of their keys."""
    n = max(1, -(-queries.count() // rows))
    for k in range(n):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else queries
        found = part.toPandas()
        if len(found):
            yield found
