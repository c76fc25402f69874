"""Line dedup: maximal repeated runs of lines, by a suffix array over line ids.

Non-blank lines get ids and every document is a sequence of ids. A line that
occurs once ends every repeat, so the suffixes are those of the stretches of
repeated lines alone. Prefix doubling ranks them by ever more leading lines: a
rank of 2h lines is that of the pair (rank of h lines here, rank of h lines h
further on), until no rank splits any more. Ranks come from one
range-partitioned sort of the distinct pairs, whose partition and row numbers
increase with the order, so no task sees more than its range and a pair that
millions share is one row; pairs go back to suffixes with the hot ones
broadcast.

Suffixes of one final rank share the rest of their stretches. The others stand
alone in the array, between two neighbours; how many lines they share with these
is found by walking down the ranks of all depths, h = 2 ** t lines at a time.
The larger of both is the longest repeat that starts there, and those that no
repeat further left contains are the document's maximal repeated runs. Intervals
of the array whose common prefix is ``min_lines`` or more have one first place,
by key and place; the lines under every later one are deleted. (All later copies
of all longer runs consist of such.)

DataFrame functions only. Line equality is that of two 64-bit hashes.

Defined results: lines are separated by ``\\n``; those of white space alone
(space, tab, CR, VT, FF) belong to no run and stay. A null text has no lines and
stays null; an empty one stays empty. Texts may have any length. Rows with equal
key and text are one document and treated alike; null keys come last. An empty
table gives an empty one. Extra columns pass through; outputs replace columns of
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auralake.llm.session import join_unique, materialise, without

MIN_LINES = 1
BLANKS = " \t\r\x0b\f"
PLACE = ("k", "mark", "pos")


def _solid(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def line_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, mark, pos, h1, h2): every non-blank line by document and place."""
    lines = F.filter(F.split(F.col(text), "\n", -1), _solid)
    placed = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("mark"), F.posexplode(lines).alias("pos", "line"))
    return placed.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _place() -> Column:
    return F.struct(F.col("k").isNull().alias("none"), *PLACE)


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) with a rank that grows with them."""
    return materialise(pairs.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id()))


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, mark, pos, rank, first, reach): the lines that occur in other places too.

    Equal lines have equal ranks and the same first place; ``reach`` is the
    number of repeated lines from here on, this one included.
    """
    lines = materialise(line_ids(df, key, text))
    ranks = _ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "h1", "h2")
    total = ranks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = materialise(join_unique(lines, ranks, ["h1", "h2"], "n", max(total, 1)).select(*PLACE, "rank").distinct())
    firsts = met.groupBy("rank").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")  # rows that repeat are one
    kept = join_unique(met, firsts, ["rank"], "n", max(total, 1))
    doc = W.partitionBy("k", "mark")
    stretch = kept.withColumn("stretch", F.col("pos") - F.row_number().over(doc.orderBy("pos")))
    reach = F.max("pos").over(W.partitionBy("k", "mark", "stretch")) - F.col("pos") + 1
    return materialise(stretch.select(*PLACE, "rank", "first", reach.alias("reach"), F.count("*").over(W.partitionBy("k", "mark", "stretch")).alias("stretch")))


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Tables (k, mark, pos, rank, reach, r0, r1): ranks by 1, 2, 4, ... leading lines, the last ones final.

    r0 and r1 are the ranks by one and by two lines. Stretches of one line are left out.
    """
    tables = [materialise(lines.where("stretch > 1").select(*PLACE, "rank", "reach", F.col("rank").alias("r0"), F.lit(None).cast("long").alias("r1")))]
    total, classes = tables[0].agg(F.count("*"), F.countDistinct("rank")).first()
    while total:
        step = 1 << (len(tables) - 1)
        ahead = F.max("rank").over(W.partitionBy("k", "mark").orderBy("pos").rangeBetween(step, step))
        there = F.when(F.col("reach") > step, ahead).otherwise(-1)  # the end comes first
        paired = materialise(tables[-1].select(*PLACE, F.col("rank").alias("here"), there.alias("there"), "reach", "r0", "r1"), total)
        ranks = _ranked(paired.groupBy("here", "there").agg(F.count("*").alias("n")), "here", "there")
        found = ranks.count()
        if found == classes and step > 1:
            break
        second = F.col("rank") if step == 1 else F.col("r1")
        tables.append(materialise(join_unique(paired, ranks, ["here", "there"], "n", total).select(*PLACE, "rank", "reach", "r0", second.alias("r1")), total))
        classes = found
    return tables


def _neighbours(classes: DataFrame) -> DataFrame:
    """(i, j): each class of the array with the one before; a class is a struct."""
    ordered = materialise(classes.repartitionByRange("rank").select(F.spark_partition_id().alias("part"), "rank", F.struct("rank", *PLACE, "r0", "r1").alias("i")))
    # The last class of each range, one row a partition, is the one before the next range's first.
    lasts = ordered.groupBy("part").agg(F.max_by("i", "rank").alias("last"))
    edges = lasts.select("part", F.lag("last").over(W.orderBy("part")).alias("last"))
    inside = ordered.withColumn("j", F.lag("i").over(W.partitionBy("part").orderBy("rank")))
    return inside.join(F.broadcast(edges), "part").select("i", F.coalesce("j", "last").alias("j")).where("j is not null")


def _common(pairs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``pairs`` (i, j) with ``lcp``, the number of leading lines that both share."""
    shallow = (F.col("i.r0") == F.col("j.r0")).cast("int")
    pairs = materialise(pairs.withColumn("lcp", shallow).withColumn("deep", F.coalesce(F.col("i.r1") == F.col("j.r1"), F.lit(False))))
    deep = pairs.where("deep").withColumn("lcp", F.lit(0))
    for t in range(len(tables) - 1, -1, -1):
        for side in ("i", "j"):
            at = tables[t].select(*[F.col(c).alias(f"_{c}") for c in PLACE], F.col("rank").alias(f"_{side}_rank"), F.col("reach").alias(f"_{side}_reach"))
            here = F.col(f"{side}.k").eqNullSafe(F.col("_k")) & (F.col(f"{side}.mark") == F.col("_mark")) & (F.col(f"{side}.pos") + F.col("lcp") == F.col("_pos"))
            deep = deep.join(at, here, "left").drop(*[f"_{c}" for c in PLACE])
        same = F.coalesce(F.col("_i_rank") == F.col("_j_rank"), F.lit(False))
        gained = F.when(same, F.least(F.lit(1 << t), F.col("_i_reach"))).otherwise(0)
        deep = materialise(deep.select("i", "j", (F.col("lcp") + gained).cast("int").alias("lcp")))
    return pairs.where("not deep").select("i", "j", "lcp").unionByName(deep)


def _longest(lines: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(k, mark, pos, length): the longest repeat that starts at each repeated line."""
    last = tables[-1]
    one = F.min(F.struct(_place().alias("place"), "r0", "r1")).alias("one")
    sized = last.groupBy("rank").agg(one, F.count("*").alias("n"))
    classes = materialise(sized.select("rank", "n", *[F.col(f"one.place.{c}").alias(c) for c in PLACE], "one.r0", "one.r1"))
    found = _common(_neighbours(classes), tables)
    both = found.select("i.rank", "lcp").unionByName(found.select("j.rank", "lcp"))
    best = both.groupBy("rank").agg(F.max("lcp").alias("lcp"))
    lone = classes.where("n = 1").join(best, "rank", "left").select(*PLACE, F.greatest(F.coalesce("lcp", F.lit(1)), F.lit(1)).alias("length"))
    shared = join_unique(last, classes.where("n > 1").select("rank", "n"), ["rank"], "n", max(last.count(), 1)).select(*PLACE, F.col("reach").alias("length"))
    alone = lines.where("stretch = 1").select(*PLACE, F.lit(1).alias("length"))
    return alone.unionByName(shared).unionByName(lone)


def repeated_runs(lines: DataFrame, tables: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame:
    """(k, mark, start, length): the maximal repeated runs of every document, in non-blank lines."""
    ends = F.col("pos") + F.col("length")
    before = F.max(ends).over(W.partitionBy("k", "mark").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return _longest(lines, tables).withColumn("before", before).where((ends > F.coalesce("before", F.lit(0))) & (F.col("length") >= min_lines)).select("k", "mark", F.col("pos").alias("start"), "length")


def later_lines(lines: DataFrame, tables: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame:
    """(k, mark, pos) of the lines under later copies of runs of ``min_lines`` or more; they may repeat."""
    if min_lines == 1:
        return lines.where(_place() > F.col("first")).select(*PLACE)
    depth = min(min_lines.bit_length() - 1, len(tables) - 1)
    rest = max(min_lines - (1 << depth), 0)
    ahead = F.max("rank").over(W.partitionBy("k", "mark").orderBy("pos").rangeBetween(rest, rest))
    windows = materialise(tables[depth].select(*PLACE, "rank", "reach", ahead.alias("ahead")).where(F.col("reach") >= min_lines))
    firsts = windows.groupBy("rank", "ahead").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_unique(windows, firsts, ["rank", "ahead"], "n", max(windows.count(), 1)).where(_place() > F.col("first"))
    return later.select("k", "mark", F.explode(F.sequence(F.col("pos"), F.col("pos") + min_lines - 1)).alias("pos"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``df`` with n_lines and n_deleted (both without blank lines), the text left as ``kept``, and its maximal repeated runs.

    ``runs`` are (start, length) in non-blank lines, by start; first places count as well as later ones.
    """
    lines = repeated_lines(df, key, text)
    tables = suffix_ranks(lines)
    runs = repeated_runs(lines, tables, min_lines).select("k", "mark", F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).alias("run"), F.lit(None).cast("int").alias("pos"))
    gone = later_lines(lines, tables, min_lines).select("k", "mark", F.lit(None).cast("struct<start:bigint,length:bigint>").alias("run"), "pos")
    found = runs.unionByName(gone).groupBy(F.col("k").alias("_k"), F.col("mark").alias("_m")).agg(F.sort_array(F.collect_list("run")).alias("_runs"), F.collect_set("pos").alias("_gone"))
    base = without(df, "n_lines", "n_deleted", "runs", "kept", "_k", "_m", "_runs", "_gone", "_split", "_solid")
    joined = base.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_m")), "left")
    # Columns of their own, each used twice, so that no lambda splits the text again for every line.
    worked = joined.withColumn("_split", F.split(F.col(text), "\n", -1))
    numbers = F.transform("_split", lambda x, i: F.when(_solid(x), i))
    worked = worked.withColumn("_solid", F.filter(numbers, lambda i: i.isNotNull()))
    drop = F.transform("_gone", lambda p: F.get("_solid", p))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), drop)
    some = F.size("_gone") > 0
    return worked.select(
        *base.columns,
        F.coalesce(F.when(F.col(text).isNotNull(), F.size("_solid")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(some, F.size("_gone")).otherwise(0).cast("long").alias("n_deleted"),
        F.when(some, F.array_join(F.transform(left, lambda i: F.get("_split", i)), "\n")).otherwise(F.col(text)).alias("kept"),
        F.coalesce("_runs", F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("runs"),
    )


def op7_line_runs(spark, sf_dir: str) -> DataFrame:
    """Every document less the later copies of repeated line runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["length"])), F.lit(0).cast("long"))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest_run"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH RECURSIVE every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
solid AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM every
  WHERE length(translate(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12), '')) > 0),
grow(doc_id, pos, n, run) AS (
  SELECT doc_id, pos, 1, md5(line) FROM (SELECT *, count(*) OVER (PARTITION BY line) AS times FROM solid) x WHERE times > 1
  UNION ALL
  SELECT doc_id, pos, n, run FROM (
    SELECT g.doc_id, g.pos, g.n + 1 AS n, md5(g.run || s.line) AS run, count(*) OVER (PARTITION BY g.run, s.line) AS times
    FROM grow g JOIN solid s ON s.doc_id = g.doc_id AND s.pos = g.pos + g.n) x WHERE times > 1),
longest AS (SELECT doc_id, pos, max(n) AS n FROM grow GROUP BY doc_id, pos),
maximal AS (
  SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM (
    SELECT doc_id, pos, n, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM longest) x WHERE before IS NULL OR pos + n > before GROUP BY doc_id),
nth AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM solid),
texts AS (
  SELECT doc_id, count(nth) AS n_lines, count(*) FILTER (WHERE nth > 1) AS n_deleted,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE nth IS NULL OR nth = 1), '')) AS kept_sha256
  FROM every LEFT JOIN nth USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
  coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(longest_run, 0)::BIGINT AS longest_run, kept_sha256
FROM documents LEFT JOIN texts USING (doc_id) LEFT JOIN maximal USING (doc_id)
"""
