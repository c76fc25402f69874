"""URL filters: allow and block rules found by hash prefixes.

Each URL is expanded into host-suffix and path-prefix expressions; the first 32
bits of their SHA-256 digests are equi-joined with those of the rules, the full
digests confirm a hit, and the longest rule that fits decides. DataFrame
functions only.

Hosts are the text after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased; paths run from there up to ``?``, ``#`` or the end. A rule
``host path`` fits its host and every subdomain, at label boundaries, if the
path starts with the rule's.

Defined results: a null URL or one without ``://`` has an empty host and path,
which no rule fits; where no rule fits, ``rule`` is null and the verdict is the
default. Of two rules of equal text the blocking one wins. Equal URLs get equal
answers, repeated rows stay repeated, other columns pass through unless they
have the name of an output. Empty tables of URLs or rules are legal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.llm.session import without

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PREFIX_HEX = 8
#: Rules up to this number are broadcast (about 200 bytes each); more are joined by a salted shuffle.
BROADCAST_RULES = 50_000
SALTS = 32


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every host suffix of so many labels with every path prefix of so many characters."""
    parts = F.split(host, r"\.", -1)
    hosts = F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: n <= F.size(parts))
    suffixes = F.transform(hosts, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    known = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length(path))
    prefixes = F.transform(known, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict; ``rules`` has host, path and verdict.

    The driver learns the number of rules and the distinct label counts and path
    lengths that occur in them, which the longest URL bounds.
    """
    known = rules.where("host is not null and path is not null").select(
        F.sha2(F.concat("host", "path"), 256).alias("digest"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.char_length("path").alias("length"),
    )
    shape = known.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("length").alias("lengths")).first()
    urls = df.select(url).distinct().select(F.col(url).alias("_url"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    asked = urls.select("_url", F.explode(F.array_distinct(expressions(F.col("host"), F.col("path"), sorted(shape.labels), sorted(shape.lengths)))).alias("expression"))
    asked = asked.select("_url", F.sha2("expression", 256).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    offered = known.select(F.substring("digest", 1, PREFIX_HEX).alias("short"), "digest", "rule", "verdict")
    if shape.n <= BROADCAST_RULES:
        met = asked.join(F.broadcast(offered), "short")
    else:
        salted = offered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("_url"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    best = (
        met.where("full = digest")
        .groupBy("_url")
        .agg(F.max(F.struct(F.char_length("rule").alias("long"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best"))
        .select("_url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    kept = without(df, "host", "path", "rule", "verdict") if url.lower() not in ("host", "path", "rule", "verdict") else df.select(url)
    joined = kept.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).join(best, F.col(url) == F.col("_url"), "left").drop("_url")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(host, path, verdict)")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM named JOIN rules r ON (named.host = r.host OR named.host LIKE '%.' || r.host) AND starts_with(named.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN fits USING (n)
"""
