"""Statistics of evaluations, runs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auralake.operators.lineage import cut, partitions


def evaluation(outcomes: DataFrame, condition: str) -> DataFrame:
    """Per condition: trials, right at rank one, accepted, right but gated, mean similarity and margin."""
    return outcomes.groupBy(condition).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("rank1"),
        F.count_if(F.col("correct") & F.col("accepted")).alias("accepted"),
        F.count_if(F.col("correct") & ~F.col("accepted")).alias("gated"),
        F.avg("similarity").alias("similarity"),
        F.avg("margin").alias("margin"),
    )


def best_cut(df: DataFrame, score: str, label: str) -> DataFrame:
    """(accuracy, n): the best share of right answers when scores up to a cut are called 0 and the rest 1.

    Scores are counted by value, dealt by range and summed within ranges; the
    totals of earlier ranges, one row each, are joined back.
    """
    counted = df.groupBy(score).agg(F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones"))
    ranged = cut(counted.repartitionByRange(partitions(df), score).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("zeros").alias("z"), F.sum("ones").alias("o"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = totals.select("part", F.coalesce(F.sum("z").over(before), F.lit(0)).alias("z0"), F.coalesce(F.sum("o").over(before), F.lit(0)).alias("o0"))
    upto = W.partitionBy("part").orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    gain = F.sum(F.col("zeros") - F.col("ones")).over(upto)
    gained = ranged.withColumn("gain", gain).join(starts, "part").agg(F.lit(1).alias("one"), F.max(F.col("gain") + F.col("z0") - F.col("o0")).alias("most"))
    whole = ranged.agg(F.lit(1).alias("one"), F.sum("ones").alias("ones"), (F.sum("ones") + F.sum("zeros")).alias("n"))
    # The cut below all scores is the one that gains nothing.
    return gained.join(whole, "one").select(((F.col("ones") + F.greatest(F.coalesce("most", F.lit(0)), F.lit(0))) / F.col("n")).alias("accuracy"), "n")


def stage_seconds(events: DataFrame, key: str, stage: str, seconds: str, order: list[str]) -> DataFrame:
    """(stage, seconds): time from each entry of a key into a stage to its next entry."""
    after = F.lead(seconds).over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("_s", after - F.col(seconds)).groupBy(stage).agg(F.sum("_s").alias("seconds"))


def eta(remaining: DataFrame, rates: DataFrame, key: str, in_flight: int, unknown: float = 5.0) -> DataFrame:
    """(seconds): work left by each source's own rate, the mean of the known ones where it has none."""
    mean = rates.agg(F.lit(1).alias("one"), F.coalesce(F.avg("rate"), F.lit(unknown)).alias("_mean"))
    work = remaining.where(F.col("n") > 0).join(rates, key, "left")
    left = work.agg(F.lit(1).alias("one"), F.sum(F.col("n") * F.col("rate")).alias("_known"), F.sum(F.when(F.col("rate").isNull(), F.col("n"))).alias("_unknown"))
    return left.join(mean, "one").select(((F.coalesce("_known", F.lit(0.0)) + F.coalesce(F.col("_unknown") * F.col("_mean"), F.lit(0.0))) / max(1, in_flight)).alias("seconds"))
