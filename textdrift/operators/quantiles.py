"""Exact quantiles by group without a group state that grows.

Values are counted, the counts are range-partitioned by (group, value), and every range sums its
own counts. The sums of the ranges before it give each range its first rank; a wanted rank is first
located among the ranges (a few numbers for each group) and then inside the one range that holds
it. No task ever holds a group: only a range, and Spark sizes ranges evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textdrift.session import ensure_checkpoint_dir


def quantiles(df: DataFrame, by, col: str, probabilities) -> DataFrame:
    """``by`` columns, ``n`` and ``quantiles``: the values of ``col`` at ``probabilities`` in their
    order, interpolated linearly between the two neighbouring ranks. NULL values don't count; a group
    with NULL values only has no row; a NULL group is a group."""
    ensure_checkpoint_dir(df.sparkSession)
    counts = df.where(F.col(col).isNotNull()).groupBy(F.struct(*by).alias("_g"), F.col(col).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    # the ranges are fixed by a reliable checkpoint, since sums and look-up must see the same ones
    cells = counts.repartitionByRange("_g", "_v").withColumn("_range", F.spark_partition_id()).checkpoint()
    ranges = cells.groupBy("_g", "_range").agg(F.sum("_n").alias("_inside"))
    earlier = Window.partitionBy("_g").orderBy("_range")
    ranges = ranges.withColumn("_before", F.sum("_inside").over(earlier) - F.col("_inside"))
    sizes = ranges.groupBy("_g").agg(F.sum("_inside").alias("n"))

    place = F.col("_p") * (F.col("n") - 1)
    wanted = sizes.select("_g", "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("_i", "_p"))
    wanted = wanted.select("_g", "n", "_i", (place - F.floor(place)).alias("_part"), F.explode(F.array(
        F.struct(F.lit(0).alias("end"), F.floor(place).alias("rank")),
        F.struct(F.lit(1).alias("end"), F.ceil(place).alias("rank")))).alias("_r"))
    wanted = wanted.select("_g", "n", "_i", "_part", F.col("_r.end").alias("_end"), F.col("_r.rank").alias("_rank"))
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_inside"))
    located = wanted.join(ranges, "_g").where(inside).withColumn("_rank", F.col("_rank") - F.col("_before"))

    within = Window.partitionBy("_range", "_g").orderBy("_v")
    needed = cells.join(located.select("_range", "_g").distinct(), ["_range", "_g"], "left_semi").withColumn(
        "_last", F.sum("_n").over(within))
    hit = located.join(needed, ["_range", "_g"]).where(
        (F.col("_rank") < F.col("_last")) & (F.col("_rank") >= F.col("_last") - F.col("_n")))
    ends = hit.groupBy("_g", "n", "_i", "_part").agg(
        F.max(F.when(F.col("_end") == 0, F.col("_v"))).alias("_low"),
        F.max(F.when(F.col("_end") == 1, F.col("_v"))).alias("_high"))
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    out = ends.groupBy("_g", "n").agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("x")))).alias("_q"))
    return out.select("_g.*", "n", F.col("_q.x").alias("quantiles"))
