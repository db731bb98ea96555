"""Order over a whole table without one window or task for all of it: range partitions, sorted apart, and their sums."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` in the folder that the cluster shares (``spark.checkpoint.dir``), so that what is read again is the same.

    Only on one machine, as in tests, a folder below the warehouse stands in for it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        spark.sparkContext.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def position(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Add the 0-based place in this order. Rows equal in it have places next to each other."""
    at = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(sums_before(at.groupBy(part.alias("_part")).agg(F.count("*").alias("n")))), part == F.col("_part")).withColumn(name, F.col("_before") + inside).drop("_at", "_part", "_before")


def sums_before(sizes: DataFrame) -> DataFrame:
    """(_part, _before): sums of n in the partitions before; there is one row for each partition."""
    rows, before = [], 0
    for p, n in sorted((r["_part"], r["n"]) for r in sizes.collect()):
        rows.append((p, before))
        before += n
    return sizes.sparkSession.createDataFrame(rows, "_part long, _before long")


def cumulative(counts: DataFrame, order: list[str], n: str = "n") -> DataFrame:
    """Add _before, the sum of ``n`` over the rows before in this order, which must tell rows apart."""
    at = cut(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id().cast("long")))
    inside = F.sum(n).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    before = sums_before(at.groupBy("_part").agg(F.sum(n).alias("n")))
    return at.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("_before", F.col("_before") + F.col("_inside")).drop("_inside", "_part")


def percentiles(df: DataFrame, column: str, levels: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Columns q0, q1, ... at the levels, at position (n - 1) p with linear interpolation, for each group of ``by``.

    Values are counted first and put in order by ranges, so no buffer holds the distinct values of a group. Nulls count nothing.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_x")).agg(F.count("*").alias("n"))
    placed = cumulative(counts, [*by, "_x"])
    of = placed.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_before").alias("_first"), F.sum("n").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)] or F.lit(True)  # without groups, one row is joined
    joined = placed.join(of if by else F.broadcast(of), same).select(*by, "_x", "n", (F.col("_before") - F.col("_first")).alias("_b"), "_all")
    aggs: list[Column] = []
    for i, level in enumerate(levels):
        at = (F.col("_all") - 1) * F.lit(float(level))
        for k, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("_b") <= place) & (place < F.col("_b") + F.col("n")), F.col("_x").cast("double"))).alias(f"_{k}{i}"))
    got = joined.groupBy(*by, "_all").agg(*aggs)
    share = lambda i, level: (F.col("_all") - 1) * F.lit(float(level)) - F.floor((F.col("_all") - 1) * F.lit(float(level)))
    return got.select(*by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share(i, p)).alias(f"q{i}") for i, p in enumerate(levels)])
