"""Total order with places, by ranges of sort keys: no row passes through the driver or a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, together

#: Rows of a task before its own are numbered by monotonically_increasing_id: the place in the partition is below this bit.
_PARTITION_BIT = 33


def dictionary(*names: str) -> list[Column]:
    """Dictionary order (letters before case) of the columns, then their plain order, so that only equal names tie."""
    return [*(F.collate(n, "UNICODE") for n in names), *map(F.col, names)]


def dictionary_classes(df: DataFrame, *names: str) -> list[tuple[DataFrame, int]]:
    """For each name a table (name, class) and its size: distinct values but null, with numbers that rise (with gaps) as the dictionary has them; equal only where it tells no two apart (letters in two encodings).

    The names are told in one reading of df and sorted once each, so that rows may be sorted by numbers.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = cut(df.groupingSets([[c] for c in names], *names).agg(F.grouping_id().alias("_set")))

    def classes(k: int) -> tuple[DataFrame, int]:
        c = names[k]
        key = F.collate(c, "UNICODE")
        own = told.filter((F.col("_set") == (1 << len(names)) - 1 - (1 << (len(names) - 1 - k))) & F.col(c).isNotNull()).select(c)
        # ranges of keys, so that what is alike meets in one; ids rise from range to range
        ranked = cut(own.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
        return ranked.select(c, F.min("_id").over(Window.partitionBy(key)).alias("class")), ranked.count()

    return together(spark, *(lambda k=k: classes(k) for k in range(len(names))))


def placed(df: DataFrame, by: list[Column], column: str = "place", parts: int | None = None) -> DataFrame:
    """df with each row's place (from 0) in the order of by; rows that tie have neighbouring places, in any order.

    Rows are dealt by ranges of the sort keys (bounds from a sample, as for any sort) and sorted in their range, which is
    computed once; a range's first place is the sum of the counts of those before it, one number a range.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    held = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    within = F.col("_at").bitwiseAND((1 << _PARTITION_BIT) - 1)
    counts = {r["p"]: r["n"] for r in held.groupBy(F.shiftright("_at", _PARTITION_BIT).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    first, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        first.append((p, total))
        total += counts.get(p, 0)
    starts = df.sparkSession.createDataFrame(first, "_part int, _first long")
    # as many rows as ranges
    out = held.withColumn("_range", F.shiftright("_at", _PARTITION_BIT).cast("int")).join(F.broadcast(starts), F.col("_range") == F.col("_part"))
    return out.withColumn(column, F.col("_first") + within).drop("_at", "_range", "_part", "_first")
