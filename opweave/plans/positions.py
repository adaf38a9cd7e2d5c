"""Dense positions inside an entity without ever sorting the entity in one task.

An entity may hold a third of all rows, so a window over the entity alone would
put those rows into one sort.  Rows are ranked inside (entity, time bucket)
instead, and each bucket gets as offset the number of rows in the entity's
earlier buckets - a window over the bucket counts only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opweave.session import micros


def group_totals(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """Totals by ``keys`` of rows that are also used themselves, read from the same exchange.

    The optimizer would narrow this branch to its own columns, and then the input would be
    computed once for the rows and once more for the totals.  A first row kept whole makes
    both branches equal, so that one exchange serves both."""
    whole = F.first(F.struct(*df.columns)).alias("__whole")
    t = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()], whole)
    return t.filter(F.col("__whole").isNotNull() | F.col(next(iter(totals))).isNotNull()).drop("__whole")


def with_positions(df: DataFrame, entity: str, time: str, key: str, bucket_s: int = 900, out: str = "pos") -> DataFrame:
    """Adds ``out`` = 0, 1, 2 ... per ``entity`` by (``time``, ``key``); each ``key`` once.

    Redelivered rows (same entity, time and key) collapse to one row.  Rows with a
    null entity, time or key have no place in a sequence and are left out.
    An empty table gives an empty table."""
    df = df.filter(F.col(entity).isNotNull() & F.col(time).isNotNull() & F.col(key).isNotNull())
    bucket: Column = F.floor(micros(time) / F.lit(bucket_s * 1_000_000)).cast("long")
    df = df.withColumn("__b", bucket).filter("__b is not null")  # said here, or the join would infer it on one side only and no exchange were shared
    w = Window.partitionBy(entity, "__b").orderBy(time, key)
    ranked = (
        df.withColumn("__same", (F.lag(key).over(w) == F.col(key)) & (F.lag(time).over(w) == F.col(time)))
        .filter(~F.coalesce(F.col("__same"), F.lit(False)))
        .drop("__same")
        .withColumn("__rn", F.row_number().over(w))
    )
    counts = group_totals(ranked, [entity, "__b"], __n=F.max("__rn"))
    before = Window.partitionBy(entity).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(entity).alias("__e"), F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    joined = ranked.join(offsets, (F.col(entity) == F.col("__e")) & (F.col("__b") == F.col("__ob")))
    return joined.withColumn(out, F.col("__off") + F.col("__rn") - 1).drop("__b", "__rn", "__e", "__ob", "__off")
