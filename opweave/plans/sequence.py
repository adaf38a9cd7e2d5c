"""Neighbour and running computations over sequences, in bounded chunks.

``lag``/``lead`` windows over an entity would sort a hot entity in one task.  Here rows
carry dense positions (plans.positions); windows run over chunks of ``CHUNK`` positions,
each with copies of the rows just before and after it (halo), and running counts add
the totals of earlier chunks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from opweave.plans.positions import group_totals, with_positions

CHUNK = 4096


def chunked(df: DataFrame, entity: str, pos: str = "pos", back: int = 1, ahead: int = 0, chunk: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """Rows with halo copies (column ``own`` marks originals) and the window of a chunk.

    Compute neighbours over the window first, then keep ``own`` rows."""
    c = F.floor(F.col(pos) / chunk).cast("long")
    at = F.col(pos) % chunk
    where = [F.array(c)]
    if back:
        where.append(F.when(at >= chunk - back, F.array(c + 1)))
    if ahead:
        where.append(F.when((at < ahead) & (c > 0), F.array(c - 1)))
    empty = F.array().cast("array<bigint>")
    targets = F.concat(where[0], *[F.coalesce(x, empty) for x in where[1:]])
    out = df.withColumn("chunk", F.explode(targets)).filter("chunk is not null").withColumn("own", F.floor(F.col(pos) / chunk) == F.col("chunk"))
    return out, Window.partitionBy(entity, "chunk").orderBy(pos)


def sequence(df: DataFrame, entity: str, time: str, key: str, back: int = 1, ahead: int = 0) -> tuple[DataFrame, WindowSpec]:
    """Positions and chunks in one go."""
    return chunked(with_positions(df, entity, time, key), entity, "pos", back, ahead)


def island_ids(df: DataFrame, entity: str, flag: Column, out: str, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Running count of ``flag`` per entity by position (1, 2, ...): the number of the island a row is in.

    Rows that still carry the ``chunk`` of ``sequence`` stay where they are; rows and chunk totals share one exchange."""
    x = df.withColumn("__f", F.when(flag, F.lit(1)).otherwise(F.lit(0)))
    c = "chunk" if "chunk" in df.columns else "__c"
    if c == "__c":
        x = x.withColumn(c, F.floor(F.col(pos) / chunk).cast("long"))
    x = x.filter(F.col(entity).isNotNull() & F.col(c).isNotNull())
    w = Window.partitionBy(entity, c).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    totals = group_totals(x, [entity, c], __n=F.sum("__f"))
    before = Window.partitionBy("__e").orderBy("__tc").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(entity).alias("__e"), F.col(c).alias("__tc"), "__n").select("__e", "__tc", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    y = x.withColumn("__in", F.sum("__f").over(w)).join(totals, (F.col(entity) == F.col("__e")) & (F.col(c) == F.col("__tc")))
    return y.withColumn(out, F.col("__off") + F.col("__in")).drop("__f", "__c", "__in", "__e", "__tc", "__off")
