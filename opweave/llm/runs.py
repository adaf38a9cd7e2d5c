"""Problem 6: runs of repeated consecutive events, collapsed by boundary interval lookup.

Positions are dense per entity; an entity's sequence is cut into chunks of ``chunk``
positions, each with the row before it as halo.  A task gathers the run-start positions
of a chunk into a sorted array, assigns every event to its run by binary search and
aggregates.  Only the first and last part of a chunk can belong to a run that crosses
chunks: those parts take their run start from the chunk before and are merged by key.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opweave.llm.lookalikes import LookalikeModel, rewriter
from opweave.plans.positions import with_positions
from opweave.session import cut, micros

_PART = "entity string, chunk bigint, run bigint, first_pos bigint, n bigint, first_key string, last_key string, start_us bigint, end_us bigint, ids array<string>, edge boolean"


def window_key(col: Column, model: LookalikeModel, spark) -> Column:
    """Consistent form without digits, whitespace, asterisks and case; null stays null."""
    shared = spark.sparkContext.broadcast(model)
    drop = re.compile(r"[\d\s*]+")

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        r = rewriter(shared)
        seen: dict[str, str] = {}
        return s.map(lambda t: t if t is None else seen[t] if t in seen else seen.setdefault(t, drop.sub("", r(t)).casefold()))

    return fold(col)


def _runs(chunk: int, max_gap_us: int):
    def complete(t: pa.Table) -> pa.RecordBatch:
        ent, ch, pos = t["entity"].to_pandas().to_numpy(), t["chunk"].to_numpy(), t["pos"].to_numpy()
        key, k = t["same"].to_pandas().to_numpy(), t["key"].to_pylist()
        start, end = t["start_us"].to_numpy(), t["end_us"].to_numpy()
        ids = t["ids"].to_pylist()
        n = len(pos)
        group = np.ones(n, bool)
        group[1:] = (ent[1:] != ent[:-1]) | (ch[1:] != ch[:-1])
        own = pos // chunk == ch
        cont = np.zeros(n, bool)
        cont[1:] = ~group[1:] & (key[1:] == key[:-1]) & (start[1:] <= end[:-1] + max_gap_us)
        rows = np.flatnonzero(own)
        starts = np.flatnonzero(own & ~cont)  # the sorted run starts
        first_of_group = np.flatnonzero(group)[np.cumsum(group) - 1]
        at = np.searchsorted(starts, rows, "right") - 1  # binary search of every event
        begin = np.where(at >= 0, starts[at] if len(starts) else 0, -1)
        begin = np.where(begin >= first_of_group[rows], begin, -1)  # -1: begins in an earlier chunk
        seg = np.ones(len(rows), bool)
        g = first_of_group[rows]
        seg[1:] = (begin[1:] != begin[:-1]) | (g[1:] != g[:-1])
        lo = np.flatnonzero(seg)
        hi = np.append(lo[1:], len(rows))[: len(lo)]
        a, z = rows[lo], rows[hi - 1]
        known = begin[lo] >= 0
        edge = ~known | (pos[z] % chunk == chunk - 1) | np.append(group[np.minimum(z[:-1] + 1, n - 1)], True)
        size = hi - lo
        keep = np.flatnonzero(edge | (size > 1))
        distinct = [list({x for r in range(a[i], z[i] + 1) for x in (ids[r] or ()) if x is not None}) for i in keep]
        latest = np.maximum.reduceat(end[rows], lo) if len(lo) else np.zeros(0, np.int64)
        a, z = a[keep], z[keep]
        return pa.RecordBatch.from_pydict(
            {
                "entity": pa.array(ent[a], pa.string()), "chunk": pa.array(ch[a]), "run": pa.array(pos[np.maximum(begin[lo][keep], 0)], mask=~known[keep]), "first_pos": pa.array(pos[a]), "n": pa.array(size[keep].astype(np.int64)),
                "first_key": pa.array([k[i] for i in a], pa.string()), "last_key": pa.array([k[i] for i in z], pa.string()), "start_us": pa.array(start[a]), "end_us": pa.array(latest[keep]), "ids": pa.array(distinct, pa.list_(pa.string())), "edge": pa.array(edge[keep]),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            ent, ch = t["entity"].to_pandas().to_numpy(), t["chunk"].to_numpy()
            other = np.flatnonzero((ent[:-1] != ent[-1]) | (ch[:-1] != ch[-1]))
            at = int(other[-1]) + 1 if len(other) else 0  # the last chunk may go on in the next batch
            if at:
                yield complete(t.slice(0, at).combine_chunks())
            held = t.slice(at)
        if held is not None and held.num_rows:
            yield complete(held.combine_chunks())

    return run


def _open_runs(parts: DataFrame, block: int = 4096) -> DataFrame:
    """(entity, chunk, open): start of the run that reaches into the chunk from an earlier one.

    One light row for each chunk; a window holds a block of chunks, another one row for each block."""
    last = parts.filter("edge").groupBy("entity", "chunk").agg(F.max("run").alias("known")).withColumn("block", F.floor(F.col("chunk") / block))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = last.withColumn("open", F.last("known", True).over(before(Window.partitionBy("entity", "block").orderBy("chunk"))))
    far = last.groupBy(F.col("entity").alias("fe"), F.col("block").alias("fb")).agg(F.max("known").alias("known"))
    far = far.select("fe", "fb", F.last("known", True).over(before(Window.partitionBy("fe").orderBy("fb"))).alias("earlier"))
    both = near.join(far, (F.col("entity") == F.col("fe")) & (F.col("block") == F.col("fb")), "left")
    return both.select("entity", "chunk", F.coalesce("open", "earlier").alias("open"))


def collapse_runs(df: DataFrame, entity: str, time: str, end: str, key: str, same: Column, ids: str, *, max_gap_s: float = 5, chunk: int = 2048) -> DataFrame:
    """(entity, first_key, last_key, n, n_ids, duration_ms): one row per maximal run of two or more events.

    Per entity each ``key`` counts once, ordered by (``time``, ``key``); neighbours belong together
    if ``same`` is equal (null equals null) and the later starts at most ``max_gap_s`` after the end of
    the earlier (null end: its start).  n_ids counts the distinct non-null ``ids``; duration runs from
    the first start to the latest end.  Rows without entity, time or key are left out."""
    rows = df.select(F.col(entity).alias("entity"), F.col(time).alias("time"), F.col(key).alias("key"), micros(time).alias("start_us"), F.coalesce(micros(end), micros(time)).alias("end_us"), F.coalesce(same, F.lit("\0")).alias("same"), F.col(ids).alias("ids"))
    rows = with_positions(rows, "entity", "time", "key").drop("time")
    c = F.floor(F.col("pos") / chunk).cast("long")
    where = F.when(F.col("pos") % chunk == chunk - 1, F.array(c, c + 1)).otherwise(F.array(c))
    rows = rows.select("entity", F.explode(where).alias("chunk"), "pos", "key", "start_us", "end_us", "same", "ids")
    # only runs of two or more and the parts at a chunk's edges are left: cut here, they are read several times
    parts = cut(rows.repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "pos").mapInArrow(_runs(chunk, int(max_gap_s * 1e6)), _PART))
    inner = parts.filter("not edge and n > 1").select("entity", "first_key", "last_key", "n", F.size("ids").cast("long").alias("n_ids"), "start_us", "end_us")
    edge = parts.filter("edge").join(_open_runs(parts), ["entity", "chunk"], "left").withColumn("run", F.coalesce("run", "open")).drop("open")
    stats = edge.groupBy("entity", "run").agg(
        F.min_by("first_key", "first_pos").alias("first_key"), F.max_by("last_key", "first_pos").alias("last_key"), F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")
    ).filter("n > 1")
    seen = edge.select(F.col("entity").alias("ie"), F.col("run").alias("ir"), F.explode("ids").alias("id")).groupBy("ie", "ir").agg(F.count_distinct("id").alias("n_ids"))
    merged = stats.join(seen, (F.col("entity") == F.col("ie")) & (F.col("run") == F.col("ir")), "left").select("entity", "first_key", "last_key", "n", F.coalesce("n_ids", F.lit(0)).cast("long").alias("n_ids"), "start_us", "end_us")
    out = inner.unionByName(merged)
    return out.select("entity", "first_key", "last_key", "n", "n_ids", F.floor((F.col("end_us") - F.col("start_us")) / 1000).cast("long").alias("duration_ms"))
