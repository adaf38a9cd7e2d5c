"""Problem 2: frequent gapped subsequences by vertical identifier lists.

Every frequent step keeps a list of (entity, position) pairs, and so does every frequent
pattern: the places where an occurrence of it ends.  The lists are kept from level to
level.  Level k extends the lists of level k - 1 by a temporal join with the steps' lists
(next place at most ``max_gap`` further on), once; new patterns are counted by distinct
entities, and only the frequent ones' lists are taken into the next level.

Distribution: an entity's sequence is cut into blocks of ``block`` positions with a
halo as long as a pattern can reach, so that an occurrence is found in the block of
its first step and no task holds a long entity.  A row is a block with its lists, flat
and sorted.  Blocks of entities that fit in one block count their entities at once; only
longer entities are made distinct by shuffle.

A pattern is known by (number of its prefix among the frequent patterns of the level
before, number of its last step), so that a code never outgrows 64 bits.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opweave.plans.positions import with_positions
from opweave.session import cut

MAX_BROADCAST = 2_000_000  # frequent patterns of a level the workers hold; more are joined by shuffle, none is dropped


def step_name(type_col: Column | str, app_col: Column | str) -> Column:
    """Trimmed upper-case type, '@', trimmed lower-case app ('-' if null)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    t = F.upper(F.regexp_replace(c(type_col), r"(?U)^\s+|\s+$", ""))
    a = F.lower(F.regexp_replace(c(app_col), r"(?U)^\s+|\s+$", ""))
    return F.concat(F.coalesce(t, F.lit("-")), F.lit("@"), F.coalesce(a, F.lit("-")))


def step_lists(df: DataFrame, entity: str, step_id: str, pos: str, block: int, halo: int) -> DataFrame:
    """Level 1: (entity, b, whole, steps, places): the steps' lists of each block by place, places relative to the block.

    ``whole``: the entity fits in this block.  Places of ``block`` and more are halo: no pattern begins there."""
    b = F.floor(F.col(pos) / block).cast("long")
    rows = df.select(F.col(entity).alias("entity"), F.col(step_id).alias("step"), F.col(pos).alias("pos"), b.alias("b"))
    targets = F.when((F.col("pos") % block < halo) & (F.col("b") > 0), F.array(F.col("b"), F.col("b") - 1)).otherwise(F.array("b"))
    rows = rows.select("entity", "step", "pos", F.explode(targets).alias("b")).withColumn("place", (F.col("pos") - F.col("b") * block).cast("int"))
    g = rows.groupBy("entity", "b").agg(F.array_sort(F.collect_list(F.when(F.col("step") >= 0, F.struct("place", "step")))).alias("x"), F.max("place").alias("last"))
    return g.select("entity", "b", ((F.col("b") == 0) & (F.col("last") < block)).alias("whole"), F.col("x.step").alias("steps"), F.col("x.place").alias("places"))


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    lists = b.column(name)
    off = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], np.repeat(np.arange(len(off) - 1), np.diff(off))


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    off = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def temporal_join(row: np.ndarray, end: np.ndarray, step_row: np.ndarray, place: np.ndarray, max_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (list entry, step entry) of one row with the step 1..max_gap places after the entry's end; all sorted by row, place."""
    width = np.int64(1) << 40
    at = step_row * width + place
    lo = np.searchsorted(at, row * width + end, "right")
    hi = np.searchsorted(at, row * width + end + max_gap, "right")
    n = hi - lo
    src = np.repeat(np.arange(len(row)), n)
    return src, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Indices of the first of each distinct key tuple, in key order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order[new]


_STATE = "entity string, b bigint, whole boolean, steps array<int>, places array<int>, codes array<bigint>, ends array<int>"


def _extend(n_steps: int, max_gap: int, block: int, frequent, first: bool, cells: int = 400_000):
    """One level: lists of the frequent patterns of the level before -> lists of their extensions.

    ``frequent``: broadcast sorted codes of the level before, whose rank is the pattern's number; None: codes are numbers already."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        steps, srow = _flat(b, "steps")
        places, _ = _flat(b, "places")
        if first:  # the lists of single steps, where a pattern may begin
            own = np.flatnonzero(places < block)
            code, row, end = steps[own].astype(np.int64), srow[own], places[own]
        else:
            code, row = _flat(b, "codes")
            end, _ = _flat(b, "ends")
            if frequent is not None:
                table = frequent.value
                at = np.searchsorted(table, code)
                at[at == len(table)] = 0
                keep = np.flatnonzero(table[at] == code) if len(table) else np.zeros(0, np.int64)
                code, row, end = at[keep], row[keep], end[keep]
        src, nxt = temporal_join(row, end.astype(np.int64), srow, places.astype(np.int64), max_gap)
        code2, row2, end2 = code[src].astype(np.int64) * n_steps + steps[nxt], row[src], places[nxt]
        one = _distinct(row2, code2, end2)  # a list holds each place once
        return pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("entity", "b", "whole", "steps", "places")), _lists(code2[one], row2[one], b.num_rows, pa.int64()), _lists(end2[one].astype(np.int32), row2[one], b.num_rows, pa.int32())],
            names=["entity", "b", "whole", "steps", "places", "codes", "ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("steps" if first else "codes").offsets.to_numpy()) + 1
            group = np.cumsum(size) // cells
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield step(b.slice(i, j - i))

    return run


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns of each block's lists: those of whole entities counted, of longer ones by entity."""
    for b in batches:
        code, row = _flat(b, "codes")
        one = _distinct(row, code)
        code, row = code[one], row[one]
        whole = b.column("whole").to_numpy(zero_copy_only=False)[row]
        codes, n = np.unique(code[whole], return_counts=True)
        yield pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int64()), "entity": pa.nulls(len(codes), pa.string()), "n": pa.array(n.astype(np.int64))})
        rest = np.flatnonzero(~whole)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code[rest], pa.int64()), "entity": b.column("entity").take(pa.array(row[rest])), "n": pa.array(np.ones(len(rest), np.int64))})


def _keep_by_join(lists: DataFrame, ranked: DataFrame) -> DataFrame:
    """The lists of the frequent patterns only, coded by rank, where these are too many for the workers to hold."""
    flat = lists.select("entity", "b", F.explode(F.arrays_zip("codes", "ends")).alias("x")).select("entity", "b", F.col("x.codes").alias("code"), F.col("x.ends").alias("end"))
    kept = flat.join(ranked, "code").groupBy("entity", "b").agg(F.array_sort(F.collect_list(F.struct("rank", "end"))).alias("y"))
    out = lists.drop("codes", "ends").join(kept, ["entity", "b"])
    return out.select("entity", "b", "whole", "steps", "places", F.col("y.rank").alias("codes"), F.col("y.end").alias("ends"))


def _rank(freq: DataFrame) -> DataFrame:
    """(code, rank): numbers from 0 in an order of their own; no window over all patterns."""
    return freq.select("code").rdd.map(lambda r: r[0]).zipWithIndex().toDF("code long, rank long")


def frequent_subsequences(
    df: DataFrame, entity: str, step: Column, time: str, key: str, *, min_steps: int = 3, max_steps: int = 4, max_gap: int = 3, min_share: float = 0.15, min_support: int = 5, block: int = 4096
) -> DataFrame:
    """(pattern, n_steps, support): patterns of ``min_steps``..``max_steps`` steps held by enough entities.

    Per entity each ``key`` counts once, ordered by (``time``, ``key``); a step lies at most
    ``max_gap`` places after the one before.  Enough: at least ``min_share`` of all entities of
    ``df`` (rounded up) and ``min_support``.  Rows without entity, time or key hold no place; an
    entity whose rows all lack them still counts among all.  A null step is the step '-@-'.
    Empty input gives an empty result.  Columns not named are not read."""
    spark = df.sparkSession
    base_cols = df.select(F.col(entity).alias("entity"), F.col(time).alias("time"), F.col(key).alias("key"), step.alias("step"))
    n_entities = base_cols.filter("entity is not null").agg(F.count_distinct("entity")).first()[0]
    need = max(min_support, math.ceil(round(n_entities * min_share, 9)))
    seq = with_positions(base_cols, "entity", "time", "key")
    # level 1; the dictionary of frequent steps holds at most (mean steps per entity) / min_share names
    ones = [r[0] for r in base_cols.filter("time is not null and key is not null").groupBy("step").agg(F.count_distinct("entity").alias("n")).filter(F.col("n") >= need).orderBy("step").select("step").collect()]
    out = spark.createDataFrame([], "pattern string, n_steps int, support int")
    if not ones:
        return out
    ids = spark.createDataFrame(list(enumerate(ones)), "sid int, sname string")
    rows = seq.join(F.broadcast(ids), F.col("step") == F.col("sname"), "left").select("entity", "pos", F.coalesce("sid", F.lit(-1)).alias("sid"))
    lists = cut(step_lists(rows, "entity", "sid", "pos", block, (max_steps - 1) * max_gap))
    named = ids.select(F.col("sid").cast("long").alias("rank"), F.col("sname").alias("pattern"))  # the frequent patterns of the level before, numbered
    frequent = None
    for k in range(2, max_steps + 1):
        lists = lists.mapInArrow(_extend(len(ones), max_gap, block, frequent, k == 2), _STATE)
        if k < max_steps:
            lists = cut(lists)
        hits = lists.select("entity", "whole", "codes").mapInArrow(_support, "code bigint, entity string, n bigint")
        once = hits.filter("entity is null").groupBy("code").agg(F.sum("n").alias("n"))
        longer = hits.filter("entity is not null").select("code", "entity").distinct().groupBy("code").agg(F.count("*").alias("n"))
        freq = cut(once.unionByName(longer).groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= need))
        before = named.select(F.col("rank").alias("prefix"), F.col("pattern").alias("start"))
        full = freq.join(before, F.floor(F.col("code") / len(ones)) == F.col("prefix")).join(F.broadcast(ids), F.col("code") % len(ones) == F.col("sid"))
        full = full.select("code", "n", F.concat_ws(" > ", "start", "sname").alias("pattern"))
        if k >= min_steps:
            out = out.unionByName(full.select("pattern", F.lit(k).alias("n_steps"), F.col("n").cast("int").alias("support")))
        if k == max_steps:
            break
        some = freq.select("code").limit(MAX_BROADCAST + 1).toPandas()["code"].to_numpy()
        if len(some) <= MAX_BROADCAST:
            table = np.sort(some.astype(np.int64))
            frequent = spark.sparkContext.broadcast(table)
            ranked = spark.createDataFrame([(int(c), i) for i, c in enumerate(table)], "code long, rank long")
        else:
            frequent, ranked = None, cut(_rank(freq))
            lists = _keep_by_join(lists, ranked)
        named = cut(full.join(ranked, "code").select("rank", "pattern"))
    return out
