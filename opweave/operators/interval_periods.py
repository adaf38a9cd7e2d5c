"""Problem 3: continuous periods and gaps of overlapping, nested and touching intervals.

The state of the aggregate is a list of sorted, disjoint intervals.  Every input
batch folds its rows into such lists per (entity, time slice), partial lists are
combined by linear merge in a reduction tree (batch -> salted group -> slice), and
slices are stitched by a scan over one summary row per slice, so that no task ever
holds the intervals of a whole entity.  Emitting writes lists and complements.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR_MS = 3_600_000
LIST = "array<bigint>"


def parse_ms(c: Column) -> Column:
    """Epoch ms of an ISO-8601 date-time text with zone designator, else null (unreadable)."""
    t = F.trim(c)
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|z|[+-]\d{2}(:?\d{2})?)$"
    t = F.regexp_replace(F.regexp_replace(t, r"\s+(?=[Zz+-])", ""), ",", ".")
    t = F.regexp_replace(F.regexp_replace(t, "z$", "Z"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?[+-]\d{2})$", "$1:00")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2})(?=Z|[+-])", "$1:00")
    t = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.when(F.trim(c).rlike(iso), F.floor(F.unix_micros(t.try_cast("timestamp")) / 1000))


def merge_disjoint(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals given as concatenated sorted lists; touching ones are merged.

    The stable sort (timsort) finds the sorted runs and merges them linearly."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return s[new], e[last]


def _merge_lists(s_lists: pd.Series, e_lists: pd.Series) -> pd.DataFrame:
    """Row-wise linear merge of a list of partial lists."""
    out_s, out_e = [], []
    for ss, ee in zip(s_lists, e_lists):
        s, e = merge_disjoint(np.concatenate(list(ss)), np.concatenate(list(ee)))
        out_s.append(s)
        out_e.append(e)
    return pd.DataFrame({"s": out_s, "e": out_e})


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf of the tree: the rows of a batch become one sorted disjoint list per (entity, slice)."""
    for b in batches:
        df = b.to_pandas()
        if df.empty:
            continue
        df = df.sort_values(["entity", "slice", "s"], kind="stable")
        ent, sl = df["entity"].to_numpy(), df["slice"].to_numpy()
        s, e = df["s"].to_numpy(), df["e"].to_numpy()
        edge = np.concatenate([[True], (ent[1:] != ent[:-1]) | (sl[1:] != sl[:-1])])
        at = np.append(np.flatnonzero(edge), len(df))
        lists = [merge_disjoint(s[i:j], e[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_pydict(
            {
                "entity": pa.array(ent[at[:-1]], pa.string()),
                "slice": pa.array(sl[at[:-1]], pa.int64()),
                "s": pa.array([x for x, _ in lists], pa.list_(pa.int64())),
                "e": pa.array([x for _, x in lists], pa.list_(pa.int64())),
            }
        )


def _combine(df: DataFrame, *keys: str) -> DataFrame:
    """One level of the reduction tree."""
    merged = F.pandas_udf(_merge_lists, f"s {LIST}, e {LIST}")
    return (
        df.groupBy(*keys)
        .agg(F.collect_list("s").alias("ss"), F.collect_list("e").alias("ee"))
        .select(*keys, merged("ss", "ee").alias("m"))
        .select(*keys, F.col("m.s").alias("s"), F.col("m.e").alias("e"))
    )


def _absorb(s_lists: pd.Series, e_lists: pd.Series, carry: pd.Series) -> pd.DataFrame:
    """Merges each slice's list with the latest end of all earlier slices.

    absorbed: latest end of the intervals that continue an earlier period, or null;
    s, e: the periods that begin in this slice."""
    out = {"absorbed": [], "s": [], "e": []}
    for s, e, c in zip(s_lists, e_lists, carry):
        s, e = np.asarray(s, "int64"), np.asarray(e, "int64")
        k, top = 0, c
        if c == c and c is not None:
            while k < len(s) and s[k] <= top:
                top = max(top, e[k])
                k += 1
        out["absorbed"].append(int(top) if k else None)
        out["s"].append(s[k:])
        out["e"].append(e[k:])
    return pd.DataFrame({"absorbed": pd.array(out["absorbed"], "Int64"), "s": out["s"], "e": out["e"]})


def interval_periods(
    df: DataFrame, entity: str, start_ms: Column, end_ms: Column, slice_ms: int = 6 * HOUR_MS, max_gap_ms: int | None = 8 * HOUR_MS, fan_in: int = 16
) -> DataFrame:
    """(entity, kind 'period' | 'gap', start_ms, end_ms).

    Intervals with a null bound or end <= start are ignored; a null entity is an entity of
    its own; touching intervals merge; repeated ones add nothing.  A gap lies between two
    consecutive periods of an entity and is shorter than ``max_gap_ms`` (None: any length).
    Other columns of ``df`` are not read.  Empty input gives an empty result.

    Memory: a list holds the disjoint intervals starting in one slice of one entity; carry
    and stitching windows see one row per (entity, slice)."""
    rows = df.select(F.col(entity).cast("string").alias("entity"), start_ms.cast("long").alias("s"), end_ms.cast("long").alias("e")).filter("e > s")
    rows = rows.select("entity", F.floor(F.col("s") / F.lit(slice_ms)).cast("long").alias("slice"), "s", "e")
    leaf = rows.mapInArrow(_partials, f"entity string, slice bigint, s {LIST}, e {LIST}")
    salted = leaf.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    lists = _combine(_combine(salted, "entity", "slice", "salt").drop("salt"), "entity", "slice")
    lists = lists.withColumn("top", F.element_at("e", -1))
    by = Window.partitionBy("entity").orderBy("slice")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    absorb = F.pandas_udf(_absorb, f"absorbed bigint, s {LIST}, e {LIST}")
    x = (
        lists.withColumn("carry", F.max("top").over(past))
        .withColumn("m", absorb("s", "e", F.col("carry")))
        .select("entity", "slice", F.col("m.absorbed").alias("absorbed"), F.col("m.s").alias("s"), F.col("m.e").alias("e"))
    )
    # the open period of a slice ends with what later slices absorb, up to and with the next one that begins a period
    x = x.withColumn("opens", (F.size("s") > 0).cast("long")).withColumn("grp", F.coalesce(F.sum("opens").over(past), F.lit(0)))
    own = F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("own", own)
    late = x.groupBy("entity", "grp").agg(F.max("absorbed").alias("late")).select(F.col("entity").alias("le"), F.col("grp").alias("lg"), "late")
    x = x.filter("opens = 1").join(late, F.col("entity").eqNullSafe(F.col("le")) & (F.col("own") == F.col("lg")), "left")
    x = x.withColumn("tail", F.greatest(F.element_at("e", -1), F.coalesce("late", F.element_at("e", -1))))
    x = x.withColumn("e", F.concat(F.slice("e", 1, F.size("e") - 1), F.array("tail"))).withColumn("prev", F.lag("tail").over(by))
    x = x.withColumn("before", F.concat(F.array("prev"), F.slice("e", 1, F.size("e") - 1)))
    p = x.select("entity", F.explode(F.arrays_zip("s", "e", "before")).alias("z")).select("entity", "z.s", "z.e", "z.before")
    both = F.array(F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("a"), F.col("s").alias("b")))
    out = p.select("entity", F.explode(both).alias("r")).select(F.col("entity").alias(entity), "r.kind", F.col("r.a").alias("start_ms"), F.col("r.b").alias("end_ms"))
    gap_ok = F.col("start_ms").isNotNull() if max_gap_ms is None else (F.col("start_ms").isNotNull() & (F.col("end_ms") - F.col("start_ms") < max_gap_ms))
    return out.filter((F.col("kind") == "period") | gap_ok)
