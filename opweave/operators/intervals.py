"""Interval joins, ownership under explicit tie rules, boundary matching and run merging."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opweave.plans.groups import map_groups
from opweave.plans.sequence import island_ids, sequence
from opweave.session import cut

SMALL_MS, LARGE_MS = 600_000, 86_400_000


def overlap_join(a: DataFrame, b: DataFrame, entity: str, a_key: list[str], b_key: list[str]) -> DataFrame:
    """Pairs of intervals of one entity that share a point (bounds included).

    a has a_s, a_e, b has b_s, b_e (epoch ms).  Intervals are put into time buckets and joined by
    equality on (entity, bucket), never by a bare range; those longer than a bucket use day buckets."""
    a = a.select(F.col(entity).alias("a_ent"), "a_s", "a_e", *a_key)
    b = b.select(F.col(entity).alias("b_ent"), "b_s", "b_e", *b_key)

    def spread(df: DataFrame, p: str, size: int) -> DataFrame:
        lo, hi = (F.floor(F.col(f"{p}_{x}") / size).cast("long") for x in "se")
        return df.withColumn(f"{p}_k", F.explode(F.sequence(lo, hi)))

    def join(x: DataFrame, y: DataFrame, size: int) -> DataFrame:
        on = (F.col("a_ent") == F.col("b_ent")) & (F.col("a_k") == F.col("b_k"))
        j = spread(x, "a", size).join(spread(y, "b", size), on)
        first = F.col("a_k") == F.floor(F.greatest("a_s", "b_s") / size)  # a pair meets in many buckets, counts in one
        return j.filter(first & (F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e"))).drop("a_k", "b_k", "b_ent")

    small = lambda df, p: df.filter(F.col(f"{p}_e") - F.col(f"{p}_s") <= SMALL_MS)
    large = lambda df, p: df.filter(F.col(f"{p}_e") - F.col(f"{p}_s") > SMALL_MS)
    out = join(small(a, "a"), small(b, "b"), SMALL_MS).unionByName(join(large(a, "a"), b, LARGE_MS)).unionByName(join(small(a, "a"), large(b, "b"), LARGE_MS))
    return out.withColumnRenamed("a_ent", entity)


def _overlap() -> Column:
    return F.least("a_e", "b_e") - F.greatest("a_s", "b_s")


def own(pairs: DataFrame, a_key: str, seg_key: str, rule: str) -> DataFrame:
    """One owner for each activity of ``overlap_join`` pairs; ``rule`` is required, rules differ on ties.

    boundary: a point belongs to the segment starting there, else the latest start; an interval to the
      largest overlap, then the closest middle, then the later start.
    earliest: largest overlap (a contained point counts), then the earliest start.
    previous: a point belongs to the segment ending there, else the lowest index; an interval to the
      largest overlap, then the lowest index.
    Remaining ties go to the lowest ``seg_key``."""
    x = pairs.withColumn("ov", _overlap()).withColumn("point", F.col("a_e") <= F.col("a_s"))
    x = x.filter(F.col("point") | (F.col("ov") > 0))
    mid = F.abs((F.col("a_s") + F.col("a_e")) - (F.col("b_s") + F.col("b_e")))
    orders = {
        "boundary": [F.when(F.col("point"), (F.col("b_s") == F.col("a_s")).cast("int")).otherwise(F.col("ov")).desc(), F.when(F.col("point"), F.lit(0)).otherwise(mid).asc(), F.col("b_s").desc(), F.col(seg_key)],
        "earliest": [F.col("ov").desc(), F.col("b_s").asc(), F.col(seg_key)],
        "previous": [F.when(F.col("point"), (F.col("b_e") == F.col("a_s")).cast("int")).otherwise(F.col("ov")).desc(), F.col(seg_key)],
    }
    w = Window.partitionBy(a_key).orderBy(*orders[rule])
    return x.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "point")


def greedy_iou(pairs: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """IoU of every overlapping pair over its hull: (a_key, b_key, iou)."""
    hull = F.greatest("a_e", "b_e") - F.least("a_s", "b_s")
    return pairs.withColumn("iou", _overlap() / hull).filter("iou > 0").select(a_key, b_key, "iou")


def _match(kind: str, tol: int):
    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        p = sorted(t for side, t in rows if side == "p")
        q = sorted(t for side, t in rows if side == "g")
        n = 0
        if kind == "two_pointer":
            p, q, i, j = sorted(set(p)), sorted(set(q)), 0, 0
            while i < len(p) and j < len(q):
                if abs(p[i] - q[j]) <= tol:
                    n, i, j = n + 1, i + 1, j + 1
                elif p[i] < q[j]:
                    i += 1
                else:
                    j += 1
        else:
            used = [False] * len(q)
            for x in p:
                best = None
                for k, y in enumerate(q):
                    if not used[k] and abs(x - y) <= tol and (best is None or abs(x - y) < abs(x - q[best])):
                        best = k
                if best is not None:
                    used[best] = True
                    n += 1
        return [(key[0], n, len(p), len(q))]

    return run


def match_boundaries(points: DataFrame, tol_ms: int, kind: str) -> DataFrame:
    """(entity, tp, n_pred, n_gt) per entity; points: entity, side 'p' | 'g', t (ms).

    kind 'two_pointer': unique boundaries, smaller advances; 'nearest': with duplicates, each prediction
    takes its nearest free one.  Points more than ``tol_ms`` apart cannot interact, so a task holds one
    cluster of close points, never an entity."""
    x = points.groupBy("entity", "side", "t").agg(F.count("*").alias("m"))
    x = x.withColumn("id", F.concat_ws(":", F.lpad(F.col("t").cast("string"), 20, "0"), "side")).withColumn("time", F.timestamp_millis("t"))
    y, w = sequence(x, "entity", "time", "id")
    y = y.withColumn("before", F.lag("t").over(w)).filter("own")
    y = island_ids(y, "entity", F.col("before").isNull() | (F.col("t") - F.col("before") > tol_ms), "cluster")
    y = y.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).select("entity", "cluster", "side", "t")
    got = map_groups(y, ["entity", "cluster"], ["t"], _match(kind, tol_ms), "entity string, tp bigint, n_pred bigint, n_gt bigint")
    return got.groupBy("entity").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gt").alias("n_gt"))


def precision_recall(tp: Column, n_pred: Column, n_gt: Column) -> list[Column]:
    """Precision, recall and F1, 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp, n_pred), F.lit(0.0)), F.coalesce(F.try_divide(tp, n_gt), F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1")]


def _absorb_short(min_us: int):
    """Merges the short runs of one island; has_left, has_right: whether a long run stands beside it."""

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        left, right, p_right = bool(rows[0][4]), bool(rows[0][5]), rows[-1][6]
        runs = [[start, end, p_left, [no]] for no, start, end, p_left, *_ in rows]
        owner = {}
        while runs:
            if len(runs) == 1 and not left and not right:
                break
            k = next((i for i, r in enumerate(runs) if r[1] - r[0] < min_us), None)
            if k is None:
                break
            first, last = k == 0 and not left, k == len(runs) - 1 and not right
            pr = runs[k + 1][2] if k + 1 < len(runs) else p_right
            to_left = last or not first and runs[k][2] >= pr
            r = runs.pop(k)
            if to_left and k == 0:
                owner |= {n: -1 for n in r[3]}  # joins the long run on the left
            elif to_left:
                runs[k - 1][1] = r[1]
                runs[k - 1][3] += r[3]
            elif k == len(runs):
                owner |= {n: -2 for n in r[3]}  # joins the long run on the right
            else:
                runs[k][0], runs[k][2] = r[0], r[2]
                runs[k][3] = r[3] + runs[k][3]
        for i, r in enumerate(runs):
            owner |= {n: i for n in r[3]}
        return [(key[0], start, end, key[1], owner[no]) for no, start, end, *_ in rows]

    return run


def merge_short_runs(runs: DataFrame, min_s: float) -> DataFrame:
    """Merges runs shorter than ``min_s``, first one first, into the neighbour with the higher link probability.

    runs: entity, run_no, start_us, end_us, p_left (link probability to the run before, null for the first).
    The first run goes right, the last left, ties left.  A long run never moves, so the short runs
    between two long ones are decided by themselves; a task holds such an island, never an entity."""
    min_us = int(min_s * 1e6)
    x = runs.withColumn("long", F.col("end_us") - F.col("start_us") >= min_us).withColumn("time", F.timestamp_micros("start_us"))
    y, w = sequence(x, "entity", "time", "run_no", back=1, ahead=1)
    y = y.withColumn("before_long", F.lag("long").over(w)).withColumn("after_long", F.lead("long").over(w)).withColumn("p_right", F.lead("p_left").over(w)).filter("own")
    y = island_ids(y, "entity", F.col("long") | F.coalesce(F.col("before_long"), F.lit(True)), "island")
    y = cut(y)  # read three times
    short = y.filter("not long")
    ends = short.groupBy(F.col("entity").alias("e"), F.col("island").alias("i")).agg(F.max_by("after_long", "pos").alias("after"), F.min_by("before_long", "pos").alias("before"))
    short = short.join(ends, (F.col("entity") == F.col("e")) & (F.col("island") == F.col("i")))
    short = short.withColumn("has_left", F.coalesce("before", F.lit(False))).withColumn("has_right", F.coalesce("after", F.lit(False)))
    short = short.select("entity", "island", "run_no", "start_us", "end_us", "p_left", "has_left", "has_right", "p_right")
    decided = map_groups(short, ["entity", "island"], ["run_no"], _absorb_short(min_us), "entity string, start_us bigint, end_us bigint, island bigint, part int")
    # islands count up at every long run and at the first short one after it: the long run on the left is island - 1, on the right island + 1
    key = F.when(F.col("part") == -1, F.struct((F.col("island") - 1).alias("i"), F.lit(0).alias("p"))).when(F.col("part") == -2, F.struct((F.col("island") + 1).alias("i"), F.lit(0).alias("p"))).otherwise(F.struct(F.col("island").alias("i"), F.col("part").alias("p")))
    rows = decided.select("entity", "start_us", "end_us", key.alias("k")).unionByName(y.filter("long").select("entity", "start_us", "end_us", F.struct(F.col("island").alias("i"), F.lit(0).alias("p")).alias("k")))
    return rows.groupBy("entity", "k").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_runs")).drop("k")
