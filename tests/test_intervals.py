import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opweave.operators.interval_periods import interval_periods, merge_disjoint, parse_ms
from opweave.operators.intervals import _absorb_short, match_boundaries, merge_short_runs, overlap_join, own

SCHEMA = "session_id string, a long, b long, start_ms long"


def periods(rows, max_gap=None):
    out = set()
    for s in {r[0] for r in rows}:
        cur = []
        for a, b in sorted((r[1], r[2]) for r in rows if r[0] == s and None not in r[1:3] and r[2] > r[1]):
            if cur and a <= cur[-1][1]:
                cur[-1][1] = max(b, cur[-1][1])
            else:
                cur.append([a, b])
        for i, (a, b) in enumerate(cur):
            out.add((s, "period", a, b))
            if i and (max_gap is None or a - cur[i - 1][1] < max_gap):
                out.add((s, "gap", cur[i - 1][1], a))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_periods_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "b", None]), a := r.randint(-500, 500), a + r.choice([-1, 0, 1, 5, 20, 300]), 7) for _ in range(120)]
    rows += [("hot", None, 5, 7), ("hot", 5, None, 7), *rows[:10]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = interval_periods(df, "session_id", F.col("a"), F.col("b"), slice_ms=r.choice([7, 50, 100000]), max_gap_ms=40, fan_in=2).collect()
    assert {tuple(x) for x in got} == periods(rows, 40) and len(got) == len(set(map(tuple, got)))


def test_no_rows(spark):
    assert interval_periods(spark.createDataFrame([], SCHEMA), "session_id", F.col("a"), F.col("b")).count() == 0


def test_merge_of_lists():
    s, e = merge_disjoint(np.array([0, 10, 4]), np.array([5, 12, 10]))
    assert s.tolist() == [0] and e.tolist() == [12]


@pytest.mark.parametrize(
    "text,ms",
    [
        ("2023-09-04T06:00:04.728Z", 1693807204728), ("2023-09-04T15:00:04.728+09:00", 1693807204728), (" 2023-09-04T06:00:04Z ", 1693807204000), ("2023-09-04T06:00:04.728999Z", 1693807204728), ("2023-09-04T06:00:04.728123456Z", 1693807204728),
        ("2023-09-04T15:00+0900", 1693807200000), ("n/a", None), ("", None), ("2023-13-04T06:00:00Z", None), ("2023-09-04T25:61:00Z", None), ("2023-09-04T06:00:04", None), (None, None),
    ],
)
def test_times(spark, text, ms):
    assert spark.createDataFrame([(text,)], "t string").select(parse_ms(F.col("t"))).first()[0] == ms


def test_overlap_join_and_ownership(spark):
    r = random.Random(5)
    acts = [("s", f"a{i}", x := r.randint(0, 5_000_000), x + r.choice([0, 0, 1000, 900_000])) for i in range(60)]
    segs = [("s", i, x := r.randint(0, 5_000_000), x + r.choice([10, 60_000, 700_000, 90_000_000])) for i in range(40)]
    a = spark.createDataFrame(acts, "session_id string, id string, a_s long, a_e long")
    b = spark.createDataFrame(segs, "session_id string, seg int, b_s long, b_e long")
    j = overlap_join(a, b, "session_id", ["id"], ["seg"])
    want = {(x[1], y[1]) for x in acts for y in segs if x[2] <= y[3] and y[2] <= x[3]}
    got = [(x.id, x.seg) for x in j.collect()]
    assert set(got) == want and len(got) == len(want)
    owners = own(j, "id", "seg", "earliest").collect()
    assert len(owners) == len({o.id for o in owners})
    for o in owners:
        mine = [(min(o.a_e, y[3]) - max(o.a_s, y[2]), -y[2], -y[1]) for y in segs if y[2] <= o.a_e and o.a_s <= y[3]]
        assert (o.ov, -o.b_s, -o.seg) == max(mine)


def walk(p, q, tol):
    p, q, i, j, n = sorted(set(p)), sorted(set(q)), 0, 0, 0
    while i < len(p) and j < len(q):
        if abs(p[i] - q[j]) <= tol:
            n, i, j = n + 1, i + 1, j + 1
        elif p[i] < q[j]:
            i += 1
        else:
            j += 1
    return n


def test_boundary_matching_in_clusters(spark):
    r = random.Random(3)
    p, q = ([r.randint(0, 3000) for _ in range(80)] for _ in range(2))
    df = spark.createDataFrame([("e", "p", t) for t in p] + [("e", "g", t) for t in q], "entity string, side string, t long")
    assert match_boundaries(df, 9, "two_pointer").first().tp == walk(p, q, 9)
    used, n = [False] * len(q), 0
    qs = sorted(q)
    for x in sorted(p):
        c = [(abs(x - y), k) for k, y in enumerate(qs) if not used[k] and abs(x - y) <= 9]
        if c:
            used[min(c)[1]] = True
            n += 1
    assert match_boundaries(df, 9, "nearest").first().tp == n


def merge_all(runs, least):
    runs = [list(x) for x in runs]
    while len(runs) > 1:
        k = next((i for i, x in enumerate(runs) if x[1] - x[0] < least), None)
        if k is None:
            break
        left = k == len(runs) - 1 or k and runs[k][2] >= runs[k + 1][2]
        if left and k:
            runs[k - 1][1] = runs[k][1]
        else:
            runs[k + 1][0], runs[k + 1][2] = runs[k][0], runs[k][2]
        del runs[k]
    return {(x[0], x[1]) for x in runs}


@pytest.mark.parametrize("seed", range(5))
def test_run_merge_in_islands(spark, seed):
    r = random.Random(seed)
    t, runs = 0, []
    for k in range(40):
        d = r.choice([1, 2, 3, 30, 40])
        runs.append((t * 1_000_000, (t + d) * 1_000_000, None if k == 0 else r.choice([0.1, 0.5, 0.5, 0.9])))
        t += d + 1
    df = spark.createDataFrame([("e", i + 1, *x) for i, x in enumerate(runs)], "entity string, run_no long, start_us long, end_us long, p_left double")
    got = {(x.start_us, x.end_us) for x in merge_short_runs(df, 10).collect()}
    assert got == merge_all(runs, 10_000_000)
    assert _absorb_short is not None
