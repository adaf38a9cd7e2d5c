import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opweave.llm.runs import collapse_runs
from opweave.llm.subsequences import frequent_subsequences, step_name

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "e string, t timestamp, t2 timestamp, k string, v string, ids array<string>, pattern string, n long"


def data(seed, n=150):
    r = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t += r.choice([0, 0.5, 4, 5, 5.5])
        start = T0 + datetime.timedelta(seconds=t)
        end = r.choice([None, start, start + datetime.timedelta(seconds=r.choice([0, 1, 3]))])
        out.append((r.choice("abc"), start, end, f"k{i:03d}", r.choice(["x", "x", "x", "y", None]), [f"i{r.randint(0, 40)}", None], "clash", 1))
    return out + [out[3], out[3]]


def ordered(rows):
    return {e: sorted({x[3]: x for x in rows if x[0] == e}.values(), key=lambda x: (x[1], x[3])) for e in {x[0] for x in rows if x[0]}}


@pytest.mark.parametrize("seed,chunk", [(0, 2048), (1, 1), (2, 3), (3, 10)])
def test_runs(spark, seed, chunk):
    rows = data(seed)
    want = set()
    for e, seq in ordered(rows).items():
        cur = []
        for x in [*seq, None]:
            if x and cur and x[4] == cur[-1][4] and x[1] <= (cur[-1][2] or cur[-1][1]) + datetime.timedelta(seconds=5):
                cur.append(x)
                continue
            if len(cur) > 1:
                last = max(y[2] or y[1] for y in cur)
                want.add((e, cur[0][3], cur[-1][3], len(cur), len({i for y in cur for i in y[5] if i}), int((last - cur[0][1]).total_seconds() * 1000)))
            cur = [x]
    df = spark.createDataFrame(rows + [(None, T0, None, "z", "x", [], "", 1), ("a", None, None, "z", "x", None, "", 1)], SCHEMA).repartition(5)
    got = [tuple(r) for r in collapse_runs(df, "e", "t", "t2", "k", F.col("v"), "ids", chunk=chunk).collect()]
    assert set(got) == want and len(got) == len(want)


def brute(rows, lo, hi, gap, share, least):
    sup = Counter()
    seqs = ordered(rows)
    for seq in seqs.values():
        s = [str(x[4] or "-").upper() + "@" + "p" for x in seq]
        seen, level = set(), [((c,), i) for i, c in enumerate(s)]
        for k in range(2, hi + 1):
            level = list({(p + (s[j],), j) for p, i in level for j in range(i + 1, min(len(s), i + gap + 1))})
            if k >= lo:
                seen |= {p for p, _ in level}
        sup.update(seen)
    need = max(least, math.ceil(len(seqs) * share))
    return {(" > ".join(p), len(p), n) for p, n in sup.items() if n >= need}


@pytest.mark.parametrize("block", [4096, 12, 30])
def test_patterns(spark, block):
    rows = data(7, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("app", F.lit(" P "))
    got = {tuple(r) for r in frequent_subsequences(df, "e", step_name("v", "app"), "t", "k", min_support=2, min_share=0.5, block=block).collect()}
    assert got == brute(rows, 3, 4, 3, 0.5, 2) and got


def test_no_patterns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert frequent_subsequences(df, "e", F.col("v"), "t", "k").count() == 0
    assert collapse_runs(df, "e", "t", "t2", "k", F.col("v"), "ids").count() == 0


@pytest.mark.parametrize("most", [0, 3])
def test_patterns_beyond_what_workers_hold(spark, monkeypatch, most):
    monkeypatch.setattr("opweave.llm.subsequences.MAX_BROADCAST", most)
    rows = data(9, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("app", F.lit("p"))
    got = [tuple(r) for r in frequent_subsequences(df, "e", step_name("v", "app"), "t", "k", min_support=2, min_share=0.5, block=20).collect()]
    assert set(got) == brute(rows, 3, 4, 3, 0.5, 2) and len(got) == len(set(got))


def test_many_steps(spark):
    """So many frequent steps that four of them outgrow a plain 64-bit code."""
    n = 60_000
    rows = [(e, T0 + datetime.timedelta(seconds=i), None, f"{e}{i:06d}", f"v{i}", None, "", 1) for e in "ab" for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert n**4 > 2**63
    got = frequent_subsequences(df, "e", F.col("v"), "t", "k", min_support=2, max_gap=1, min_steps=4)
    assert got.count() == n - 3
