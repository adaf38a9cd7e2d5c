"""Linkage of workflow labels without a matrix of pairs: any number of labels, the merges and sweeps of the dense form."""
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from opweave.operators import vectors as V
from __spark_entry__ import queries

N = 5003
THRESHOLDS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """5,003 labels: a session, a segment and one to three activities each; 77 mixtures of types and apps and two labels of their own."""
    d, t = str(tmp_path_factory.mktemp("labels")), datetime(2024, 1, 1)
    a, s = [], []
    for i in range(N):
        kind, app, more = ("A", "b", 0) if i == N - 1 else ("B", "b", 9) if i == N - 2 else (f"T{i % 7}", f"app{i % 11}", i % 3)
        for k in range(more + 1):
            a.append((f"a{i}-{k}", f"s{i}", t + timedelta(seconds=k), t + timedelta(seconds=k + 0.5), kind if k % 2 == 0 else "T0", app, None))
        s.append((f"s{i}", "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", f"L{i:05}"))
    cols = ("window", "browser_tab", "browser_url", "target_field", "text", "screen_text", "verification_status")
    x = spark.createDataFrame(pd.DataFrame([r[:6] for r in a], columns=["activity_id", "session_id", "start", "end", "type", "app"]))
    x = x.selectExpr("activity_id", "session_id", "cast(start as timestamp_ntz) start", "cast(`end` as timestamp_ntz) `end`", "type", "app", *[f"cast(null as string) {c}" for c in cols], "cast(null as array<struct<type:string,value:string>>) entities", "cast(null as array<string>) source_event_ids", "cast(null as array<string>) triggered_by", "cast(start as timestamp_ntz) received_at")
    x.write.parquet(f"{d}/activities.parquet")
    spark.createDataFrame(s, "session_id string, start string, `end` string, label string").write.parquet(f"{d}/segments.parquet")
    return d


def dense(m):
    u = V._unit(m.astype(float))
    return np.clip(1 - u @ u.T, 0, 2)


@pytest.mark.parametrize("seed", range(6))
def test_profiles_against_matrix(seed):
    """Random profiles, half of them with repeats and multiples."""
    r = np.random.RandomState(seed)
    m = r.randint(1, 60, (40, 9))
    if seed % 2:
        m = m[r.randint(0, 40, 90)] * r.randint(1, 4, (90, 1))
    p = V.Profiles(m)
    tree, want = V.cosine_linkage(p.unit, p.weight), V.average_linkage(dense(m))
    for t in [0.005, 0.01, *THRESHOLDS]:
        assert V.cut_tree(tree, len(p.weight), t)[p.of].tolist() == V.cut_tree(want, len(m), t).tolist()
    new, old = V.cosine_sweep(p, [0.01, *THRESHOLDS]), V.threshold_sweep(dense(m), [0.01, *THRESHOLDS])
    assert np.allclose(new.astype(float), old.astype(float), atol=1e-9)


def test_ties_take_the_lowest_pair():
    """Four directions, each as far from the next: (0, 1) and (2, 3) are merged, in any scale."""
    m = np.array([[1, 0, 0, 1], [1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1], [3, 0, 0, 3]])
    p = V.Profiles(m)
    assert p.of.tolist() == [0, 1, 2, 3, 0] and p.weight.tolist() == [2, 1, 1, 1]
    merges = V.cosine_linkage(p.unit, p.weight)
    assert [x[:2] for x in merges[:2]] == [(0, 1), (2, 3)] and [x[2] for x in merges[:2]] == [0.5, 0.5]


def test_sweep_of_many_labels(spark, many):
    s = {r.threshold: r for r in queries()["threshold_sweep"](spark, many).collect()}
    assert sorted(s) == THRESHOLDS
    assert s[0.02].k > s[0.6].k >= 1 and s[0.02].stability == 1
    assert s[0.02].singleton_share == 2 / s[0.02].k


def test_clusters_of_many_labels(spark, many):
    got = {r.label: r.cluster for r in queries()["avg_linkage"](spark, many).collect()}
    assert sorted(got) == [f"L{i:05}" for i in range(N)] and got["L00000"] == 0
    assert all(got[f"L{i:05}"] == got[f"L{i + 231:05}"] for i in range(N - 2 - 231))  # the mixtures repeat
    numbers = [got[x] for x in sorted(got)]
    assert list(dict.fromkeys(numbers)) == list(range(max(numbers) + 1))  # by first member


def test_choice_of_many_labels(spark, many):
    s = queries()["threshold_sweep"](spark, many).toPandas()
    s = s[s["eligible"] & (s["singleton_share"] <= 0.55)]
    assert [r.threshold for r in queries()["threshold_choice"](spark, many).collect()] == [s.loc[s["score"].idxmax(), "threshold"]]


def test_sweep_of_no_labels(spark, many, tmp_path):
    for t in ("activities", "segments"):
        spark.read.parquet(f"{many}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    q = queries()
    assert q["threshold_sweep"](spark, str(tmp_path)).count() == q["avg_linkage"](spark, str(tmp_path)).count() == 0
    assert [r.threshold for r in q["threshold_choice"](spark, str(tmp_path)).collect()] == [0.55]
