import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from opweave.operators import vectors as V
from opweave.operators.grouping import greedy_groups, match_one_to_one
from opweave.operators.sequences import gap_sessions, near_pairs, ngrams, runs
from opweave.plans import sequence as Q
from opweave.plans.positions import with_positions

T0 = datetime.datetime(2024, 1, 1)


def rows(n, seed=0):
    r = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += r.choice([0, 0, 1, 40, 2000])
        out.append((r.choice("ab"), T0 + datetime.timedelta(seconds=t), f"k{i:04d}", r.choice("xyz"), "clash"))
    return out


SCHEMA = "e string, t timestamp, k string, v string, pos string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).drop("pos")


def test_positions(spark):
    data = rows(300)
    extra = [data[5], data[5], (None, T0, "n", "x", ""), ("a", None, "n", "x", ""), ("a", T0, None, "x", "")]
    df = frame(spark, data + extra).repartition(7)
    got = {(r.e, r.k): r.pos for r in with_positions(df, "e", "t", "k", bucket_s=60).collect()}
    want = {}
    for e in "ab":
        want |= {(e, x[2]): i for i, x in enumerate(sorted((x for x in data if x[0] == e), key=lambda x: (x[1], x[2])))}
    assert got == want
    assert with_positions(df.limit(0), "e", "t", "k").count() == 0


def test_chunks_do_not_show(spark, monkeypatch):
    data = rows(200, 3)
    df = frame(spark, data)
    want = [sorted(map(tuple, f.collect())) for f in (gap_sessions(df, "e", "t", "k", 60), runs(df, "e", "t", "k", "v"), ngrams(df, "e", "t", "k", "v", 3), near_pairs(df, "e", "t", "k", 45, 5))]
    monkeypatch.setattr(Q.chunked, "__defaults__", ("pos", 1, 0, 9))
    monkeypatch.setattr(Q.island_ids, "__defaults__", ("pos", 9))
    small = [sorted(map(tuple, f.collect())) for f in (gap_sessions(df, "e", "t", "k", 60), runs(df, "e", "t", "k", "v"), ngrams(df, "e", "t", "k", "v", 3), near_pairs(df, "e", "t", "k", 45, 5))]
    assert small == want


def test_one_to_one(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("m", 1)], "key string, a int")
    b = spark.createDataFrame([("k", 7), ("n", 1)], "key string, b int")
    got = {(r.key, r.a, r.b) for r in match_one_to_one(a, b, ["key"], ["a"], ["b"]).collect()}
    assert got == {("k", 1, 7), ("k", 2, None), ("m", 1, None), ("n", None, 1)}


def test_greedy_groups(spark):
    acts = spark.createDataFrame([("s", i, f"a{i}") for i in range(6)], "session_id string, pos long, activity_id string")
    links = spark.createDataFrame([("s", 2, 0), ("s", 3, 2), ("s", 5, 4)], "session_id string, b_pos long, a_pos long")
    assert [r.grp for r in greedy_groups(acts, links).orderBy("pos").collect()] == [1, 2, 1, 1, 3, 3]


def test_linkage_and_cut():
    x = np.array([0, 1, 10, 11, 50.0])
    d = abs(x[:, None] - x[None, :])
    m = V.average_linkage(d)
    assert V.cut_tree(m, 5, 2).tolist() == [0, 0, 1, 1, 2] and V.cut_tree(m, 5, 100).tolist() == [0] * 5
    assert V.adjusted_rand(np.array([0, 0, 1]), np.array([1, 1, 0])) == 1.0
    assert V.tree_silhouette(d, np.array([0, 0, 1, 1, 2])) > 0.6
    s = V.threshold_sweep(d, [2, 100])
    assert s["k"].tolist() == [3, 1] and (s["stability"] == 1).all()


def test_knn_against_numpy(spark):
    r = np.random.RandomState(0)
    vec = r.randn(90, 8)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(vec)] + [(1000, None)], "id long, v array<double>")
    got = {(x.query, x.neighbour) for x in V.cosine_knn(df, df.filter("id % 10 = 0"), "id", "v", 3, block=16).collect()}
    u = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    assert got == {(q, int(n)) for q in range(0, 90, 10) for n in np.argsort(-s[q], kind="stable")[:3]}


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "s double, y int")
    m = V.ranking_metrics(df, "s", "y").first()
    assert (m.n, m.n_pos, m.roc_auc) == (5, 2, round((3 + 1.5) / 6, 6)) and abs(m.average_precision - (0.5 * 1 + 0.5 * 2 / 4)) < 1e-6


def test_session_set(spark):
    df = frame(spark, rows(50))
    assert ngrams(df.limit(0), "e", "t", "k", "v", 2).count() == 0
    assert df.select(F.count("*")).first()[0] == 50


def test_silhouette_against_pairs(spark):
    r = np.random.RandomState(1)
    vec = r.randn(25, 4)
    lab = [0] * 9 + [1] * 9 + [2] * 6 + [3]
    df = spark.createDataFrame([(i, lab[i], [float(v) for v in x]) for i, x in enumerate(vec)], "id long, label int, v array<double>")
    got = {x.id: x.silhouette for x in V.silhouette(V.unit_vectors(df, "id", "v", "label"), "id", "label", block=3).collect()}
    u = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for i in range(25):
        mean = {c: np.mean([d[i, j] for j in range(25) if j != i and lab[j] == c] or [np.nan]) for c in set(lab)}
        a, b = mean[lab[i]], min(v for c, v in mean.items() if c != lab[i])
        want = 0 if lab[i] == 3 else (b - a) / max(a, b)
        assert abs(got[i] - want) < 1e-9
