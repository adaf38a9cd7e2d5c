"""Literal expectations on intervals, boundaries, pairs and ownership."""
import pytest
from pyspark.sql import functions as F

from opweave.operators.interval_periods import interval_periods
from opweave.operators.intervals import greedy_iou, match_boundaries, overlap_join, own
from opweave.plans.workflow_queries import pair_counts


@pytest.mark.parametrize(
    "p,g,tol,tp,fp,fn",
    [([0, 10_000], [0, 10_000], 500, 2, 0, 0), ([0], [500], 500, 1, 0, 0), ([0], [501], 500, 0, 1, 1), ([0, 100, 200], [0], 500, 1, 2, 0), ([0, 1000], [400, 1400], 500, 2, 0, 0)],
)
def test_boundaries(spark, p, g, tol, tp, fp, fn):
    df = spark.createDataFrame([("s", "p", x) for x in p] + [("s", "g", x) for x in g], "entity string, side string, t long")
    m = match_boundaries(df, tol, "two_pointer").first()
    assert (m.tp, m.n_pred - m.tp, m.n_gt - m.tp) == (tp, fp, fn)


def test_one_sided_sessions_count(spark):
    df = spark.createDataFrame([("P", "p", 1), ("G", "g", 1)], "entity string, side string, t long")
    assert {(r.entity, r.tp, r.n_pred, r.n_gt) for r in match_boundaries(df, 500, "two_pointer").collect()} == {("P", 0, 1, 0), ("G", 0, 0, 1)}


@pytest.mark.parametrize("a,b,iou", [((0, 10), (0, 10), 1.0), ((100, 200), (104, 202), 96 / 102), ((0, 10), (20, 30), None), ((20, 80), (0, 100), 0.6)])
def test_iou(spark, a, b, iou):
    x = spark.createDataFrame([("s", "a", *a)], "e string, ka string, a_s long, a_e long")
    y = spark.createDataFrame([("s", "b", *b)], "e string, kb string, b_s long, b_e long")
    got = greedy_iou(overlap_join(x, y, "e", ["ka"], ["kb"]), "ka", "kb").first()
    assert (got and round(got.iou, 9)) == (iou and round(iou, 9))


def test_union(spark):
    df = spark.createDataFrame([("s", 0, 10), ("s", 5, 15), ("s", 20, 25)], "e string, a long, b long")
    p = interval_periods(df, "e", F.col("a"), F.col("b")).filter("kind = 'period'").agg(F.sum(F.col("end_ms") - F.col("start_ms"))).first()[0]
    assert p == 20


@pytest.mark.parametrize(
    "rows,tp,pred,gt",
    [([("p", "g", 2), ("q", "h", 2)], 2, 2, 2), ([("p", "g", 2), ("p", "h", 2)], 2, 6, 2), ([("p", "g", 1), ("q", "g", 1)], 0, 0, 1), ([("p", "g", 5)], 10, 10, 10)],
)
def test_pairs(spark, rows, tp, pred, gt):
    ct = spark.createDataFrame([("s", *r) for r in rows], "session_id string, p string, g string, n long")
    m = pair_counts(ct, []).first()
    assert (m.tp, m.pred_pairs, m.gt_pairs) == (tp, pred, gt)


def test_ownership_rules_differ_on_a_shared_bound(spark):
    a = spark.createDataFrame([("s", "p10", 10, 10), ("s", "i", 9, 11)], "e string, id string, a_s long, a_e long")
    g = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 10, 20)], "e string, seg int, b_s long, b_e long")
    j = overlap_join(a, g, "e", ["id"], ["seg"])
    assert {r.id: r.seg for r in own(j, "id", "seg", "previous").collect()} == {"p10": 1, "i": 1}
    assert {r.id: r.seg for r in own(j, "id", "seg", "boundary").collect()}["p10"] == 2
