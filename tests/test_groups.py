"""Groups by links: one ordered stream a session against the pairs written out, and what is written for it."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opweave.operators import grouping as G, sequences as S
from opweave.plans.positions import with_positions
from opweave.plans.session_queries import _candidates

ACT = "activity_id string, session_id string, start timestamp, app string, window string, browser_tab string, text string, entities array<struct<type:string,value:string>>, source_event_ids array<string>, triggered_by array<string>, start_us bigint"
D = "/root/testdata/sf0.01"


def by_pairs(acts):
    """The groups by way of every candidate pair."""
    a = with_positions(acts.select("session_id", "start", "activity_id", "start_us"), "session_id", "start", "activity_id").select("session_id", "pos", "activity_id", "start_us")
    side = lambda p: a.select(F.col("activity_id").alias(p + "id"), F.col("pos").alias(p + "pos"), F.col("start_us").alias(p + "us"))
    e = S.score_edges(_candidates(acts), acts).join(side("x_"), F.col("a") == F.col("x_id")).join(side("y_"), F.col("b") == F.col("y_id"))
    e = e.select("session_id", F.least("x_pos", "y_pos").alias("a_pos"), F.greatest("x_pos", "y_pos").alias("b_pos"), "score", (F.abs(F.col("x_us") - F.col("y_us")) / 1e6).alias("gap_s"), (F.col("strength") == "STRONG").alias("strong"))
    g = G.greedy_groups(a.select("session_id", "pos", "activity_id"), G.best_links(e))
    return g.groupBy("session_id", "grp").agg(F.count("*").alias("n_activities"), F.min("activity_id").alias("first_activity"))


def odd(n, step, sessions, values):
    """Equal starts, missing fields, values with few and with more than 200 holders, triggers forwards and backwards, gaps at the bounds."""
    r, t = random.Random(7), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t += timedelta(seconds=r.choice(step))
        s = r.choice(sessions)
        pick = lambda *x: r.choice(x)
        ents = [("invoice_id" if r.random() < 0.5 else " Case_ID ", f"V{r.randrange(values)}") for _ in range(r.choice((0, 0, 1, 2)))]
        refs = [f"{pick('a', 'e')}{max(0, i + r.randrange(-9, 9))}" for _ in range(r.choice((0, 0, 0, 1)))]
        start = None if r.random() < 0.02 else t
        out.append((f"a{i}", s, start, pick(None, "", "x", " X", "y"), pick(None, "w", "W ", "v"), pick(None, "", "t"), pick(None, "", "straße", "STRASSE 7", "abc", "long text"), pick(None, ents, ents, ents), pick(None, [f"e{i}", f"e{i // 2}", None]), pick(None, refs, refs), None if start is None else int((start - datetime(1970, 1, 1)).total_seconds() * 1e6)))
    out.append((None, "s", t, "x", "w", "t", "abc", [("CASE_ID", "V1")], [], [], out[-1][-1]))
    return out


@pytest.mark.parametrize("case", [(900, (0, 1, 2, 9, 12, 13), ["s", "u", None], 6), (700, (0, 30, 44, 45, 46, 120, 180, 300), ["s"], 40), (600, (0, 0, 0, 1), ["s", "t"], 3), (1000, (20, 30, 60), ["s"], 1)])
def test_stream_against_pairs(spark, case):
    rows = odd(*case)
    acts = spark.createDataFrame(rows, ACT).withColumn("start_us", F.unix_micros("start"))
    got = sorted(map(tuple, G.linked_groups(acts).collect()))
    assert got == sorted(map(tuple, by_pairs(acts).collect()))
    assert sum(g[2] for g in got) == sum(r[0] is not None and r[1] is not None and r[2] is not None for r in rows)


def test_tables_against_pairs(spark):
    from opweave.plans.session_queries import acts
    from __spark_entry__ import queries

    got, want = queries()["activity_groups"](spark, D), by_pairs(acts(spark, D))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_pair_is_written(spark):
    """What is shuffled are the activities (twice) and their values; pairs took 45 times the input on disk."""
    from __spark_entry__ import queries

    q = queries()["activity_groups"](spark, D)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ExistingRDD" not in plan


def test_links_of_nothing(spark):
    assert G.linked_groups(spark.createDataFrame([], ACT)).count() == 0
