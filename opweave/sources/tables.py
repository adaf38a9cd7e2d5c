"""Validated loads of activities and segments."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opweave.operators.interval_periods import parse_ms


def activities_once(df: DataFrame) -> DataFrame:
    """Each activity_id once (a redelivery repeats everything but received_at); type and app trimmed, type upper, app lower."""
    return (
        df.dropDuplicates(["activity_id"])
        .withColumn("type", F.upper(F.trim("type")))
        .withColumn("app", F.lower(F.trim("app")))
    )


def valid_segments(df: DataFrame) -> DataFrame:
    """(session_id, s, e, label) in epoch ms: readable, end after start, repeated rows once; unresolved labels kept as they are."""
    return df.select("session_id", parse_ms(F.col("start")).alias("s"), parse_ms(F.col("end")).alias("e"), "label").filter("e > s").distinct()


def labelled_segments(df: DataFrame) -> DataFrame:
    """valid_segments with a label, one label (the least) for each interval, and the 1-based index in the session."""
    x = valid_segments(df).filter("trim(label) <> ''").groupBy("session_id", "s", "e").agg(F.min("label").alias("label"))
    return x.withColumn("seg", F.row_number().over(Window.partitionBy("session_id").orderBy("s", "e")).cast("long"))


def activity_violations(df: DataFrame) -> DataFrame:
    """(rule, n): required fields missing, end before start, repeated ids."""
    checks = df.agg(
        F.count_if(F.col("activity_id").isNull()).alias("missing_id"), F.count_if(F.col("session_id").isNull()).alias("missing_session"),
        F.count_if(F.col("start").isNull()).alias("missing_start"), F.count_if(F.col("end") < F.col("start")).alias("end_before_start"),
        (F.count("activity_id") - F.count_distinct("activity_id")).alias("repeated_id"),
    )
    return checks.selectExpr("stack(5, 'missing_id', missing_id, 'missing_session', missing_session, 'missing_start', missing_start, 'end_before_start', end_before_start, 'repeated_id', repeated_id) AS (rule, n)")
