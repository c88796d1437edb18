"""Queries of windows over event time; the same definitions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.plans.registry import query
from pulseloom.streaming.sections import windowed_counts


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def q_tumbling(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return windowed_counts(e).select("start", "event_type", "n", F.round("mean", 6).alias("mean"))


@query("session_beats", "WITH f AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g")
def q_sessions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    # a gap of exactly six hours still joins: the window's end is open, so its length is a microsecond more
    return e.groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
