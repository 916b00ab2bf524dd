"""Queries of the event stream, read as jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import table
from matchloom.streaming.jobs import counted_stream, latest_status, mode, progress, routed

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
KNOWN = ["view", "click", "purchase"]


def stream_job_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs by route, counted by a stream over the events table."""
    return counted_stream(spark, f"{folder}/events.parquet*", EVENTS, [routed(F.col("event_type"), KNOWN).alias("route")])


def job_status_latest(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return latest_status(log, ["user_id"], "ts", "event_id")


def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    return rows.select("user_id", progress(F.col("done"), F.col("n")).alias("progress"))


def job_modes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("value is not null").select(mode(F.col("value")).alias("mode"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_job_counts, job_status_latest, job_progress, job_modes)}
ORACLE = {
    "stream_job_counts": "SELECT CASE WHEN event_type IS NULL THEN 'profile_ingest' WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'failed' END AS route, count(*) AS n FROM events GROUP BY 1",
    "job_status_latest": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "job_progress": "SELECT user_id, (5 + floor(count_if(event_type = 'purchase') / greatest(count(*), 1) * 85))::INT AS progress FROM events GROUP BY 1",
    "job_modes": "SELECT CASE WHEN value <= 5 THEN 'sync' ELSE 'async' END AS mode, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
}
