"""The event questions as streams: a file source, watermarks, windows and sinks that survive a restart.

Every stream runs with ``availableNow``, in append mode, into a folder with its own checkpoint. What it has appended is
final; what the watermark has not passed yet is counted from the events themselves, so that both together are
what a batch over the same files gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import fenced
from ledgerloom.sources.sinks import shared_path

from .run_state import day_runs

#: How late an event may come before the state of its window is dropped.
LATE = "45 days"


def source(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The events below a path with a pattern as a stream, in their files' schema, with a watermark on ``ts``."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def run_to_now(stream: DataFrame, out: str, checkpoint: str) -> str | None:
    """Runs a stream in append mode over what is there now; the watermark up to which its answer is final.

    The file sink's log makes each row exactly once, also when the stream goes on from its checkpoint later.
    """
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()
    query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})]
    return max(marks, default=None)


def distinct_events(stream: DataFrame) -> DataFrame:
    """Each event once, whatever is delivered again within the watermark."""
    out = stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type", "value")
    path = shared_path(stream.sparkSession, "distinct")
    run_to_now(out, f"{path}/out", f"{path}/state")
    return stream.sparkSession.read.schema(out.schema).parquet(f"{path}/out")


def closed_and_open(stream: DataFrame, events: DataFrame, windows, name: str, reach: str | None = None, path: str | None = None) -> DataFrame:
    """``windows(events)``, which have a window ``w``: the closed ones from the stream, those still open from the events.

    The stream only appends: state and answer of a window go when the watermark passes its end, so state holds no more than
    the watermark's delay. Windows that are open yet are counted from the events of the last ``reach`` before it.
    """
    spark, path = stream.sparkSession, path or shared_path(stream.sparkSession, name)
    rows = windows(stream)
    mark = run_to_now(rows, f"{path}/out", f"{path}/state")
    edge = F.lit(mark or "1970-01-01T00:00:00Z").cast("timestamp")
    recent = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if reach:
        recent = recent.filter(F.col("ts") >= edge - F.expr(f"interval {reach}"))
    closed = spark.read.schema(rows.schema).parquet(f"{path}/out")
    # fenced, as a filter on a session's end that moves below the sessions cuts them
    return closed.unionByName(fenced(windows(recent)).filter(F.col("w.end") > edge))


def weekly(stream: DataFrame, events: DataFrame) -> DataFrame:
    """Count and sum by week (from Monday) and type: tumbling windows."""

    def windows(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))

    return closed_and_open(stream, events, windows, "weekly", "7 days").select(F.to_date("w.start").alias("semana"), "event_type", "n", "total")


def busy_windows(stream: DataFrame, events: DataFrame, least: int = 3) -> DataFrame:
    """Sliding weeks, from every day, in which a user has at least ``least`` events."""

    def windows(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id", F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)

    return closed_and_open(stream, events, windows, "busy", "7 days").select("user_id", F.to_date("w.start").alias("desde"), "n")


def sessions(stream: DataFrame, events: DataFrame, gap: str = "5 days") -> DataFrame:
    """A user's events without a pause of ``gap``: first and last event and their number."""

    def windows(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))

    return closed_and_open(stream, events, windows, "sessions").select("user_id", F.to_date("w.start").alias("desde"), "n", "first_id")


def first_runs(stream: DataFrame, events: DataFrame, length: int = 7, path: str | None = None) -> DataFrame:
    """(user_id, day): the day on which a user's first run of so many consecutive days is complete.

    Final days come from the stream of :func:`day_runs`, in the order of time whatever the order of arrival; runs that days
    beyond the watermark complete are found among the days that can still be part of them.
    """
    spark, path = stream.sparkSession, path or shared_path(stream.sparkSession, "runs")
    rows = day_runs(stream, length)
    mark = run_to_now(rows, f"{path}/out", f"{path}/state")
    edge = F.lit(mark or "1970-01-01T00:00:00Z").cast("timestamp")
    day = F.to_date(F.col("ts").cast("timestamp"))
    recent = events.select("user_id", day.alias("day")).filter(F.col("day") >= F.date_sub(F.to_date(edge), length + 1)).distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    complete = recent.withColumn("run", run).groupBy("user_id", "run").agg(F.min("day").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= length)
    # runs that began before what is read here are complete by then
    later = complete.select("user_id", F.date_add("first", length - 1).alias("day")).filter(F.date_add("day", 1).cast("timestamp") > edge)
    final = spark.read.schema(rows.schema).parquet(f"{path}/out").select("user_id", F.to_date("day").alias("day"))
    return final.unionByName(later).groupBy("user_id").agg(F.min("day").alias("day"))


def split_late(events: DataFrame, seen: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Events of a batch that are in time, and those more than ``days`` before the latest event seen, for a side table."""
    last = seen.agg(F.max("ts").alias("_last"))  # one row
    marked = events.join(F.broadcast(last), F.lit(True), "left").withColumn("_late", F.coalesce(F.col("ts") < F.col("_last") - F.expr(f"interval {days} days"), F.lit(False)))
    return marked.filter(~F.col("_late")).drop("_last", "_late"), marked.filter("_late").drop("_last", "_late")
