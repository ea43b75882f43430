"""Streams against the batch answer: shuffled micro-batches, restarts, late rows, and merges that are run again."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import events_ops as B
from ledgerloom.streaming import events_stream as E
from ledgerloom.streaming import merge as M

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"


def rows_of(rng, n=1500, users=12, days=300):
    at = np.sort(rng.uniform(0, days, n))
    return [(i, int(rng.integers(0, users)), "ab"[i % 2], START + dt.timedelta(days=float(t)), float(i % 7)) for i, t in enumerate(at)]


def written(spark, folder, rows, batches):
    for i, part in enumerate(np.array_split(np.arange(len(rows)), batches)):
        spark.createDataFrame([rows[j] for j in part], SCHEMA).coalesce(1).write.parquet(f"{folder}/x{i:02d}")
    return f"{folder}/x*"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events that come up to 40 days late, in ten micro-batches."""
    rng = np.random.default_rng(3)
    rows = rows_of(rng)
    late = sorted(rows, key=lambda r: r[3] + dt.timedelta(days=float(rng.uniform(0, 40))))
    path = written(spark, tmp_path_factory.mktemp("events"), late, 10)
    return path, spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_do_not_depend_on_arrival(spark, shuffled, tmp_path):
    path, events = shuffled
    got = E.first_runs(E.source(spark, path, 1), events, 4, str(tmp_path / "runs"))
    want = B.first_run(events, 4)
    assert pairs(got) == pairs(want) and want.count() > 3
    state = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").load(str(tmp_path / "runs" / "state"))
    last = max(r[0] for r in events.select(F.max("ts")).collect())
    oldest = state.selectExpr("min(list_element.day)").first()[0]
    assert oldest is None or dt.date(1970, 1, 1) + dt.timedelta(days=oldest) >= (last - dt.timedelta(days=47)).date()


def test_windows_equal_the_batch(spark, shuffled):
    path, events = shuffled
    week = events.groupBy(F.date_trunc("week", "ts").cast("date").alias("semana"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    assert pairs(E.weekly(E.source(spark, path, 1), events).select("semana", "event_type", "n", "total")) == pairs(week)
    whole = lambda df, w: df.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).selectExpr("user_id", "to_date(w.start) as desde", "n")
    assert pairs(E.busy_windows(E.source(spark, path, 1), events, 5)) == pairs(whole(events, F.window("ts", "7 days", "1 day")).filter("n >= 5"))
    assert pairs(E.sessions(E.source(spark, path, 1), events).drop("first_id")) == pairs(whole(events, F.session_window("ts", "5 days")))


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = rows_of(np.random.default_rng(5), 600)
    windows = lambda df: df.groupBy(F.window("ts", "7 days").alias("w")).agg(F.count("*").alias("n"))
    for part in (rows[:250], rows[250:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.read.parquet(str(tmp_path / "in"))
        got = E.closed_and_open(E.source(spark, str(tmp_path / "in"), 1), events, windows, "again", "7 days", str(tmp_path / "again"))
        assert pairs(got) == pairs(windows(events))


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    rows = rows_of(np.random.default_rng(7), 300)
    old = [(10_000 + i, 1, "a", START + dt.timedelta(days=i), 0.0) for i in range(5)]
    path = written(spark, tmp_path / "in", rows[:150] + rows[150:] + old, 6)
    in_time, late = M.routed(E.source(spark, path, 1), str(tmp_path / "out"), str(tmp_path / "state"), 45)
    assert sorted(r["event_id"] for r in late.collect()) == [r[0] for r in old]
    assert sorted(r["event_id"] for r in in_time.collect()) == [r[0] for r in rows]
    again, _ = M.routed(E.source(spark, path, 1), str(tmp_path / "out"), str(tmp_path / "other"), 45)  # run again from the start
    assert again.count() == len(rows)


def test_merges_survive_a_kill_between_write_and_commit(spark, tmp_path, monkeypatch):
    table = M.MergedTable(spark, str(tmp_path / "t"), "k long, v long, note string", ["k"], ["note"], 4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long, note string")
    assert table.rows().count() == 0
    table.apply(frame([(k, k, None) for k in range(20)]), 0, "v")
    table.apply(frame([(3, 3, "seen"), (4, 9, None), (4, 8, None)]), 1, "v")
    commit = M.MergedTable.commit

    def killed(self, versions, number):
        raise RuntimeError("killed")

    monkeypatch.setattr(M.MergedTable, "commit", killed)
    batch = frame([(3, 50, None), (77, 1, None), (5, 2, None)])
    with pytest.raises(RuntimeError):
        table.apply(batch, 2, "v")
    monkeypatch.setattr(M.MergedTable, "commit", commit)
    assert {r["k"]: r["v"] for r in table.rows().collect()}[3] == 3  # nothing of it counts
    for number in (2, 2, 1, 0):  # run again, and again after it is committed
        table.apply(batch, number, "v")
    got = {r["k"]: (r["v"], r["note"]) for r in table.rows().collect()}
    assert table.rows().count() == len(got) == 21
    assert got[3] == (50, "seen") and got[4] == (9, None) and got[77] == (1, None) and got[5] == (5, None)
