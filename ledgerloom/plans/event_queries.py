"""Streaks, gaps and windows over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import events_ops as E

from .catalogue import query
from .ledger import table

DAYS = "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events"
RUNS = f"r AS (SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS length FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d) GROUP BY user_id, run)"


def events(spark, d):
    return table(spark, d, "events")


@query("""WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
 w AS (SELECT user_id, day, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS seen FROM c)
 SELECT user_id, min(day) AS day, arg_min(seen, day) AS seen FROM w WHERE seen >= 3 GROUP BY 1""")
def three_in_seven_days(spark, d):
    return E.trailing_sessions(events(spark, d))


@query(f"""WITH d AS ({DAYS}), g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d) SELECT user_id, day, CAST(gap AS INTEGER) AS gap FROM g WHERE gap >= 2""")
def return_after_gap(spark, d):
    return E.returns(events(spark, d), 2)


@query(f"WITH d AS ({DAYS}), {RUNS} SELECT user_id, CAST(min(first + 6) AS DATE) AS day FROM r WHERE length >= 7 GROUP BY 1")
def seven_day_run(spark, d):
    return E.first_run(events(spark, d), 7)


CLEAR = """WITH a AS (SELECT user_id, min(CAST(ts AS DATE)) AS since, max(CAST(ts AS DATE)) AS until FROM events GROUP BY 1),
 t AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE {trigger}),
 s AS (SELECT t.user_id, day, day - coalesce(lag(day) OVER (PARTITION BY t.user_id ORDER BY day), since) AS span FROM t JOIN a USING (user_id))
 SELECT user_id, CAST(min(day) - 1 AS DATE) AS day FROM s WHERE span >= {n} GROUP BY 1
 UNION ALL SELECT user_id, until FROM a WHERE until - since >= {n} AND user_id NOT IN (SELECT user_id FROM t)"""


@query(CLEAR.format(trigger="event_type = 'purchase'", n=5))
def days_clear(spark, d):
    """W4 with its three cases."""
    return E.clear_spans(events(spark, d), F.col("event_type") == "purchase", 5)


@query(CLEAR.format(trigger="value > 99", n=20))
def days_clear_of_peaks(spark, d):
    """W4 with a rare trigger, which many users never have."""
    return E.clear_spans(events(spark, d), F.col("value") > 99, 20)


@query("""SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
def first_win_of_week(spark, d):
    return E.first_of_week(events(spark, d), F.col("event_type") == "purchase")


@query(f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2 HAVING avg(value) >= 40), {RUNS}
 SELECT user_id, max(length) AS record, arg_max(length, last) AS current FROM r GROUP BY 1""")
def streak_current_record(spark, d):
    return E.streaks(events(spark, d), 40)


@query("""SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY 1, 2""")
def latest_per_week(spark, d):
    return E.latest_per_week(events(spark, d))


@query("""WITH v AS (SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT *, round(last - first, 6) AS delta FROM v""")
def first_last_delta(spark, d):
    return E.first_last(events(spark, d))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS mean, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS flag FROM events GROUP BY 1, 2)
 SELECT flag, round(avg(mean), 6) AS mean, count(*) AS days FROM d GROUP BY 1""")
def mode_group_mean(spark, d):
    return E.by_flag(events(spark, d), F.col("event_type") == "purchase")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1),
 c AS (SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM d)
 SELECT n, r, CASE WHEN abs(r) < 0.2 THEN 'nenhuma' WHEN abs(r) < 0.4 THEN 'fraca' WHEN abs(r) < 0.7 THEN 'moderada' ELSE 'forte' END AS class FROM c""")
def pearson_by_day(spark, d):
    return E.correlation(events(spark, d))


@query("""SELECT user_id, round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value END), 6) AS atual, round(avg(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value END), 6) AS anterior FROM events GROUP BY 1""")
def previous_window_mean(spark, d):
    half = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return events(spark, d).groupBy("user_id").agg(F.round(F.avg(F.when(half, F.col("value"))), 6).alias("atual"), F.round(F.avg(F.when(~half, F.col("value"))), 6).alias("anterior"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3""")
def top_places(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def json_props(spark, d):
    k = F.from_json("props", "k int")["k"]
    return events(spark, d).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), c AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day)
 SELECT c.day, count(d.user_id) AS users FROM c LEFT JOIN d ON c.day = d.day GROUP BY 1""")
def dense_calendar(spark, d):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-31')) as day")
    seen = E.days_of(events(spark, d)).groupBy("day").agg(F.count("*").alias("c"))
    return days.join(seen, "day", "left").select("day", F.coalesce("c", F.lit(0)).alias("users"))


@query("""SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def weekly_events(spark, d):
    return events(spark, d).groupBy(F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
