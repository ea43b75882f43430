"""Runs of consecutive days as a stream: list state and event-time timers for each user.

Days are counted in the order of time, not of arrival: a day is taken once the watermark is past its end, when no
event can fill a gap before it any more. What a user's state holds is the days that are not final yet and, while the
next day may still go on with it, the last run; after that the user has no state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY = 86_400_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayRuns(StatefulProcessor):
    """Gives (user_id, day) when a run of days reaches ``length``, once a run."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "day int")
        self.run = handle.getValueState("run", "last int, length int")

    def _wake(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        days = {d for (d,) in self.open.get()} if self.open.exists() else set()
        before = len(days)
        for part in rows:
            days |= {int(d) for d in part["day"]}
        if len(days) > before:
            self.open.put([(d,) for d in sorted(days)])
            self._wake((min(days) + 1) * DAY)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        days = sorted(d for (d,) in self.open.get()) if self.open.exists() else []
        last, length = self.run.get() if self.run.exists() else (None, 0)
        hits = []
        for d in [d for d in days if (d + 1) * DAY <= mark]:
            length = length + 1 if last is not None and d == last + 1 else 1
            last = d
            if length == self.length:
                hits.append(d)
        rest = [d for d in days if (d + 1) * DAY > mark]
        if rest:
            self.open.put([(d,) for d in rest])
            self._wake((rest[0] + 1) * DAY)
        else:
            self.open.clear()
        if last is None or (last + 2) * DAY <= mark:  # the day after the run is past, and was not there
            self.run.clear()
        else:
            self.run.update((last, length))
            self._wake((last + 2) * DAY)
        if hits:
            yield pd.DataFrame({"user_id": [key[0]] * len(hits), "day": [pd.Timestamp(0) + pd.Timedelta(days=d) for d in hits]})

    def close(self) -> None:
        pass


def day_runs(stream: DataFrame, length: int) -> DataFrame:
    """(user_id, day) of a stream with a watermark on ``ts``: every day on which a run reaches ``length`` days, once it is final."""
    stream.sparkSession.conf.set(_STORE, _ROCKS)  # lists and timers need this store
    days = stream.select("user_id", "ts", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"))
    return days.groupBy("user_id").transformWithStateInPandas(DayRuns(length), "user_id long, day timestamp", "Append", "EventTime")
