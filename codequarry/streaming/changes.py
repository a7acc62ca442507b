"""Streams of change events (event_id, user_id, event_type, ts): windows, sessions, and version numbers as state.

Watermarks bound the state; rows later than LATE behind the newest are dropped by windows in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codequarry.plans.registry import query

col = F.col
LATE = "1 day"
#: From Monday to Monday.
WEEK = "4 days"


def late(events: DataFrame, by: str = LATE) -> DataFrame:
    return events.withWatermark("ts", by) if events.isStreaming else events


def counted(events: DataFrame, window: Column, *keys: str) -> DataFrame:
    own = events.groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.count_if(col("event_type") == "error").alias("n_fixes"))
    return own.select(col("window.start").alias("start"), col("window.end").alias("end"), *keys, "n", "n_fixes")


def weekly(events: DataFrame) -> DataFrame:
    return counted(late(events), F.window("ts", "7 days", startTime=WEEK))


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return counted(late(events), F.window("ts", width, step))


def over_limit(events: DataFrame, most: int = 10, width: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Clients with more than `most` requests within a hopping window."""
    return counted(late(events), F.window("ts", width, step), "user_id").where(col("n") > most)


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    return counted(late(events), F.session_window("ts", gap), "user_id")


def step_of(kind: str) -> int:
    return 10 if kind == "error" else 3 if kind in ("minor", "feature") else 1


def versions(events: DataFrame) -> DataFrame:
    """In a stream: version numbers of every block, each batch's events after those seen before, by time and id."""

    def numbered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        numbers = number + rows["event_type"].map(step_of).cumsum()
        state.update((int(numbers.iloc[-1]),))
        yield pd.DataFrame({"event_id": rows["event_id"], "block_id": rows["user_id"], "number": numbers})

    return events.groupBy("user_id").applyInPandasWithState(numbered, "event_id long, block_id long, number long", "number long", "append", GroupStateTimeout.NoTimeout)


COUNTS = "COUNT(*) AS n, COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS n_fixes"


@query(f"SELECT date_trunc('week', ts)::TIMESTAMP AS start, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY AS \"end\", {COUNTS} FROM events GROUP BY 1, 2")
def stream1_tumbling(c):
    return weekly(c.table("events"))


@query(f"SELECT s AS start, s + INTERVAL 2 DAY AS \"end\", {COUNTS} FROM (SELECT *, unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1, 2")
def stream2_sliding(c):
    return sliding(c.table("events"))


@query(f"""SELECT MIN(ts) AS start, MAX(ts) + INTERVAL 12 HOUR AS "end", user_id, {COUNTS} FROM (SELECT *, SUM(CASE WHEN ts - p < INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, k""")
def stream3_sessions(c):
    return sessions(c.table("events"))
