"""Streams over the events table, run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from notefold.streaming import events as S


def stream_windows(s, d):
    r = S.run_once(S.windowed(S.event_stream(s, d)))
    return r.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_leaps(s, d):
    return S.run_once(S.running_leaps(S.event_stream(s, d)), keys=["user_id"], mode="update")


QUERIES = {"stream_windows": stream_windows, "stream_leaps": stream_leaps}
ORACLE = {
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events where ts is not null group by all",
    "stream_leaps": "select user_id, count(*) filter (where abs(p - q) >= 6) as leaps, count(*) as n from (select user_id, p, lag(p) over (partition by user_id order by ts, event_id) as q from (select *, cast(floor(value) as int) % 88 + 21 as p from events where user_id is not null and value is not null and ts is not null)) group by user_id",
}
