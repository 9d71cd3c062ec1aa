"""Queries over phrases of three notes and over event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.operators import excerpt as E
from notefold.operators import short_clips as S
from notefold.plans.excerpt_queries import RAW_SQL
from notefold.runtime import tables


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.phrases(E.clip_rows(spark, sf_dir).select("sample_id", E.ordered_notes().alias("ev")))  # phrases take the notes alone


PH = RAW_SQL + """, ph as (select rid, sample_id, cast(i // 3 as integer) as phrase, cast(i % 3 as integer) as k, st, en, pitch, velocity from n),
pa as (select rid, sample_id, phrase, cast(count(*) as integer) as m, max(pitch) filter (where k = 0) as p0, max(pitch) filter (where k = 1) as p1, max(pitch) filter (where k = 2) as p2,
  max(velocity) filter (where k = 0) as v0, max(velocity) filter (where k = 1) as v1, max(velocity) filter (where k = 2) as v2,
  max(st) filter (where k = 1) - max(en) filter (where k = 0) as g0, max(st) filter (where k = 2) - max(en) filter (where k = 1) as g1 from ph group by all)
"""


def _sel(*columns):
    return lambda s, d: _phrases(s, d).select("sample_id", "phrase", *[c() for c in columns])


def _t(name, c):
    return lambda: E.text(c()).alias(name)


_K = lambda cond, a: f"coalesce(string_agg(cast(k as varchar), ',' order by k) filter (where {cond}), '') as {a}"
QUERIES = {
    "phrase_order": _sel(_t("first", lambda: S.ordinal(1)), _t("third", lambda: S.ordinal(3)), _t("last", S.last), _t("first_two", lambda: S.prefix(2)), _t("last_two", lambda: S.suffix(2)), _t("named", lambda: S.with_pitches([60, 62, 64]))),
    "phrase_pitch_rank": _sel(_t("highest", lambda: S.pitch_rank(1, True)), _t("lowest", lambda: S.pitch_rank(1, False)), _t("second", lambda: S.pitch_rank(2, True))),
    "phrase_dynamics": _sel(_t("loudest", lambda: S.extreme_velocity(True)), _t("softest", lambda: S.extreme_velocity(False)), _t("second", S.second_loudest)),
    "phrase_pairs": _sel(_t("close_pitch", S.closest_pitch_pair), _t("close_time", S.closest_time_pair), lambda: F.size(S.pairs_with_delta(5)).alias("pairs_of_5")),
    "phrase_patterns": _sel(lambda: S.contour().alias("contour"), lambda: S.interval_trend().alias("trend")),
}
ORACLE = {
    "phrase_order": PH + f"select sample_id, phrase, {_K('k = 0', 'first')}, {_K('k = 2', 'third')}, {_K('k = m - 1', 'last')}, {_K('m >= 2 and k < 2', 'first_two')}, {_K('m >= 2 and k >= m - 2', 'last_two')}, {_K('pitch in (60, 62, 64)', 'named')} from ph join pa using (rid, sample_id, phrase) group by rid, sample_id, phrase",
    "phrase_pitch_rank": PH + f", r as (select *, dense_rank() over (partition by rid, phrase order by pitch desc) as h, dense_rank() over (partition by rid, phrase order by pitch) as l from ph) select sample_id, phrase, {_K('h = 1', 'highest')}, {_K('l = 1', 'lowest')}, {_K('h = 2', 'second')} from r group by rid, sample_id, phrase",
    "phrase_dynamics": PH + """, r as (select *, row_number() over (partition by rid, phrase order by velocity desc) as h, lead(velocity) over (partition by rid, phrase order by velocity desc) as below, lag(velocity) over (partition by rid, phrase order by velocity desc) as above, count(*) over (partition by rid, phrase) as m from ph)
select sample_id, phrase, max(cast(k as varchar)) filter (where h = 1 and velocity - below >= 24) as loudest, max(cast(k as varchar)) filter (where h = m and above - velocity >= 24) as softest, max(cast(k as varchar)) filter (where m = 3 and h = 2 and above - velocity >= 24 and velocity - below >= 24) as second from r group by rid, sample_id, phrase""",
    "phrase_pairs": PH + """select sample_id, phrase, case when m = 3 then case when abs(p0 - p1) < least(abs(p0 - p2), abs(p1 - p2)) then '0,1' when abs(p0 - p2) < least(abs(p0 - p1), abs(p1 - p2)) then '0,2' when abs(p1 - p2) < least(abs(p0 - p1), abs(p0 - p2)) then '1,2' end end as close_pitch,
case when m = 3 and abs(g0 - g1) >= 0.15 then case when g0 < g1 then '0,1' else '1,2' end end as close_time, cast(coalesce(abs(p0 - p1) = 5, false) as integer) + cast(coalesce(abs(p0 - p2) = 5, false) as integer) + cast(coalesce(abs(p1 - p2) = 5, false) as integer) as pairs_of_5 from pa""",
    "phrase_patterns": PH + """select sample_id, phrase, case when m = 3 and p0 <> p1 and p1 <> p2 then case when p1 > p0 then 'up' else 'down' end || '-' || case when p2 > p1 then 'up' else 'down' end end as contour,
case when m = 3 then case when abs(p2 - p1) - abs(p1 - p0) >= 2 then 'widen' when abs(p1 - p0) - abs(p2 - p1) >= 2 then 'narrow' when abs(p2 - p1) = abs(p1 - p0) then 'same' end end as trend from pa""",
}
NOTES3 = """notes3 as (select event_id, user_id, cast(ts as date) as day, cast(floor(value) as int) % 88 + 21 as pitch, cast(extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as bigint) as start_s,
  value as dur_s, cast(row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as int) as idx from events where user_id is not null and ts is not null and value is not null)"""


def leap_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of six semitones and more, and the largest, per event sequence."""
    d = S.event_sequences(tables(spark, sf_dir)("events"))
    moves = F.transform("v", lambda x, i: F.abs(x["pitch"] - F.get("v", i - 1)["pitch"]))
    return d.select("user_id", "day", F.size(F.filter(moves, lambda m: m >= 6)).cast("long").alias("leaps"), F.array_max(moves).alias("jump"))


QUERIES["leap_notes"] = leap_notes
ORACLE["leap_notes"] = f"with {NOTES3}, m as (select *, pitch - lag(pitch) over (partition by user_id, day order by idx) as mv from notes3) select user_id, day, count(case when abs(mv) >= 6 then 1 end) as leaps, max(abs(mv)) as jump from m group by user_id, day"
