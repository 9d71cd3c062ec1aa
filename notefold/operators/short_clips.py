"""Operators on clips of one to three notes, and the building of note sequences from event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions import music as M
from notefold.functions.ids import bound


def phrases(df: DataFrame, ev: str = "ev", size: int = 3) -> DataFrame:
    """Each clip cut into runs of up to ``size`` neighbouring notes: ``sample_id, phrase, v``.

    ``v`` is an array of structs start, end, pitch, velocity. No shuffle; clips without notes give none."""
    at = F.when(F.size(ev) > 0, F.sequence(F.lit(0), F.floor((F.size(ev) - 1) / size).cast("int")))
    d = df.select("sample_id", ev, F.explode(at).alias("phrase"))
    return d.select("sample_id", "phrase", F.transform(F.slice(ev, F.col("phrase") * size + 1, F.lit(size)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity"))).alias("v"))


def event_sequences(events: DataFrame) -> DataFrame:
    """Event rows as note sequences per user and day: one group aggregate, then order inside the row.

    Rows without user, time or value are left out; ties in time go by event_id."""
    e = events.where("user_id is not null and ts is not null and value is not null")
    start = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))).cast("long")
    note = F.struct(F.col("ts"), F.col("event_id"), start.alias("start"), (F.floor("value").cast("int") % 88 + 21).alias("pitch"))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(note)).alias("v"))


def _n() -> Column:
    return F.size("v")


def _p(i) -> Column:
    return F.get("v", F.lit(i) if isinstance(i, int) else i)["pitch"]


def numbers(cond) -> Column:
    """Numbers of the notes that meet ``cond(note, number)``."""
    return F.filter(F.transform("v", lambda x, i: F.when(cond(x, i), i)), lambda i: i.isNotNull())


def with_pitches(values: list[int]) -> Column:
    return numbers(lambda x, i: x["pitch"].isin(values))


def ordinal(k: int) -> Column:
    return numbers(lambda x, i: i == k - 1)


def last() -> Column:
    return numbers(lambda x, i: i == _n() - 1)


def prefix(m: int) -> Column:
    return F.when(_n() >= m, numbers(lambda x, i: i < m)).otherwise(F.array().cast("array<int>"))


def suffix(m: int) -> Column:
    return F.when(_n() >= m, numbers(lambda x, i: i >= _n() - m)).otherwise(F.array().cast("array<int>"))


def pitch_rank(rank: int, highest: bool) -> Column:
    ps = F.sort_array(F.array_distinct(F.transform("v", lambda x: x["pitch"])), asc=not highest)
    return bound(F.get(ps, F.lit(rank - 1)), lambda p: numbers(lambda x, i: x["pitch"] == p))


def extreme_velocity(loudest: bool) -> Column:
    """The only note with the extreme velocity, if it leads every other by the margin; null else and with one note."""
    vs = F.sort_array(F.transform("v", lambda x: x["velocity"]), asc=not loudest)
    lead = bound(vs, lambda s: F.when(F.abs(F.get(s, F.lit(0)) - F.get(s, F.lit(1))) >= M.VELOCITY_MARGIN, F.get(s, F.lit(0))))
    return F.when(_n() >= 2, bound(lead, lambda t: F.when(t.isNotNull(), numbers(lambda x, i: x["velocity"] == t))))


def second_loudest() -> Column:
    s = F.reverse(F.sort_array(F.transform("v", lambda x, i: F.struct(x["velocity"].alias("v"), (-i).alias("j")))))
    clear = lambda o: (F.get(o, F.lit(0))["v"] - F.get(o, F.lit(1))["v"] >= M.VELOCITY_MARGIN) & (F.get(o, F.lit(1))["v"] - F.get(o, F.lit(2))["v"] >= M.VELOCITY_MARGIN)
    return F.when(_n() == 3, bound(s, lambda o: F.when(clear(o), F.array(-F.get(o, F.lit(1))["j"]))))


def pair_distances() -> Column:
    """All pairs i < j with the size of their interval; clips are short, so their number is bounded."""
    at = F.sequence(F.lit(0), _n() - 1)
    pair = lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: F.struct(F.abs(_p(i) - _p(j)).alias("d"), i.alias("i"), j.alias("j")))
    return F.flatten(F.transform(at, pair))


def closest_pitch_pair() -> Column:
    s = F.sort_array(pair_distances())
    return F.when(_n() == 3, bound(s, lambda o: F.when(F.get(o, F.lit(0))["d"] != F.get(o, F.lit(1))["d"], F.array(F.get(o, F.lit(0))["i"], F.get(o, F.lit(0))["j"]))))


def closest_time_pair() -> Column:
    gap = lambda i: F.get("v", F.lit(i + 1))["start"] - F.get("v", F.lit(i))["end"]
    return F.when((_n() == 3) & (F.abs(gap(0) - gap(1)) >= M.GAP_MARGIN), F.when(gap(0) < gap(1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))


def pairs_with_delta(d, pairs: Column | None = None) -> Column:
    return F.transform(F.filter(pair_distances() if pairs is None else pairs, lambda p: p["d"] == d), lambda p: F.array(p["i"], p["j"]))


def contour() -> Column:
    a, b = _p(1) - _p(0), _p(2) - _p(1)
    way = lambda m: F.when(m > 0, "up").otherwise("down")
    return F.when((_n() == 3) & (a != 0) & (b != 0), F.concat_ws("-", way(a), way(b)))


def interval_trend() -> Column:
    a, b = F.abs(_p(1) - _p(0)), F.abs(_p(2) - _p(1))
    return F.when(_n() == 3, F.when(b - a >= M.INTERVAL_MARGIN, "widen").when(a - b >= M.INTERVAL_MARGIN, "narrow").when(a == b, "same"))
