"""Queries over analysed clips and their SQL, which goes another way: notes as rows, windows, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from notefold.functions import music as M
from notefold.operators import excerpt as E

_ROWS = """
cl as (select row_number() over () as rid, sample_id, split, notes, basic_info.time_signature as meter, basic_info.tempo_bpm as bpm, basic_info.music_start_sec as ms, basic_info.bar_duration_sec as bd,
  case basic_info.time_signature when '2/4' then 2 when '3/4' then 3 when '4/4' then 4 when '6/8' then 6 end as bpb from clips),
"""
_RAW = _ROWS + """
fr as (select rid, sample_id, split, meter, bpm, bpb, ms, bd, 60.0 / bpm::double as spb from cl),
nt as (select rid, x.start as st, x."end" as en, x.pitch as pitch, x.velocity as velocity from (select rid, unnest(notes) as x from cl) where x.start is not null and x."end" is not null and x.pitch is not null),
"""
_GRID = _ROWS + """
f0 as (select rid, sample_id, split, meter, bpm, bpb, list_min(list_transform(notes, lambda x: x.start)) as ms, 60.0 / bpm::double / 2 as half, 60.0 / bpm::double as spb from cl),
fr as (select *, bpb * 2 * half as bd from f0),
g0 as (select rid, cast(round_even((x.start - ms) / half, 0) as integer) as g, x.pitch as pitch, x.velocity as velocity, half, bpb, ms, bd from (select rid, unnest(notes) as x from cl) join fr using (rid)),
g1 as (select *, row_number() over (partition by rid, g order by pitch, velocity) as k from g0 where g >= 0 and g < 4 * bpb),
nt as (select rid, ms + g * half as st, coalesce(ms + lead(g) over (partition by rid order by g) * half, ms + 2 * bd) - 0.02 as en, pitch, velocity from g1 where k = 1),
"""
_NOTES = """
n0 as (select nt.*, fr.* exclude (rid), cast(row_number() over (partition by nt.rid order by st, en, pitch, velocity) - 1 as integer) as i, case when st < ms + bd - 0.1 then 1 else 2 end as bar from nt join fr using (rid)),
n1 as (select *, (st - min(st) over (partition by rid, bar)) / spb as pos, coalesce(lead(st) over w, ms + 2 * bd) - st as ioi, pitch - lag(pitch) over w as mv, lead(st) over w as nx, lag(bar) over w as pbar, pitch % 12 as pc,
  dense_rank() over (partition by rid order by pitch) as low_rank, dense_rank() over (partition by rid order by pitch desc) as high_rank from n0 window w as (partition by rid order by i)),
n2 as (select *, round_even(pos * 2, 0) / 2 as grid, ioi / spb as d, case when ioi / spb <= 0.75 then 0.5 when ioi / spb <= 1.25 then 1.0 when ioi / spb <= 1.75 then 1.5 when ioi / spb <= 2.5 then 2.0 else 3.0 end as near from n1),
n as (select *, case when abs(near - d) <= 0.18 then near::double end as val from n2),
a0 as (select rid, count(*) as cnt, bool_or(en - st < 0.1) as ultra_short, coalesce(bool_or(en > nx + 1e-4), false) as overlap, coalesce(bool_or(st > ms + bd - 0.16 and st < ms + bd - 0.04), false) as bar_ambiguous,
  min(st) filter (where bar = 1) as s1, min(st) filter (where bar = 2) as s2, coalesce(bool_and(abs(pos - grid) <= 0.18), false) as grid_ok, bool_and(coalesce(nx - en <= 0.06, true)) as no_gap, bool_and(val is not null) as vals, max_by(en, i) as last_end from n group by rid),
c as (select fr.*, coalesce(cnt, 0) as cnt, coalesce(ultra_short, false) as ultra_short, coalesce(overlap, false) as overlap, coalesce(bar_ambiguous, false) as bar_ambiguous,
  coalesce(abs(s1 - ms) <= 0.1 and abs(s2 - (ms + bd)) <= 0.1 and not bar_ambiguous, false) as frame_clear, coalesce(grid_ok, false) as grid_ok, coalesce(abs(ms + 2 * bd - last_end) <= 0.06, false) as end_ok,
  coalesce(cnt > 1 and no_gap and abs(ms + 2 * bd - last_end) <= 0.06, false) as rest_free, coalesce(cnt > 1 and no_gap and abs(ms + 2 * bd - last_end) <= 0.06 and vals, false) as values_ok,
  coalesce(not ultra_short and not overlap and s1 is not null and s2 is not null, false) as usable from fr left join a0 using (rid))
"""
RAW_SQL, GRID_SQL = "with " + _RAW + _NOTES, "with " + _GRID + _NOTES
ON_GRID = "usable and frame_clear and grid_ok"


def _idx(cond: str, guard: str = "true", extra: str = "", group: str = "") -> str:
    """Numbers of notes that meet ``cond`` as text, per clip and parameter."""
    return GRID_SQL + f"""select sample_id{', ' + group if group else ''}, case when any_value({guard}) then coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where {cond}), '') end as notes
from c {extra} left join (select rid, i, st, en, pitch, velocity, bar, pos, ioi, mv, pbar, pc, low_rank, high_rank, grid, val from n) n using (rid) group by rid, sample_id{', ' + group if group else ''}"""


def _q(*columns):
    return lambda spark, sf_dir, clips=E.grid_excerpts: clips(spark, sf_dir).select("sample_id", *[c() if callable(c) else c for c in columns])


def _each(name: str, values, column):
    """One row per clip and value of a parameter."""
    def run(spark, sf_dir, clips=E.grid_excerpts):
        d = clips(spark, sf_dir).withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        return d.select("sample_id", name, column(F.col(name)).alias("notes"))

    return run


def _t(column):
    return lambda: E.text(column()).alias("notes")


FLAGS = ["ultra_short", "overlap", "bar_ambiguous", "frame_clear", "grid_ok", "end_ok", "rest_free", "frame_full", "values_ok", "usable"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


_add("clip_flags", lambda s, d: E.clip_excerpts(s, d).select("sample_id", "n", *FLAGS),
     RAW_SQL + "select sample_id, cast(cnt as integer) as n, ultra_short, overlap, bar_ambiguous, frame_clear, grid_ok, end_ok, rest_free, frame_clear and end_ok as frame_full, values_ok, usable from c")
_add("note_positions", lambda s, d: E.clip_excerpts(s, d).select("sample_id", F.inline("ev")).select("sample_id", "i", "bar", F.floor(F.col("pos") * 1e6 + 0.5).alias("pos_micro"), "grid", F.floor(F.col("ioi") * 1e6 + 0.5).alias("ioi_micro"), "value", "move"),
     RAW_SQL + "select sample_id, i, bar, cast(floor(pos * 1e6 + 0.5) as bigint) as pos_micro, grid, cast(floor(ioi * 1e6 + 0.5) as bigint) as ioi_micro, val as value, mv as move from n")
_add("bar_initial_notes", _q(_t(E.bar_initial_notes)), _idx("i = 0 or (bar = 2 and pbar = 1)", "usable and frame_clear"))
_add("notes_on_beat", _each("k", range(1, 7), lambda k: E.text(E.notes_on_beat(k))), _idx("grid = k - 1", f"{ON_GRID} and k <= bpb", "cross join (select cast(x as integer) as k from range(1, 7) r(x)) r", "k"))
_add("notes_at_bar_middle", _q(_t(E.notes_at_bar_middle)), _idx("grid = bpb / 2", ON_GRID))
_add("notes_in_second_half", _each("b", (1, 2), lambda b: E.text(E.notes_in_second_half(b))), _idx("grid >= bpb / 2 and bar = b", ON_GRID, "cross join (select cast(x as integer) as b from range(1, 3) r(x)) r", "b"))
_add("notes_with_value", _each("v", M.NOTE_VALUES, lambda v: E.text(E.notes_with_value(v))), _idx("val = v", ON_GRID + " and values_ok", "cross join (values (0.5::double), (1.0), (1.5), (2.0), (3.0)) r(v)", "v"))
_add("value_names", lambda s, d: E.grid_excerpts(s, d).select("sample_id", "meter", F.inline("ev")).select("sample_id", "i", E.value_name(F.col("value")).alias("name")),
     GRID_SQL + "select sample_id, i, case when meter = '6/8' then case val when 0.5 then 'sixteenth note' when 1 then 'eighth note' when 1.5 then 'dotted eighth note' when 2 then 'quarter note' when 3 then 'dotted quarter note' end else case val when 0.5 then 'eighth note' when 1 then 'quarter note' when 1.5 then 'dotted quarter note' when 2 then 'half note' when 3 then 'dotted half note' end end as name from n")
_add("beat_names", lambda s, d: E.grid_excerpts(s, d).where(E.ON_GRID).select("sample_id", "meter", F.inline("ev")).select("sample_id", "i", E.beat_name(F.col("grid")).alias("beat"), E.metric_weight((F.col("grid") * 2).cast("int")).alias("weight")),
     GRID_SQL + f"select sample_id, i, case when grid % 1 = 0 then 'beat ' || cast(floor(grid) + 1 as integer) else 'the second half of beat ' || cast(floor(grid) + 1 as integer) end as beat, case when grid = 0 then case when meter = '4/4' then 4 else 3 end when meter = '4/4' and grid = 2 then 3 when grid % 1 = 0 then 2 else 1 end as weight from n where rid in (select rid from c where {ON_GRID})")
_add("syncopated_notes", _q(_t(E.syncopated_notes)), GRID_SQL + f""", w(meter, h, weight) as (
  select m, x, case when x = 0 then case when m = '4/4' then 4 else 3 end when m = '4/4' and x = 4 then 3 when x % 2 = 0 then 2 else 1 end from (values ('2/4', 4), ('3/4', 6), ('4/4', 8)) t(m, wide), range(0, 8) r(x) where x < wide),
cross_ as (
  select n.rid, n.i, (a + 2 * n.d - s) / 2 as over from (select *, (bar - 1) * bpb * 2 + cast(grid * 2 as integer) as a from n) n join w w0 on w0.meter = n.meter and w0.h = cast(n.grid * 2 as integer), range(0, 80) r(s), w w1
  where s > a and s <= ceil(a + 2 * n.d) + 1 and w1.meter = n.meter and w1.h = s % (n.bpb * 2) and w1.weight > w0.weight),
st as (select rid, bool_or(over > 0.1 and over < 0.35) as blurred from cross_ group by rid),
held as (select rid, string_agg(cast(i as varchar), ',' order by i) as notes from (select distinct rid, i from cross_ where over >= 0.35) group by rid)
select sample_id, case when {ON_GRID} and values_ok and meter in ('2/4', '3/4', '4/4') and not coalesce(blurred, false) then coalesce(held.notes, '') end as notes from c left join st using (rid) left join held using (rid)""")
_add("longest_note_of_bar", _q(lambda: E.longest_note_of_bar(1).alias("bar1"), lambda: E.longest_note_of_bar(2).alias("bar2")), GRID_SQL + """, o as (select rid, bar, i, ioi, row_number() over (partition by rid, bar order by ioi desc, i) as k, lead(ioi) over (partition by rid, bar order by ioi desc, i) as second from n),
t as (select rid, max(i) filter (where bar = 1 and ioi >= 1.3 * second) as bar1, max(i) filter (where bar = 2 and ioi >= 1.3 * second) as bar2 from o where k = 1 group by rid)
select sample_id, case when usable and not bar_ambiguous and rest_free then bar1 end as bar1, case when usable and not bar_ambiguous and rest_free then bar2 end as bar2 from c left join t using (rid)""")
_add("shortest_notes_per_bar", _q(lambda: E.shortest_notes_per_bar().alias("count")), GRID_SQL + f""", t as (select rid, min(val) as v from n group by rid)
select sample_id, case when {ON_GRID} and values_ok and abs(bpb / v - round_even(bpb / v, 0)) < 1e-9 then cast(bpb / v as integer) end as count from c left join t using (rid)""")
_add("measured_tempo", _q(lambda: F.round(E.measured_tempo(), 4).alias("bpm"), lambda: F.when(E.tempo_consistent(), F.col("bpm")).alias("tempo_answer"), lambda: F.when(E.tempo_consistent(), F.col("bpb")).alias("beats_answer")), GRID_SQL + f""", t as (select rid, regr_slope(st, (bar - 1) * bpb + grid) as slope from n group by rid),
m as (select c.*, case when {ON_GRID} and cnt >= 4 and slope > 0 then 60 / slope end as m from c left join t using (rid))
select sample_id, round(m, 4) as bpm, case when abs(m - bpm) <= 3 then bpm end as tempo_answer, case when abs(m - bpm) <= 3 then bpb end as beats_answer from m""")
_add("distinct_names", _q(lambda: F.array_join(F.transform(E.played(), M.note_name), ",").alias("names"), lambda: F.size(E.played()).alias("count")), GRID_SQL + f""", p as (select distinct rid, pc from n)
select sample_id, coalesce(string_agg(['{"', '".join(M.NOTE_NAMES)}'][pc + 1], ',' order by pc), '') as names, cast(count(pc) as integer) as count from c left join p using (rid) group by rid, sample_id""".replace('"', "'").replace("['", "['").replace("''", "'"))
_SCALES = "cross join (select cast(root as integer) as root, list_sort(list_transform([0, 2, 4, 5, 7, 9, 11], lambda s: (s + root) % 12)) as pcs from range(0, 12) r(root)) sc"
_add("outside_scale", _each("root", range(12), lambda r: E.text(E.notes_outside_scale(r))), _idx("not list_contains(pcs, pc)", "true", _SCALES, "root"))
_add("never_played", _each("root", range(12), lambda r: E.text(E.never_played(r))), GRID_SQL + f"""select sample_id, root, coalesce(string_agg(cast(p as varchar), ',' order by p) filter (where not exists (select 1 from n where n.rid = x.rid and n.pc = x.p)), '') as notes
from (select rid, sample_id, root, unnest(pcs) as p from c {_SCALES}) x group by rid, sample_id, root""")
_add("pitch_moves", lambda s, d, clips=E.grid_excerpts: clips(s, d).select("sample_id", F.inline("ev")).select("sample_id", "i", "move", M.interval_class(F.col("move")).alias("size"), M.direction(F.col("move")).alias("way")).where("move is not null"),
     GRID_SQL + "select sample_id, i, mv as move, case when mv = 0 then 'repeat' when abs(mv) <= 2 then 'step' when abs(mv) <= 5 then 'skip' else 'leap' end as size, case when mv > 0 then 'up' when mv < 0 then 'down' else 'same' end as way from n where mv is not null")
_add("moves_by_size", lambda s, d, clips=E.grid_excerpts: clips(s, d).select("sample_id", E.text(E.notes_reached_by(1, 2)).alias("small"), E.text(E.notes_reached_by(3, 5)).alias("middle"), E.text(E.notes_reached_by(6)).alias("large"), E.text(E.repeated_notes()).alias("repeated"), E.text(E.downward_notes()).alias("down"), E.largest_jump().alias("jump")),
     GRID_SQL + "select sample_id, " + ", ".join(f"coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where {c}), '') as {a}" for a, c in (("small", "abs(mv) between 1 and 2"), ("middle", "abs(mv) between 3 and 5"), ("large", "abs(mv) >= 6"), ("repeated", "mv = 0"), ("down", "mv < 0"))) + ", max(abs(mv)) as jump from c left join (select rid, i, mv from n) n using (rid) group by rid, sample_id")
_add("named_moves", _each("semitones", range(1, 13), lambda k: F.concat_ws(";", E.text(E.notes_reached_by_named(k, "ascending")), E.text(E.notes_reached_by_named(k, "descending")), E.count_moves_of(k).cast("string"))),
     GRID_SQL + "select sample_id, cast(k as integer) as semitones, coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where mv = k), '') || ';' || coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where mv = -k), '') || ';' || count(*) filter (where abs(mv) = k) as notes from c cross join range(1, 13) r(k) left join (select rid, i, mv from n) n using (rid) group by rid, sample_id, k")
_add("pitch_rank_notes", _each("rank", (1, 2), lambda r: F.concat_ws(";", E.text(E.pitch_rank_notes(r)), E.text(E.pitch_rank_notes(r, False)))),
     GRID_SQL + "select sample_id, cast(k as integer) as rank, coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where high_rank = k), '') || ';' || coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where low_rank = k), '') as notes from c cross join range(1, 3) r(k) left join (select rid, i, high_rank, low_rank from n) n using (rid) group by rid, sample_id, k")
_add("bar_structure", _q(lambda: F.size(E.in_bar(1)).alias("count1"), lambda: F.size(E.in_bar(2)).alias("count2"), lambda: E.bar_extreme(1).alias("high1"), lambda: E.bar_extreme(2).alias("high2"), lambda: E.bar_extreme(1, False).alias("low1"), lambda: E.bar_extreme(2, False).alias("low2"), lambda: E.text(E.last_notes_of_bars()).alias("last_notes")),
     GRID_SQL + "select sample_id, cast(count(*) filter (where bar = 1) as integer) as count1, cast(count(*) filter (where bar = 2) as integer) as count2, max(pitch) filter (where bar = 1) as high1, max(pitch) filter (where bar = 2) as high2, min(pitch) filter (where bar = 1) as low1, min(pitch) filter (where bar = 2) as low2, concat_ws(',', max(i) filter (where bar = 1), max(i) filter (where bar = 2)) as last_notes from c left join (select rid, i, bar, pitch from n) n using (rid) group by rid, sample_id")
COVER = 0.5


def _harmony(s, d):
    x = E.grid_excerpts(s, d).withColumn("t1", E.triad_of_bar(1, COVER)).withColumn("t2", E.triad_of_bar(2, COVER))
    name = lambda t: F.concat_ws(" ", M.note_name(t["root"]), t["kind"])
    t1, t2 = F.col("t1"), F.col("t2")
    return x.select("sample_id", F.when(t1.isNotNull(), name(t1)).alias("triad1"), F.when(t2.isNotNull(), name(t2)).alias("triad2"), F.pmod(t2["root"] - t1["root"], F.lit(12)).alias("root_motion"),
                    E.text(E.notes_not_in_other_triad(2, t2, t1)).alias("foreign2"), E.text(E.triad_member_notes(1, t1, "third")).alias("thirds1"))


_TRIADS_SQL = """, tri as (select root, kind, list_transform(steps, lambda s: (s + root) % 12) as pcs from range(0, 12) r(root), (values ('major', [0, 4, 7]), ('minor', [0, 3, 7])) k(kind, steps)),
fit as (select rid, bar, root, kind, pcs from (select rid, bar, pc from n) n, tri group by rid, bar, root, kind, pcs
  having count(*) >= 3 and count(*) filter (where list_contains(pcs, pc)) >= 0.5 * count(*) and count(distinct pc) filter (where list_contains(pcs, pc)) = 3),
only_ as (select rid, bar, any_value(root) as root, any_value(kind) as kind, any_value(pcs) as pcs from fit group by rid, bar having count(*) = 1)
"""
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in M.NOTE_NAMES) + "]"
_add("harmony", _harmony, GRID_SQL + _TRIADS_SQL + f"""select sample_id, any_value({_NAMES_SQL}[a.root + 1] || ' ' || a.kind) as triad1, any_value({_NAMES_SQL}[b.root + 1] || ' ' || b.kind) as triad2, cast(any_value((b.root - a.root + 12) % 12) as integer) as root_motion,
case when any_value(a.root) is not null and any_value(b.root) is not null then coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where n.bar = 2 and not list_contains(a.pcs, pc)), '') end as foreign2,
case when any_value(a.root) is not null then coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where n.bar = 1 and pc = a.pcs[2]), '') end as thirds1
from c left join only_ a on a.rid = c.rid and a.bar = 1 left join only_ b on b.rid = c.rid and b.bar = 2 left join (select rid, i, bar, pc from n) n on n.rid = c.rid group by c.rid, sample_id""")
ORACLE["distinct_names"] = GRID_SQL + f""", p as (select distinct rid, pc from n)
select sample_id, coalesce(string_agg({_NAMES_SQL}[pc + 1], ',' order by pc), '') as names, cast(count(pc) as integer) as count from c left join p using (rid) group by rid, sample_id"""


def _repetition(s, d):
    x = E.grid_excerpts(s, d).withColumn("d", E.bar_differences())
    return x.select("sample_id", E.bar_shift(F.col("d")).alias("shift"), F.when(F.col("d").isNotNull(), F.size(F.filter("d", lambda v: v != 0))).alias("different"), E.text(E.bar2_notes_differing()).alias("notes"))


_add("bar_repetition", _repetition, GRID_SQL + """, k as (select rid, bar, i, pitch, row_number() over (partition by rid, bar order by i) as k, count(*) over (partition by rid, bar) as m from n),
z as (select a.rid, b.i, b.pitch - a.pitch as d from k a join k b on a.rid = b.rid and a.bar = 1 and b.bar = 2 and a.k = b.k and a.m = b.m)
select sample_id, case when min(d) = max(d) then min(d) end as shift, case when count(d) > 0 then cast(count(*) filter (where d <> 0) as integer) end as different, case when count(d) > 0 then coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where d <> 0), '') end as notes
from c left join z using (rid) group by rid, sample_id""")


def _arpeggio(s, d):
    x = E.grid_excerpts(s, d).withColumn("kind1", E.arpeggio_kind(1)).withColumn("kind2", E.arpeggio_kind(2))
    return x.select("sample_id", "kind1", "kind2", E.text(E.arpeggio_first_cycle(1, F.col("kind1"))).alias("cycle1"), E.text(E.drop_back_notes(1)).alias("drops1"), E.text(E.drop_back_notes(2)).alias("drops2"))


_add("arpeggio", _arpeggio, GRID_SQL + """, r as (select rid, bar, i, pitch, mv, pbar, min(pitch) over (partition by rid, bar) as low, dense_rank() over (partition by rid, bar order by pitch) - 1 as rk, row_number() over (partition by rid, bar order by i) - 1 as k, count(*) over (partition by rid, bar) as m from n),
q as (select rid, bar, case when max(m) >= 4 and max(rk) = 2 then case when bool_and(rk = k % 3) then 'ascending' when bool_and(rk = [0, 1, 2, 1][k % 4 + 1]) then 'updown' end end as kind,
  string_agg(cast(i as varchar), ',' order by i) filter (where k < 3) as c3, string_agg(cast(i as varchar), ',' order by i) filter (where k < 4) as c4, coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where mv < 0 and pbar = bar and pitch = low), '') as drops from r group by rid, bar)
select sample_id, any_value(a.kind) as kind1, any_value(b.kind) as kind2, any_value(case a.kind when 'ascending' then a.c3 when 'updown' then a.c4 end) as cycle1, coalesce(any_value(a.drops), '') as drops1, coalesce(any_value(b.drops), '') as drops2
from c left join q a on a.rid = c.rid and a.bar = 1 left join q b on b.rid = c.rid and b.bar = 2 group by c.rid, sample_id""")
_add("note_spans", _q(lambda: E.frames_of(E.spans(E.notes_in_second_half(2))).cast("string").alias("frames")),
     GRID_SQL + f"""select sample_id, case when any_value({ON_GRID}) then '[' || coalesce(string_agg('[' || cast(round_even(round(st, 6) * 75, 0) as integer) || ', ' || cast(greatest(round_even(round(en, 6) * 75, 0), round_even(round(st, 6) * 75, 0) + 1) as integer) || ']', ', ' order by i) filter (where grid >= bpb / 2 and bar = 2), '') || ']' end as frames
from c left join (select rid, i, st, en, bar, grid from n) n using (rid) group by rid, sample_id""")

# these need no beat grid: the same over all notes of a clip, chords and notes beyond two bars included
for _name in ("distinct_names", "outside_scale", "never_played", "pitch_moves", "moves_by_size", "named_moves", "pitch_rank_notes"):
    _add(f"{_name}_whole", lambda s, d, f=QUERIES[_name]: f(s, d, E.clip_excerpts), ORACLE[_name].replace(GRID_SQL, RAW_SQL))
