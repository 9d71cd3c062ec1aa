"""Inspection of the clips table, with SQL over notes as rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notefold.functions import music as M
from notefold.operators import excerpt as E
from notefold.operators import inspection as I
from notefold.plans.excerpt_queries import RAW_SQL
from notefold.runtime import tables


def _inspected(s, d):
    c = I.issues(tables(s, d)("clips"))
    repeat = F.coalesce(I.tag(F.col("concepts"), "repetition_type") == "exact_bar_repeat", F.lit(False))
    c = c.withColumn("flags", I.quality_flags(exact_repeat=repeat))
    return c.withColumn("cls", I.classify(F.col("issues"), F.col("flags")))


def clip_issues(s, d):
    return _inspected(s, d).select("sample_id", F.array_join("issues", ",").alias("issues"), "event")


def clip_classes(s, d):
    return _inspected(s, d).select("sample_id", F.array_join("flags", ",").alias("flags"), "cls")


def issue_tally(s, d, top: int = 15):
    """The most frequent reasons of each class of clips: issues of hard ones, flags of the others; ties by name."""
    c = _inspected(s, d).where("cls <> 'clean'")
    n = c.select("cls", F.explode(F.when(F.col("cls") == "hard", F.col("issues")).otherwise(F.col("flags"))).alias("reason")).groupBy("cls", "reason").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("n").desc(), "reason"))
    return n.withColumn("place", place).where(F.col("place") <= top)


def class_counts(s, d):
    return _inspected(s, d).groupBy("cls").agg(F.count("*").alias("clips"))


def clip_validation(s, d):
    """Errors and warnings of clips against the controls their tags name."""
    c = tables(s, d)("clips")
    v = I.validated(c, I.tag(F.col("concepts"), "density"), I.tag(F.col("concepts"), "interval_profile"))
    return v.select("sample_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def length_names(s, d):
    """Name of the length of every note of the clips, and the scale and chord its pitch belongs to."""
    n = E.clip_excerpts(s, d).select("sample_id", "spb", F.inline("ev"))
    chord = M.chord_classes(F.lit("natural_minor"), F.col("pitch"), F.when(F.col("i") % 2 == 0, "iv").otherwise("none"))
    near = M.nearest_of_class(F.col("pitch"), F.col("i") * 5, F.lit(40), F.lit(57))
    return n.select(
        "sample_id", "i", M.duration_symbol(F.floor(F.col("ioi") / F.col("spb") * 2 + 0.5) / 2).alias("length"), M.scale_classes(F.lit("major"), F.col("pitch")).alias("scale"), chord.alias("chord"), near.alias("near"),
        F.size(M.pitches_within(F.col("pitch") - 12, F.col("pitch"), F.array(F.lit(0), F.lit(7)))).alias("within"),
    ).select("sample_id", "i", "length", F.array_join("scale", ",").alias("scale"), F.array_join("chord", ",").alias("chord"), "near", "within")


QUERIES = {f.__name__: f for f in (clip_issues, clip_classes, issue_tally, class_counts, clip_validation, length_names)}

_B = "basic_info."
_ISSUES = f"""b as (select row_number() over () as rid, * from clips),
x as (select rid, i, x.pitch as p, x.start as st, x."end" as en, x.velocity as v, basic_info.clip_duration_sec as clip, floor((x.start - basic_info.music_start_sec + 0.1) / basic_info.bar_duration_sec) + 1 as bar,
  basic_info.bar_duration_sec / basic_info.beats_per_bar as spb, lag(x.start) over w as ps, lag(x."end") over w as pe, lag(x.pitch) over w as pp
  from (select rid, basic_info, unnest(notes) as x, unnest(range(len(notes))) as i from b) window w as (partition by rid order by i)),
w as (select *, case when p is null then ['events:missing_key:pitch'] when st is null then ['events:missing_key:start'] when en is null then ['events:missing_key:end'] when v is null then ['events:missing_key:velocity']
  else list_filter([case when p < 0 or p > 127 then 'events:pitch_out_of_midi_range' end, case when v < 1 or v > 127 then 'events:velocity_out_of_range' end, case when en <= st + 1e-6 then 'events:non_positive_duration' end,
  case when st < -1e-6 then 'events:negative_onset' end, case when en > clip + 1e-4 then 'events:offset_after_clip_end' end, case when bar not in (1, 2) then 'events:bar_index_invalid' end,
  case when st < ps - 1e-6 then 'events:not_sorted_by_onset' end, case when st < pe - 1e-6 then 'events:polyphonic_overlap' end, case when st - pe > 2.0 then 'events:very_large_gap_sec' end], lambda z: z is not null) end as what from x),
bad as (select rid, min(i) as i, arg_min(what, i) as what from w where len(what) > 0 group by rid),
parts as (select b.*, bad.i as bad_i, coalesce(bad.what, []) as bad_what,
  list_filter([{', '.join(f"case when {c} is null then 'missing_top:{c}' end" for c in I.TOP)}], lambda z: z is not null) as tops,
  list_filter([{', '.join(f"case when {_B}{c} is null then 'missing_basic:{c}' end" for c in I.BASIC)}, case when coalesce({_B}num_bars, 0) <> 2 then 'basic:num_bars_not_2' end,
    case when {_B}num_notes <> len(notes) then 'basic:num_notes_mismatch' end, case when len(notes) = 0 then 'events:empty' end], lambda z: z is not null) as basics,
  list_filter([case when abs({_B}music_start_sec - {_B}leading_silence_sec) > 1e-4 then 'basic:music_start_mismatch' end, case when abs({_B}music_end_sec - {_B}clip_duration_sec) > 1e-4 then 'basic:music_end_mismatch' end,
    case when abs({_B}leading_silence_sec + 2.0 * {_B}bar_duration_sec - {_B}clip_duration_sec) > 1e-3 then 'basic:clip_duration_inconsistent' end, case when {_B}leading_silence_sec < -1e-6 then 'basic:negative_leading_silence' end,
    case when {_B}clip_duration_sec <= 0 then 'basic:non_positive_clip_duration' end], lambda z: z is not null) as times from b left join bad using (rid)),
iss as (select *, case when len(tops) > 0 then tops when len(basics) > 0 then basics else list_concat(times, bad_what) end as issues, case when len(tops) = 0 and len(basics) = 0 then bad_i end as event from parts),
st as (select rid, max(p) - min(p) as span, count(distinct p) as kinds, sum(v) / count(*) as loud, round(sum((en - st) / spb) / count(*), 6) as beats, count(*) filter (where bar = 1) as n1, count(*) filter (where bar = 2) as n2 from x group by rid),
fl as (select iss.*, case when len(issues) > 0 then [] else list_filter([case when {_B}num_notes < 5 then 'quality:too_few_notes' end, case when span = 0 then 'quality:zero_pitch_span' end, case when kinds <= 1 then 'quality:single_unique_pitch' end,
  case when kinds = 2 then 'quality:very_low_unique_pitch_count' end, case when span >= 24 then 'quality:very_large_pitch_span' end, case when loud < 45 or loud > 115 then 'quality:mean_velocity_extreme' end,
  case when beats > 2.2 then 'quality:mean_duration_too_long' end, case when n1 <> n2 and list_contains(concepts, 'repetition_type:exact_bar_repeat') then 'quality:exact_repeat_bar_note_count_mismatch' end], lambda z: z is not null) end as flags from iss left join st using (rid)),
cl as (select *, case when len(issues) > 0 then 'hard' when list_has_any(flags, {I.SOFT}) then 'soft' when list_has_any(flags, {I.REVIEW}) then 'review' else 'clean' end as cls from fl)
"""
_TAG = "list_filter(concepts, lambda z: starts_with(z, '{f}:'))[1][{n}:]"
ORACLE = {
    "clip_issues": f"with {_ISSUES} select sample_id, array_to_string(issues, ',') as issues, cast(event as integer) as event from iss",
    "clip_classes": f"with {_ISSUES} select sample_id, array_to_string(flags, ',') as flags, cls from cl",
    "class_counts": f"with {_ISSUES} select cls, count(*) as clips from cl group by cls",
    "issue_tally": f"with {_ISSUES}, r as (select cls, unnest(case when cls = 'hard' then issues else flags end) as reason from cl where cls <> 'clean'), t as (select cls, reason, count(*) as n from r group by all) select *, cast(row_number() over (partition by cls order by n desc, reason) as integer) as place from t qualify place <= 15",
    "clip_validation": f"""with {_ISSUES},
y as (select *, (st - pe) / spb as gap, case when p < {I.LOWEST} or p > {I.HIGHEST} then 'events:pitch_out_of_range' when en <= st then 'events:non_positive_duration' when st < -1e-9 or en > clip + 1e-6 then 'events:time_out_of_clip'
  when st < ps - 1e-9 then 'events:onset_not_sorted' when st < pe - 1e-9 then 'events:polyphonic_overlap' when (st - pe) / spb > 1.5 + 1e-9 then 'music:gap_too_large' end as f from x),
f as (select rid, min(i) as i, arg_min(f, i) as f from y where f is not null group by rid),
g as (select y.rid, count(*) as m, any_value(f.f) as fault, count(*) filter (where y.i < coalesce(f.i, 1000000) and gap > 0.75 + 1e-9) as large, coalesce(max(gap) filter (where y.i < coalesce(f.i, 1000000) or (y.i = f.i and f.f = 'music:gap_too_large')), 0) as most,
  count(*) filter (where abs(p - pp) >= 6) as leaps from y left join f using (rid) group by y.rid),
z as (select b.*, coalesce(m, 0) as m, fault, coalesce(large, 0) as large, coalesce(most, 0) as most, coalesce(leaps, 0) as leaps, {_TAG.format(f='density', n=9)} as density, {_TAG.format(f='interval_profile', n=18)} as prof from b left join g using (rid)),
q as (select *, case when density = 'sparse' then 5 when density = 'medium' then 7 when density = 'dense' then case when {_B}time_signature = '6/8' then 9 else 10 end end as lo, case when density = 'sparse' then 6 when density = 'medium' then 9 when density = 'dense' then case when {_B}time_signature = '6/8' then 11 else 12 end end as hi from z)
select sample_id, array_to_string(list_filter([case when coalesce({_B}num_bars, 0) <> 2 then 'basic:num_bars_not_2' end, case when {_B}num_notes is distinct from len(coalesce(notes, [])) then 'basic:num_notes_mismatch' end, case when m = 0 then 'events:empty' end,
  case when {_B}tempo_class is distinct from case {_B}tempo_bpm {' '.join(f"when {k} then '{v}'" for k, v in I.TEMPO_CLASS.items())} end then 'basic:tempo_class_mismatch' end,
  case when abs({_B}clip_duration_sec - ({_B}leading_silence_sec + 2 * {_B}bar_duration_sec)) > 1e-6 then 'basic:clip_bar_duration_inconsistent' end, case when {_B}clip_duration_sec > 8 + 1e-6 then 'basic:clip_duration_too_long' end, fault,
  case when m < 5 then 'music:too_few_notes' end], lambda e: e is not null), ',') as errors,
  array_to_string(list_filter([case when m not between lo and hi then 'control:density_realization_off' end, case when prof = 'conjunct' and leaps > greatest(1, m // 4) then 'control:conjunct_too_many_leaps' end, case when prof = 'disjunct' and leaps = 0 then 'control:disjunct_no_leaps' end,
  case when large >= 2 then 'music:multiple_large_gaps' end, case when most > 1.0 + 1e-9 then 'music:max_gap_gt_1_beat' end], lambda e: e is not null), ',') as warnings from q""",
}


def _length_sql(raw: str) -> str:
    minor, steps = [5, 8, 0], "list_sort(list_transform({s}, lambda t: (t + pitch) % 12))"
    join = "array_to_string(" + steps + ", ',')"
    return raw + f"""select sample_id, i, case floor(ioi / spb * 2 + 0.5) / 2 when 0.5 then 'eighth' when 1.0 then 'quarter' when 1.5 then 'dotted_quarter' when 2.0 then 'half' else case when floor(ioi / spb * 2 + 0.5) / 2 < 1 then 'short' when floor(ioi / spb * 2 + 0.5) / 2 < 2 then 'medium' when ioi is not null then 'long' end end as length,
  {join.format(s=M.SCALES['major'])} as scale, case when i % 2 = 0 then {join.format(s=minor)} else {join.format(s=[0, 3, 7])} end as chord,
  (select arg_min(q, (abs(q - pitch), q)) from range(40, 58) r(q) where q % 12 = (i * 5) % 12)::integer as near, (select count(*) from range(pitch - 12, pitch + 1) r(q) where q % 12 in (0, 7))::integer as within from n"""




ORACLE["length_names"] = _length_sql(RAW_SQL)
