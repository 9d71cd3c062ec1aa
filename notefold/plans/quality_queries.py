"""Integrity, statistics, gates and joins over the project's tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from notefold.functions import spans as SP
from notefold.functions import wording as W
from notefold.functions.ids import split_name, sql_split_name
from notefold.operators import excerpt as E
from notefold.operators import quality as Q
from notefold.operators import scoring as G
from notefold.plans.excerpt_queries import GRID_SQL, RAW_SQL
from notefold.plans.selection_queries import _IT, items
from notefold.plans.short_clip_queries import PH
from notefold.runtime import tables


def derived_attributes(s, d, clips=E.grid_excerpts):
    a = clips(s, d).select("sample_id", *Q.derived_attributes())
    return a.withColumn("mean_beats", F.round(F.col("mean_beats") + 1e-9, 4)).withColumn("mean_velocity", F.round("mean_velocity", 6))


def motif_repetition(s, d, clips=E.grid_excerpts):
    return Q.motifs(clips(s, d)).select("sample_id", "move", "value", "n")


_INFO = ["time_signature", "tempo_class", "meter_class", "subdivision_type"]


def value_shares(s, d):
    r = tables(s, d)("clips").select("basic_info.*")
    return Q.value_shares(r, _INFO).select("field", "value", "n", F.round("share", 6).alias("share"))


def dominant_values(s, d):
    return Q.dominant_values(tables(s, d)("clips").select("basic_info.*"), _INFO, 0.3).select("field", "value", "n")


def numeric_summary(s, d):
    r = tables(s, d)("clips").select("basic_info.tempo_bpm", "basic_info.num_notes", "basic_info.clip_duration_sec")
    return Q.numeric_summary(r, r.columns).withColumn("mean", F.round("mean", 6))


def length_statistics(s, d):
    r = tables(s, d)("clips").select(split_name(F.col("split"), F.col("sample_id")).alias("split"), F.col("basic_info.clip_duration_sec").alias("sec"))
    return Q.length_statistics(r, "split", "sec").select("split", "least", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "most")


def pitch_coverage(s, d):
    return Q.pitch_coverage(E.clip_excerpts(s, d).select(F.inline("ev")).select("pitch"))


def interval_histogram(s, d):
    n = E.clip_excerpts(s, d).select(F.inline("ev")).where("move is not null")
    return n.groupBy("move").agg(F.count("*").alias("n"))


def majority_share(s, d):
    """Per split and family of understanding items, by the answer; the test split is exempt."""
    q = tables(s, d)("qa_items").where("evidence_type is not null and source_fact_id is not null and gold_answer is not null")
    q = q.select("item_id", split_name(F.col("split"), F.col("sample_id")).alias("split"), F.col("source_fact_id").alias("family"), "gold_answer").distinct()
    m = Q.majority_share(q, ["split", "family"], "gold_answer", F.col("gold_answer").isin("true", "false"), F.col("split") == "test")
    return m.withColumn("share", F.round("share", 6)).withColumn("limit", F.round("limit", 6))


def yesno_share(s, d):
    m = Q.share_of(items(s, d).where("understanding and concept is not null"), ["concept"], F.col("boolean"), 0.10)
    return m.withColumn("share", F.round("share", 6))


def empty_share(s, d):
    m = Q.share_of(items(s, d).where("not understanding and family is not null"), ["family"], F.col("empty"), 0.20)
    return m.withColumn("share", F.round("share", 6))


def median_span_hit(s, d):
    """From the answers of train to those of test, per family of grounding items."""
    q = tables(s, d)("qa_items").where("evidence_type is null and source_fact_id is not null")
    q = q.select("item_id", "source_fact_id", split_name(F.col("split"), F.col("sample_id")).alias("split"), SP.from_pairs(F.col("answer_spans_sec")).alias("spans")).distinct()
    return Q.median_span_hits(q.where("split = 'train'"), q.where("split = 'test'"), "source_fact_id", "spans").withColumn("hits", F.round("hits", 6))


# context sentences: those of this engine's wordings and those of the tables
CONTEXTS = [*[re.escape(t).replace(r"\{x\}", "[0-9/]+").replace("\\ ", " ") for t in W.TEMPOS + W.METERS], r"Count [0-9]+ beats each minute\.", r"The piece moves in [0-9]+/[0-9]+\."]


def skeleton_counts(s, d):
    """Wordings per family of the questions of train."""
    q = tables(s, d)("qa_items").where("source_fact_id is not null and question is not null").where(split_name(F.col("split"), F.col("sample_id")) == "train")
    return q.groupBy("source_fact_id").agg(F.count_distinct(Q.skeleton(F.col("question"), CONTEXTS)).alias("skeletons"), F.count("*").alias("n"))


def text_contract(s, d):
    q = tables(s, d)("qa_items").select("item_id", F.array_join(Q.text_contract(F.col("question"), F.col("answer_text")), ",").alias("broken"))
    return q.where("broken <> ''").distinct()


def rederived_moves(s, d, clips=E.grid_excerpts):
    """Notes reached by a leap, from array functions and again from rows and a window."""
    e = clips(s, d).withColumn("rid", F.monotonically_increasing_id())
    from pyspark.sql import Window

    from notefold.runtime import cut

    e = cut(e.select("rid", "ev"))
    a = e.select("rid", F.explode(E.notes_reached_by(6)).alias("i"), F.lit(True).alias("leap"))
    n = e.select("rid", F.inline("ev")).select("rid", "i", "pitch")
    b = n.withColumn("m", F.col("pitch") - F.lag("pitch").over(Window.partitionBy("rid").orderBy("i"))).where("abs(m) >= 6").select("rid", "i", F.lit(True).alias("leap"))
    return Q.rederived(a, b, ["rid", "i"], "leap")


def text_baseline(s, d):
    """How well the text of a question alone tells its answer, per family of understanding items, from train to test."""
    q = tables(s, d)("qa_items").where("evidence_type is not null and source_fact_id is not null and gold_answer is not null and item_id is not null")
    q = q.select("item_id", split_name(F.col("split"), F.col("sample_id")).alias("split"), F.col("source_fact_id").alias("family"), "question", "gold_answer").distinct()
    q = q.where(F.col("split").isin("train", "test"))
    r = Q.text_baseline(q, "family", "question", "gold_answer", F.col("split") == "train")
    return r.select("family", "rows", *[F.round(c, 6).alias(c) for c in ("accuracy", "majority", "z")], "passed")


def _splitted(s, d, clips):
    return clips(s, d).withColumn("split", split_name(F.col("split"), F.col("sample_id")))


def twin_flags(s, d, clips=E.grid_excerpts):
    return Q.twins(Q.signatures(_splitted(s, d, clips)), ["tune", "rhythm"], ["tune_in_train", "rhythm_in_train"])


def split_overlap(s, d, clips=E.grid_excerpts):
    """Clips that two splits have in common, note for note."""
    return Q.shared_signatures(Q.signatures(_splitted(s, d, clips)))


def short_twins(s, d):
    """Phrases of three notes of val and test whose pitches, or notes, occur in train."""
    from notefold.operators import short_clips as SC

    ph = SC.phrases(E.clip_excerpts(s, d)).withColumn("split", F.split_part("sample_id", F.lit("_"), F.lit(1)))
    return Q.twins(Q.short_signatures(ph), ["pitches", "all"], ["pitches_in_train", "all_in_train"], ("sample_id", "phrase"))


def _predictions(s, d):
    q = tables(s, d)("qa_items").where("sample_id is not null and question is not null")
    return q.where("item_id % 10 > 0").groupBy("sample_id", "question").agg(F.max("answer_text").alias("prediction"))


def align_left_join(s, d):
    q = tables(s, d)("qa_items").select("item_id", "sample_id", "question")
    return G.aligned(q, _predictions(s, d), allow_missing=True).select("item_id", F.char_length("prediction").alias("chars"))


def missing_preds(s, d):
    q = tables(s, d)("qa_items").where("sample_id is not null and question is not null").select("item_id", "sample_id", "question")
    return G.remaining(q, _predictions(s, d)).select("item_id").distinct()


def extra_preds(s, d):
    q = tables(s, d)("qa_items").where("item_id % 7 > 0").select("sample_id", "question")
    return G.unmatched_predictions(q, _predictions(s, d)).select("sample_id", "question").distinct()


def dup_preds(s, d):
    return G.duplicate_predictions(tables(s, d)("qa_items").where("sample_id is not null").select("sample_id", "question", F.col("answer_text").alias("prediction")))


def clip_recordings(s, d):
    """Clips with their recording, if there is one, by base name; repeated rows once."""
    from notefold.functions.ids import clip_id

    t = tables(s, d)
    a = t("audio_files").select(clip_id(F.col("audio_path")).alias("id"), F.col("audio_path"), "duration_sec").distinct()
    c = t("clips").select("sample_id").distinct()
    return c.join(a, F.col("sample_id") == F.col("id"), "left").groupBy("sample_id").agg(F.min("audio_path").alias("audio_path"), F.round(F.max("duration_sec"), 3).alias("sec"))


def overlong(s, d, frames: int = 450, fps: int = 75):
    """Recordings of more frames than a model takes."""
    a = tables(s, d)("audio_files")
    return a.where(F.floor(F.col("duration_sec") * F.col("sample_rate")) / F.col("sample_rate") * fps > frames).select("audio_path", "duration_sec").distinct()


def stale_values(s, d):
    return Q.stale_values(tables(s, d)("clips"))


def midi_round_trip(s, d):
    """Clips as files and back: no pitch is lost and no time moves by more than half a tick."""
    from notefold.sources.midi import through_midi

    c = through_midi(E.grid_excerpts(s, d).select("sample_id", F.transform("ev", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity"))).alias("notes")))
    return c.select("sample_id", F.size("notes").alias("notes"), F.coalesce(Q.note_deviation(F.col("notes"), F.col("again")) <= 0.5 / 440 + 1e-9, F.lit(False)).alias("faithful"))


def midi_round_trip_whole(s, d):
    """As ``midi_round_trip`` with all notes; notes are compared by pitch, as those of a chord may change places within a tick."""
    from notefold.sources.midi import through_midi

    c = through_midi(E.clip_excerpts(s, d).select("sample_id", F.transform("ev", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity"))).alias("notes")))
    by_pitch = lambda n: F.array_sort(F.transform(n, lambda x: F.struct(x["pitch"].alias("pitch"), x["start"].alias("start"), x["end"].alias("end"))))
    return c.select("sample_id", F.size("notes").alias("notes"), F.coalesce(Q.note_deviation(by_pitch("notes"), by_pitch("again")) <= 0.5 / 440 + 1e-9, F.lit(False)).alias("faithful"))


def gate_report(s, d):
    """All gates whose numbers can be had from the tables: rows checked (families, concepts, splits), failed, and whether the gate passed."""
    from notefold.plans import candidate_queries as CQ

    agree = CQ.rederived(s, d).withColumn("passed", F.col("status") != "different")
    short = CQ.short_rederived(s, d).withColumn("passed", F.col("status") != "different")
    contract = CQ.question_contract(s, d).withColumn("passed", F.col("broken") == 0)
    return Q.gate_report({"majority": majority_share(s, d), "yes_no": yesno_share(s, d), "empty": empty_share(s, d), "median_span": median_span_hit(s, d), "rederived": agree, "short_rederived": short, "contract": contract})


def split_status(s, d):
    """Rows of clips by split and whether they are still there."""
    c = tables(s, d)("clips").select(split_name(F.col("split"), F.col("sample_id")).alias("split"), F.when(F.col("removed_at").isNull(), "there").otherwise("removed").alias("status"))
    return c.groupBy("split", "status").agg(F.count("*").alias("n"))


_OVER = "select distinct audio_path, duration_sec from audio_files where floor(duration_sec * sample_rate) / sample_rate * 75 > 450"
QUERIES = {f.__name__: f for f in (derived_attributes, motif_repetition, value_shares, dominant_values, numeric_summary, length_statistics, pitch_coverage, interval_histogram, majority_share, yesno_share, empty_share, median_span_hit, skeleton_counts, text_contract, rederived_moves, text_baseline, twin_flags, split_overlap, short_twins, align_left_join, missing_preds, extra_preds, dup_preds, clip_recordings, overlong, stale_values, midi_round_trip, midi_round_trip_whole, gate_report, split_status)}


def _skeleton_sql(x: str) -> str:
    for pattern, mask in Q.masks(CONTEXTS):
        x = f"regexp_replace({x}, '{pattern}', '{mask}', 'g')"
    return x


_LONG = " union all ".join(f"select '{f}' as field, basic_info.{f} as value from clips" for f in _INFO)
_PRED = "pr as (select sample_id, question, max(answer_text) as prediction from qa_items where sample_id is not null and question is not null and item_id % 10 > 0 group by all)"
_SIG = GRID_SQL + f""", sg as (select rid, coalesce(string_agg(cast(pitch as varchar), '-' order by i), '') as tune,
  coalesce(string_agg(pitch || ':' || cast(round_even((st - st0) / 0.05, 0) as bigint) || ':' || cast(round_even((en - st) / 0.05, 0) as bigint), '-' order by i), '') as rhythm,
  coalesce(string_agg(concat_ws(':', pitch, velocity, cast(round_even(st * 100, 0) as bigint), cast(round_even(en * 100, 0) as bigint)), '-' order by i), '') as whole from (select *, min(st) over (partition by rid) as st0 from n) group by rid),
g as (select c.rid, sample_id, {sql_split_name('split', 'sample_id')} as sp, coalesce(tune, '') as tune, coalesce(rhythm, '') as rhythm, coalesce(whole, '') as whole from c left join sg using (rid))"""
ORACLE = {
    "derived_attributes": GRID_SQL + """, t as (select rid, count(*) filter (where sg <> psg) as turns from (select rid, sign(mv) as sg, lag(sign(mv)) over (partition by rid order by i) as psg from n where mv <> 0) group by rid),
u as (select rid, count(*) as cells, count(distinct (mv, len)) as kinds from (select rid, mv, lag(floor((en - st) / spb * 1000 + 0.5)) over (partition by rid order by i) as len from n) where mv is not null group by rid)
select sample_id, count(i)::integer as notes, (count(*) filter (where bar = 1))::integer as notes1, (count(*) filter (where bar = 2))::integer as notes2, coalesce(min(pitch), 0) as low, coalesce(max(pitch), 0) as high, coalesce(max(pitch) - min(pitch), 0) as span,
  count(distinct pitch)::integer as different, count(distinct pitch) < count(pitch) as repeated_pitch, round(coalesce(avg((en - st) / spb), 0) + 1e-9, 4) as mean_beats, round(coalesce(avg(velocity), 0), 6) as mean_velocity,
  (count(*) filter (where abs(mv) in (1, 2)))::integer as steps, (count(*) filter (where abs(mv) in (3, 4, 5)))::integer as skips, (count(*) filter (where abs(mv) >= 6))::integer as leaps, coalesce(any_value(turns), 0)::integer as turns,
  count(i) >= 4 and coalesce(any_value(kinds) < any_value(cells), false) as motif
from c left join (select rid, i, bar, pitch, velocity, mv, st, en from n) n using (rid) left join t using (rid) left join u using (rid) group by rid, sample_id""",
    "motif_repetition": GRID_SQL + ", l as (select rid, sample_id, mv, lag(val) over (partition by rid order by i) as lv from n) select sample_id, mv as move, lv as value, count(*) as n from l where mv is not null and lv is not null group by rid, sample_id, mv, lv having count(*) > 1",
    "value_shares": f"with l as ({_LONG}) select field, value, count(*) as n, round(count(*) / sum(count(*)) over (partition by field), 6) as share from l group by field, value",
    "dominant_values": f"with l as ({_LONG}), z as (select field, value, count(*) as n, count(*) / sum(count(*)) over (partition by field) as share from l group by field, value) select field, value, n from z where share > 0.3",
    "numeric_summary": "with l as (" + " union all ".join(f"select '{f}' as field, basic_info.{f}::double as v from clips" for f in ("tempo_bpm", "num_notes", "clip_duration_sec")) + ") select field, count(v) as n, min(v) as least, max(v) as most, round(avg(v), 6) as mean from l group by field",
    "length_statistics": f"select {sql_split_name('split', 'sample_id')} as split, min(sec) as least, round(avg(sec), 6) as mean, round(quantile_cont(sec, 0.5), 6) as median, round(quantile_cont(sec, 0.95), 6) as p95, max(sec) as most from (select *, basic_info.clip_duration_sec as sec from clips) group by 1",
    "pitch_coverage": RAW_SQL + "select cast(k as integer) as pitch, count(n.pitch) as n from range(21, 109) r(k) left join n on n.pitch = k group by k",
    "interval_histogram": RAW_SQL + "select mv as move, count(*) as n from n where mv is not null group by mv",
    "majority_share": f"""with q as (select distinct item_id, {sql_split_name('split', 'sample_id')} as split, source_fact_id as family, gold_answer from qa_items where evidence_type is not null and source_fact_id is not null and gold_answer is not null),
c as (select split, family, gold_answer, count(*) as n, sum(count(*)) over (partition by split, family) as total from q group by split, family, gold_answer),
g as (select split, family, cast(sum(n) as bigint) as rows, count(*) as classes, max(n) / sum(n) as share, case when bool_and(gold_answer in ('true', 'false')) then 0.55 else greatest(0.35, 1.5 / greatest(1, count(*) filter (where n >= 2 and n >= 0.01 * total))) end as lim from c group by split, family)
select split, family, rows, classes, round(share, 6) as share, round(lim::double, 6) as "limit", share <= lim + 0.01 or rows < 200 or coalesce(split = 'test', false) as passed from g""",
    "yesno_share": f"with {_IT} select concept, count(*) as rows, round(avg(boolean::int), 6) as share, avg(boolean::int) <= 0.1 as passed from it where understanding and concept is not null group by concept",
    "empty_share": f"with {_IT} select family, count(*) as rows, round(avg(empty::int), 6) as share, avg(empty::int) <= 0.2 as passed from it where not understanding and family is not null group by family",
    "median_span_hit": f"""with q as (select row_number() over () as rid, * from (select distinct item_id, source_fact_id, {sql_split_name('split', 'sample_id')} as split, coalesce(answer_spans_sec, []) as sp from qa_items where evidence_type is null and source_fact_id is not null)),
m as (select source_fact_id, quantile_cont(x[1], 0.5) as ms, quantile_cont(x[2], 0.5) as me from (select source_fact_id, unnest(sp) as x from q where split = 'train') group by all),
x as (select rid, unnest(sp) as x from q where split = 'test'),
h as (select rid, bool_or(case when un > 0 then ov / un else 0 end >= 0.5) as hit from (select rid, greatest(0, least(me, x[2]) - greatest(ms, x[1])) as ov, greatest(0, me - ms + x[2] - x[1] - greatest(0, least(me, x[2]) - greatest(ms, x[1]))) as un from x join q using (rid) join m using (source_fact_id)) group by rid),
t as (select source_fact_id, rid from q where split = 'test')
select m.source_fact_id, count(t.rid) as rows, round(avg(case when t.rid is not null then coalesce(hit, false)::int end), 6) as hits, coalesce(avg(case when t.rid is not null then coalesce(hit, false)::int end) <= 0.4, false) as passed
from m left join t using (source_fact_id) left join h on h.rid = t.rid group by m.source_fact_id""",
    "skeleton_counts": f"select source_fact_id, count(distinct trim({_skeleton_sql('question')})) as skeletons, count(*) as n from qa_items where source_fact_id is not null and question is not null and {sql_split_name('split', 'sample_id')} = 'train' group by all",
    "text_contract": "with z as (select distinct item_id, array_to_string(list_filter([case when trim(question) = '' then 'blank_question' end, case when not regexp_matches(question, '[?.]$') then 'no_end_mark' end, case when regexp_matches(question, '\\{|\\}') then 'open_placeholder' end, case when regexp_matches(question, '\\s\\s') then 'double_space' end, case when trim(answer_text) = '' then 'blank_answer' end, case when regexp_matches(answer_text, '\\b1 (notes|seconds|beats|semitones)\\b') then 'plural' end, case when regexp_matches(question, '(?i)\\b(a) [aeiou]') then 'article' end], lambda v: v is not null), ',') as broken from qa_items) select * from z where broken <> ''",
    "rederived_moves": GRID_SQL + "select 'equal' as status, count(*) as n from n where abs(mv) >= 6",
    "twin_flags": _SIG + " select sample_id, coalesce(tune in (select tune from g where sp = 'train'), false) as tune_in_train, coalesce(rhythm in (select rhythm from g where sp = 'train'), false) as rhythm_in_train from g where sp in ('val', 'test')",
    "split_overlap": _SIG + """, h as (select whole, bool_or(sp = 'train') as a, bool_or(sp = 'val') as b, bool_or(sp = 'test') as c from g where whole <> '' group by whole),
l as (select unnest(['train-val', 'train-test', 'val-test']) as pair, unnest([a and b, a and c, b and c]) as hit from h) select pair, count(*) filter (where hit) as clips from l group by pair""",
    "short_twins": PH + """, z as (select rid, sample_id, phrase, split_part(sample_id, '_', 1) as sp, string_agg(cast(pitch as varchar), '-' order by pitch) as a,
  string_agg(concat_ws(':', pitch, velocity, cast(round_even((st - st0) / 0.05, 0) as bigint), cast(round_even((en - st) / 0.05, 0) as bigint)), '-' order by k) as b from (select *, min(st) over (partition by rid, phrase) as st0 from ph) group by rid, sample_id, phrase)
select sample_id, phrase, a in (select a from z where sp = 'train') as pitches_in_train, b in (select b from z where sp = 'train') as all_in_train from z where sp in ('val', 'test')""",
    "align_left_join": f"with {_PRED} select item_id, cast(length(coalesce(prediction, '')) as integer) as chars from qa_items q left join pr on pr.sample_id is not distinct from q.sample_id and pr.question is not distinct from q.question",
    "missing_preds": f"with {_PRED} select distinct item_id from qa_items q where sample_id is not null and question is not null and not exists (select 1 from pr where pr.sample_id = q.sample_id and pr.question = q.question)",
    "extra_preds": f"with {_PRED} select distinct sample_id, question from pr where not exists (select 1 from qa_items q where item_id % 7 > 0 and pr.sample_id = q.sample_id and pr.question = q.question)",
    "dup_preds": "select sample_id, question, count(*) as n from qa_items where sample_id is not null group by all having count(*) > 1",
    "clip_recordings": "with a as (select distinct regexp_replace(regexp_replace(lower(trim(audio_path)), '^.*/', ''), '\\.(mid|json|wav)$', '') as id, audio_path, duration_sec from audio_files), c as (select distinct sample_id from clips) select sample_id, min(audio_path) as audio_path, round(max(duration_sec), 3) as sec from c left join a on a.id = c.sample_id group by sample_id",
    "overlong": _OVER,
    "stale_values": "select sample_id, unnest(list_filter([case when basic_info.num_notes <> len(notes) then 'num_notes' end, case when basic_info.beats_per_bar <> case basic_info.time_signature when '2/4' then 2 when '3/4' then 3 when '4/4' then 4 when '6/8' then 6 end then 'beats_per_bar' end, case when abs(basic_info.music_end_sec - list_max(list_transform(notes, lambda x: x.\"end\"))) > 0.05 then 'music_end_sec' end, case when abs(basic_info.music_start_sec - list_min(list_transform(notes, lambda x: x.start))) > 0.05 then 'music_start_sec' end], lambda v: v is not null)) as field from clips",
    "midi_round_trip": GRID_SQL + "select sample_id, cnt::integer as notes, true as faithful from c",
    "split_status": f"select {sql_split_name('split', 'sample_id')} as split, case when removed_at is null then 'there' else 'removed' end as status, count(*) as n from clips group by all",
}


def _gates_sql() -> str:
    from notefold.plans.candidate_queries import ORACLE as CQ

    parts = [(n, ORACLE[k]) for n, k in (("majority", "majority_share"), ("yes_no", "yesno_share"), ("empty", "empty_share"), ("median_span", "median_span_hit"))]
    parts += [(n, f"select true as passed from ({CQ[k]}) q") for n, k in (("rederived", "rederived"), ("short_rederived", "short_rederived"), ("contract", "question_contract"))]
    return " union all ".join(f"select '{n}' as gate, count(*) as checked, count(*) filter (where not passed) as failed, count(*) filter (where not passed) = 0 as passed from ({q}) g" for n, q in parts)


ORACLE["gate_report"] = _gates_sql()


# the same over all notes of a clip, chords and notes beyond two bars included
for _f in (derived_attributes, motif_repetition, rederived_moves, twin_flags, split_overlap):
    QUERIES[f"{_f.__name__}_whole"] = lambda s, d, f=_f: f(s, d, E.clip_excerpts)
    ORACLE[f"{_f.__name__}_whole"] = ORACLE[_f.__name__].replace(GRID_SQL, RAW_SQL)
