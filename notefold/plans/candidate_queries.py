"""Candidates, their stability under jitter and their wording, over the project's clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from notefold.functions import wording as W
from notefold.operators import candidates as C
from notefold.operators import checking as K
from notefold.operators import excerpt as E
from notefold.operators import records as R
from notefold.plans.candidate_sql import candidates
from notefold.plans.excerpt_queries import GRID_SQL
from notefold.plans.short_clip_queries import PH, _phrases
from notefold.runtime import tables


def _grid(s, d):
    return E.grid_excerpts(s, d)


def _rows(df):
    return df.select("sample_id", "fam", "sub", "params", "akey", "stratum", E.text(F.col("idx")).alias("notes"), "gold")


def candidate_rows(s, d):
    """All families of two-bar clips; triads need half of a bar's notes, as full ones are rare here."""
    return _rows(C.candidates(_grid(s, d), cover=0.5))


def candidate_harmony(s, d):
    """Families over triads that need nine tenths of a bar's notes, as questions do by default."""
    return _rows(C.candidates(_grid(s, d), ["harmony", "patterns"]))


def candidate_intervals(s, d):
    return _rows(C.candidates(_grid(s, d), ["intervals"]))


def candidate_bars(s, d):
    return _rows(C.candidates(_grid(s, d), ["bars"]))


def short_candidates(s, d):
    return C.short_candidates(_phrases(s, d)).select("sample_id", "phrase", "fam", "sub", "params", "akey", E.text(F.col("idx")).alias("notes"))


def short_order_candidates(s, d):
    return short_candidates(s, d).where("fam in ('O-NOTE', 'R-PITCH', 'P-CONTOUR')").drop("params")


def rederived(s, d):
    """All candidates of two-bar clips derived a second time: per family and status how many; none may differ."""
    return K.checked(_grid(s, d), cover=0.5, tally=True).groupBy("fam", "status").agg(F.sum("n").alias("n"))


def short_rederived(s, d):
    """The same for clips of one to three notes."""
    return K.checked_short(C.short_candidates(_phrases(s, d)), tally=True).groupBy("fam", "status").agg(F.sum("n").alias("n"))


def record_structure(s, d):
    """Question records with a field missing, or spans in frames that are not those in seconds."""
    return K.structure(tables(s, d)("qa_items")).where("size(broken) > 0").select("item_id", F.array_join("broken", ",").alias("broken")).distinct()


def jitter_stable(s, d):
    """Candidates of all families that hold in ten jittered copies of their clip."""
    return C.stable(E.quantised(E.clip_rows(s, d)), cover=0.5, fields=("sample_id", "fam", "sub", "akey", "notes", "gold"))


def _records(s, d):
    return R.rendered(C.candidates(_grid(s, d), cover=0.5, also=("ev", "rest_free", "frame_full")))


def _short_records(s, d):
    c = C.short_candidates(_phrases(s, d)).withColumn("meter", F.lit(None).cast("string")).withColumn("bpm", F.lit(None).cast("int"))
    spans = F.transform("idx", lambda i: F.struct(F.get("v", i)["start"].alias("s"), F.get("v", i)["end"].alias("e")))
    return R.rendered(c.withColumn("spans", spans).withColumn("sample_id", F.concat_ws("#", "sample_id", F.col("phrase").cast("string"))), False)


def _texts(r):
    return r.select("sample_id", "fam", "sub", "params", "question", *[F.get("answers", F.lit(k)).alias(f"a{k}") for k in range(3)], "box")


def rendered_questions(s, d):
    """Questions of all families of two-bar clips with answers in three styles."""
    return _texts(_records(s, d))


def short_questions(s, d):
    """Questions of all families of clips of one to three notes."""
    return _texts(_short_records(s, d))


def question_contract(s, d):
    """Per family the questions rendered and those that break the contract between text and parameters."""
    return R.contract_counts(_records(s, d), R.broken_contract())


def short_contract(s, d):
    return R.contract_counts(_short_records(s, d), R.broken_short())


def answer_text(s, d):
    """Numeric answers: moves of a third, said in three ways."""
    x = _grid(s, d).select("sample_id", W.numeric_answers(E.count_moves_of(4), F.lit("moves")).alias("a"))
    return x.select("sample_id", F.get("a", F.lit(0)).alias("a0"), F.get("a", F.lit(1)).alias("a1"), F.get("a", F.lit(2)).alias("a2"))


QUERIES = {f.__name__: f for f in (candidate_rows, candidate_harmony, candidate_intervals, candidate_bars, short_candidates, short_order_candidates, rederived, short_rederived, record_structure, jitter_stable, rendered_questions, short_questions, question_contract, short_contract, answer_text)}
_OUT = "select sample_id, fam, sub, params, akey, stratum, notes, gold from cd"
ORACLE = {
    "candidate_rows": candidates(0.5) + _OUT,
    "candidate_harmony": candidates(0.9) + _OUT + " where fam[1] in ('H', 'A')",
    "candidate_intervals": candidates(0.5) + _OUT + " where fam[1] = 'I'",
    "candidate_bars": candidates(0.5) + _OUT + " where fam[1] = 'B'",
    "short_order_candidates": PH + """, k as (select a.*, case when p2 > p1 then 'up' else 'down' end as w2, case when p1 > p0 then 'up' else 'down' end as w1 from pa a),
r as (select *, dense_rank() over (partition by rid, phrase order by pitch desc) as h, dense_rank() over (partition by rid, phrase order by pitch) as l from ph),
rn as (select rid, sample_id, phrase, unnest(['highest', 'lowest', 'second_highest', 'second_lowest']) as nm, unnest([string_agg(cast(k as varchar), ',' order by k) filter (where h = 1), string_agg(cast(k as varchar), ',' order by k) filter (where l = 1), string_agg(cast(k as varchar), ',' order by k) filter (where h = 2), string_agg(cast(k as varchar), ',' order by k) filter (where l = 2)]) as notes from r group by rid, sample_id, phrase having count(*) >= 2)
select sample_id, phrase, 'O-NOTE' as fam, 'idx=' || nm as sub, case when k_ < m then nm else nm || '_empty' end as akey, case when k_ < m then cast(k_ as varchar) else '' end as notes from (select *, unnest(['first', 'second', 'third', 'last']) as nm, unnest([0, 1, 2, m - 1]) as k_ from pa)
union all select sample_id, phrase, 'R-PITCH', 'rank=' || nm, case when notes is null then nm || '_empty' else nm end, coalesce(notes, '') from rn
union all select sample_id, phrase, 'P-CONTOUR', 'pitch=' || nm, case when nm = w1 || '-' || w2 then nm else nm || '_empty' end, case when nm = w1 || '-' || w2 then '0,1,2' else '' end from (select *, unnest(['up-up', 'up-down', 'down-up', 'down-down']) as nm from k where m = 3 and p0 <> p1 and p1 <> p2)""",
    "answer_text": GRID_SQL + ", z as (select sample_id, count(*) filter (where abs(mv) = 4) as k from c left join (select rid, mv from n) n using (rid) group by rid, sample_id) select sample_id, cast(k as varchar) as a0, k || case when k = 1 then ' move' else ' moves' end as a1, 'The answer is ' || k || case when k = 1 then ' move.' else ' moves.' end as a2 from z",
}

_DRAWN = "list_transform(list_sort(list_transform({x}, lambda p: struct_pack(h := md5(concat_ws('|', 'short', sample_id, phrase, p)), p := p))), lambda z: z.p)"
_IN = "array_to_string(list_transform(list_filter(range(len(ps)), lambda k: list_contains({x}, ps[k + 1])), lambda k: cast(k as varchar)), ',')"
ORACLE["short_candidates"] = ORACLE["short_order_candidates"].replace("select sample_id, phrase, 'O-NOTE' as fam, 'idx=' || nm as sub, case", "select sample_id, phrase, 'O-NOTE' as fam, 'idx=' || nm as sub, '' as params, case").replace("'rank=' || nm, case", "'rank=' || nm, '', case").replace("'pitch=' || nm, case", "'pitch=' || nm, '', case").replace("rn as (select", f"""h0 as (select rid, sample_id, phrase, list(pitch order by k) as ps, list_sort(list(distinct pitch)) as have from ph group by rid, sample_id, phrase),
h1 as (select *, {_DRAWN.format(x="have")} as ho, {_DRAWN.format(x="list_filter(range(21, 109), lambda v: not list_contains(have, v))")} as ab from h0),
sets as (select sample_id, phrase, ps, unnest(list_concat(list_transform(have, lambda p: [p]), case when len(have) >= 2 then [ho[1:2]] else [] end, case when len(have) >= 3 then [have] else [] end, list_transform(ab[1:3], lambda p: [p]), [[ho[1], ab[1]], ab[1:2], list_append(ho[1:2], ab[2])])) as st from h1),
g0 as (select a.rid, a.sample_id, a.phrase, list(abs(a.pitch - b.pitch)) as gaps from ph a join ph b on a.rid = b.rid and a.phrase = b.phrase and a.k < b.k group by a.rid, a.sample_id, a.phrase),
g1 as (select *, list_concat(list_filter(list_distinct(gaps), lambda x: x between 1 and 24 and len(list_filter(gaps, lambda y: y = x)) = 1), {_DRAWN.format(x="list_filter(range(1, 25), lambda v: not list_contains(gaps, v))")}[1:3]) as wanted from g0),
dl as (select rid, sample_id, phrase, cast(unnest(wanted) as integer) as x from g1),
di as (select dl.rid, dl.sample_id, dl.phrase, dl.x, count(a.k) as pairs, coalesce(any_value(a.k || ',' || b.k), '') as notes from dl left join ph a on a.rid = dl.rid and a.phrase = dl.phrase left join ph b on b.rid = a.rid and b.phrase = a.phrase and a.k < b.k and abs(a.pitch - b.pitch) = dl.x where b.k is not null or a.k = 0 group by dl.rid, dl.sample_id, dl.phrase, dl.x),
vr as (select *, row_number() over (partition by rid, phrase order by velocity desc) as h, lead(velocity) over (partition by rid, phrase order by velocity desc) as below, lag(velocity) over (partition by rid, phrase order by velocity desc) as above, count(*) over (partition by rid, phrase) as m from ph),
tr as (select *, case when m = 3 then case when abs(p2 - p1) - abs(p1 - p0) >= 2 then 'widen' when abs(p1 - p0) - abs(p2 - p1) >= 2 then 'narrow' when abs(p2 - p1) = abs(p1 - p0) then 'same' end end as trend,
  case when m = 3 then case when abs(p0 - p1) < least(abs(p0 - p2), abs(p1 - p2)) then '0,1' when abs(p0 - p2) < least(abs(p0 - p1), abs(p1 - p2)) then '0,2' when abs(p1 - p2) < least(abs(p0 - p1), abs(p0 - p2)) then '1,2' end end as near, case when m = 3 and abs(g0 - g1) >= 0.15 then case when g0 < g1 then '0,1' else '1,2' end end as soon from pa),
rn as (select""", 1) + f"""
union all select sample_id, phrase, 'A-PITCH', 'vals', 'vals=' || array_to_string(list_sort(st), ','), 'k' || len(st) || '_h' || len(list_filter(ps, lambda p: list_contains(st, p))), {_IN.format(x="st")} from sets
union all select sample_id, phrase, 'O-RANGE', nm, '', nm, case when nm = 'prefix' then '0,1' else (m - 2) || ',' || (m - 1) end from (select *, unnest(['prefix', 'suffix']) as nm from pa where m >= 2)
union all select sample_id, phrase, 'R-VEL', 'rank=loudest', '', 'loudest', cast(k as varchar) from vr where h = 1 and velocity - below >= 24
union all select sample_id, phrase, 'R-VEL', 'rank=softest', '', 'softest', cast(k as varchar) from vr where h = m and above - velocity >= 24
union all select sample_id, phrase, 'R-VEL', 'rank=second_loudest', '', 'second_loudest', cast(k as varchar) from vr where m = 3 and h = 2 and above - velocity >= 24 and velocity - below >= 24
union all select sample_id, phrase, 'P-PAIR', 'pitch_closest', '', 'pitch_closest', near from tr where near is not null
union all select sample_id, phrase, 'P-PAIR', 'time_closest', '', 'time_closest', soon from tr where soon is not null
union all select sample_id, phrase, 'P-PDIFF', 'delta', 'delta=' || x, 'd' || case when x <= 12 then cast(x as varchar) else '13-24' end || case when notes = '' then '_empty' else '' end, notes from di
union all select sample_id, phrase, 'P-INT', 'order=' || nm, '', case when nm = trend then nm else nm || '_empty' end, case when nm = trend then '0,1,2' else '' end from (select *, unnest(['widen', 'narrow', 'same']) as nm from tr where trend is not null)"""
ORACLE["rederived"] = candidates(0.5) + "select fam, 'equal' as status, count(*) as n from cd group by fam"
ORACLE["short_rederived"] = f"select fam, 'equal' as status, count(*) as n from ({ORACLE['short_candidates']}) group by fam"
ORACLE["record_structure"] = """with z as (select distinct item_id, array_to_string(list_filter([""" + ", ".join(f"case when {c} is null then 'missing:{c}' end" for c in ("question", "answer_text", "answer_spans", "answer_spans_sec", "query_key", "concept", "audio_path", "sample_id", "v2", "question_variants")) + """,
  case when evidence_type is not null and gold_answer is null then 'missing:gold_answer' end, case when len(answer_spans) <> len(answer_spans_sec) then 'frames:number' end,
  case when len(answer_spans) = len(answer_spans_sec) and list_transform(answer_spans, lambda x: x[1]) <> list_transform(answer_spans_sec, lambda x: cast(round_even(x[1] * 75, 0) as integer)) then 'frames:place' end], lambda v: v is not null), ',') as broken from qa_items)
select * from z where broken <> ''"""
ORACLE["question_contract"] = candidates(0.5) + "select fam, count(*) as n, 0::bigint as broken from cd group by fam"
ORACLE["short_contract"] = f"select fam, count(*) as n, 0::bigint as broken from ({ORACLE['short_candidates']}) group by fam"
