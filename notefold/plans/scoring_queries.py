"""Scores of the answers in qa_items: another style of the same answer stands for a prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from notefold.functions import spans as S
from notefold.operators import scoring as G
from notefold.runtime import tables


def _rows(spark, sf_dir):
    """Grounding items with a prediction: their text, that of the next item of the clip, or an abstention."""
    q = tables(spark, sf_dir)("qa_items").where("evidence_type is null")
    bit = F.pmod(F.col("item_id"), F.lit(4))
    pred = F.when(bit == 0, F.concat(F.col("answer_text"), F.lit(" From 0.50 seconds to 1.25 seconds"))).when(bit == 1, F.lit(" NONE.. ")).when(bit == 2, F.replace(F.col("answer_text"), F.lit("1."), F.lit("1.1"))).otherwise(F.col("answer_text"))
    return q.select("item_id", G.group_of(F.col("concept"), F.col("query_key")).alias("grp"), pred.alias("prediction"), S.from_pairs(F.col("answer_spans_sec")).alias("gold"))


_SQL = """with q as (select item_id, coalesce(nullif(concept, ''), nullif(split_part(query_key, '/', 2), ''), 'unknown') as grp, answer_spans_sec,
  case item_id % 4 when 0 then answer_text || ' From 0.50 seconds to 1.25 seconds' when 1 then ' NONE.. ' when 2 then replace(answer_text, '1.', '1.1') else answer_text end as prediction,
  row_number() over () as rid from qa_items where evidence_type is null),
ps as (select rid, unnest(range(len(a))) as k, unnest(a)::double as s, greatest(unnest(a)::double, unnest(b)::double) as e from (
  select rid, regexp_extract_all(coalesce(prediction, ''), '(?i)([0-9]*\\.?[0-9]+)\\s*second[s]?\\s*to\\s*([0-9]*\\.?[0-9]+)\\s*second[s]?', 1) as a, regexp_extract_all(coalesce(prediction, ''), '(?i)([0-9]*\\.?[0-9]+)\\s*second[s]?\\s*to\\s*([0-9]*\\.?[0-9]+)\\s*second[s]?', 2) as b from q)),
gs as (select rid, unnest(range(len(answer_spans_sec))) as k, unnest(answer_spans_sec) as x from q),
gg as (select rid, k, x[1] as s, x[2] as e from gs),
pr as (select p.rid, p.k as pi, g.k as gi, abs(p.s - g.s) as onset, abs(p.e - g.e) as offs, greatest(0, least(p.e, g.e) - greatest(p.s, g.s)) as ov, greatest(0, p.e - p.s + g.e - g.s - greatest(0, least(p.e, g.e) - greatest(p.s, g.s))) as un from ps p join gg g using (rid)),
iou as (select rid, pi, gi, onset, offs, case when un > 0 then ov / un else 0 end as v from pr),
st as (select rid, coalesce(trim(regexp_replace(lower(trim(regexp_replace(coalesce(prediction, ''), '\\s+', ' ', 'g'))), '\\.+$', '')), '') in ('none', 'there is no such note in this clip', 'no matching note was found in this clip', 'no time span') as abst from q)
"""
_MERGE = """, al as (select rid, 0 as side, s, e from ps union all select rid, 1, s, e from gg),
m1 as (select *, max(e) over (partition by rid, side order by s, e rows between unbounded preceding and 1 preceding) as before from al),
m2 as (select *, sum(case when s <= before then 0 else 1 end) over (partition by rid, side order by s, e rows unbounded preceding) as isle from m1),
mm as (select rid, side, min(s) as s, max(e) as e from m2 group by rid, side, isle),
mo as (select a.rid, sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) as inter from mm a join mm b on a.rid = b.rid and a.side = 0 and b.side = 1 group by a.rid),
mi as (select rid, coalesce(any_value(inter), 0) as inter, sum(e - s) - coalesce(any_value(inter), 0) as un from mm left join mo using (rid) group by rid)
"""
#: greedy matching in rounds: the best pair of what is left, until none reaches the threshold
_GREEDY = """, {n}(rid, used_p, used_g, step, pi, gi, onset, offs) as (
  select rid, []::bigint[], []::bigint[], 0, null::bigint, null::bigint, null::double, null::double from q
  union all
  select rid, list_append(used_p, b.pi), list_append(used_g, b.gi), step + 1, b.pi, b.gi, b.onset, b.offs from (
    select x.rid, x.used_p, x.used_g, x.step, arg_min(struct_pack(pi := i.pi, gi := i.gi, onset := i.onset, offs := i.offs), struct_pack(v := -i.v, pi := i.pi, gi := i.gi)) as b
    from {n} x join iou i on i.rid = x.rid and i.v >= {t} and not list_contains(x.used_p, i.pi) and not list_contains(x.used_g, i.gi) group by x.rid, x.used_p, x.used_g, x.step))
"""
_R = _SQL.replace("with q", "with recursive q", 1)


def span_parse(spark, sf_dir):
    r = _rows(spark, sf_dir).withColumn("p", S.parse_spans(F.col("prediction")))
    return r.select("item_id", F.size("p").alias("spans"), F.round(S.length(F.col("p")), 6).alias("seconds"), S.is_abstention(F.col("prediction")).alias("abstains"))


def merged_iou(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return r.select("item_id", F.round(S.merged_iou(S.parse_spans(F.col("prediction")), F.col("gold")), 6).alias("iou"), F.size(S.merged(F.col("gold"))).alias("parts"))


def greedy_match(spark, sf_dir):
    r = _rows(spark, sf_dir).withColumn("m", S.greedy_match(S.parse_spans(F.col("prediction")), F.col("gold"), 0.5))
    return r.select("item_id", F.array_join(F.transform("m", lambda x: F.concat_ws("-", x["pi"].cast("string"), x["gi"].cast("string"))), ",").alias("pairs"))


def grounding_scores(spark, sf_dir):
    s = G.grounding_scores(G.grounding_items(_rows(spark, sf_dir)))
    return s.select("grp", "n", "hits5", "hits7", *[F.round(c, 6).alias(c) for c in ("ifr", "merged_iou", "p5", "r5", "f5", "onset_ms5", "p7", "r7", "f7")])


def _judged(spark, sf_dir):
    q = tables(spark, sf_dir)("qa_items").where("evidence_type is not null")
    score = F.pmod(F.col("item_id"), F.lit(3))
    body = F.concat(F.lit('{"instruction_following_score": '), F.when(score == 2, "0").otherwise("1"), F.lit(', "accuracy_score": '), F.when(score == 0, "1.0").otherwise("0.0"), F.lit("}"))
    fence = lambda tag: F.concat(F.lit(f"So {{}}: ```{tag}\n"), body, F.lit("\n```"))
    kind = F.pmod(F.col("item_id"), F.lit(7))
    out = (
        F.when(kind == 0, fence("json")).when(kind == 1, F.lit("no idea {"))
        .when(kind == 2, F.concat(F.lit('{"accuracy_score": 1.0} then ```\n'), body, F.lit("\n```")))  # an object before a fence that is not tagged
        .when(kind == 3, F.concat(F.lit('{"accuracy_score": 1.0} then ```JSON '), body, F.lit("```"))).when(kind == 4, F.lit('{"confidence": 0.5, "note": "a } in text"}')).otherwise(F.concat(F.lit("Verdict: { oops "), body))
    )
    return G.verdicts(q.select("item_id", F.coalesce(F.lower(F.trim("concept")), F.lit("")).alias("concept"), F.col("answer_text").alias("prediction"), F.col("answer_texts.1").alias("reference"), out.alias("output")))


def ifr_accuracy(spark, sf_dir):
    return G.understanding_scores(_judged(spark, sf_dir)).select("concept", "n", F.round("ifr", 6).alias("ifr"), F.round("accuracy", 6).alias("accuracy"), "place")


def judge_json(spark, sf_dir):
    return _judged(spark, sf_dir).select("item_id", "verdict.instruction_following_score", "verdict.accuracy_score", "verdict.confidence", "verdict.error_reason")


# kind 0 tagged fence, 1 no object, 2 an object before an untagged fence, 3 an object before a tagged fence, 4 an object without scores, else an object behind an open brace
_JUDGED = """with j as (select item_id, coalesce(lower(trim(concept)), '') as concept, item_id % 7 as k, item_id % 3 as s, coalesce(answer_text, '') = coalesce(answer_texts['1'], '') as same from qa_items where evidence_type is not null),
v as (select item_id, concept, case k when 1 then same::int when 2 then null when 4 then null else case when s = 2 then 0 else 1 end end as f,
  case k when 1 then same::int when 2 then 1 when 4 then null else case when s = 0 then 1 else 0 end end as a, case k when 1 then same::int when 4 then 0.5 end as c,
  case when k = 1 then case when same then 'correct (fallback)' else 'Fallback to string match (incorrect)' end end as e from j)
"""
QUERIES = {"span_parse": span_parse, "merged_iou": merged_iou, "greedy_match": greedy_match, "grounding_scores": grounding_scores, "ifr_accuracy": ifr_accuracy, "judge_json": judge_json}
ORACLE = {
    "span_parse": _SQL + "select q.item_id, cast(count(ps.k) as integer) as spans, round(coalesce(sum(e - s), 0), 6) as seconds, any_value(abst) as abstains from q join st using (rid) left join ps using (rid) group by q.rid, q.item_id",
    "merged_iou": _SQL + _MERGE + "select item_id, round(case when un > 0 then inter / un else 0 end, 6) as iou, (select cast(count(*) as integer) from mm where mm.rid = q.rid and side = 1) as parts from q left join mi using (rid)",
    "greedy_match": _R + _GREEDY.format(n="m5", t=0.5) + "select item_id, coalesce(string_agg(m.pi || '-' || m.gi, ',' order by step) filter (where step > 0), '') as pairs from q join m5 m using (rid) group by q.rid, item_id",
    "grounding_scores": _R + _MERGE + _GREEDY.format(n="m5", t=0.5) + _GREEDY.format(n="m7", t=0.7) + """,
it as (select q.rid, grp, (select count(*) from ps where ps.rid = q.rid) as np, (select count(*) from gg where gg.rid = q.rid) as ng, abst, case when un > 0 then inter / un else 0 end as miou,
  (select count(*) from m5 where m5.rid = q.rid and step > 0) as h5, (select coalesce(sum(onset), 0) from m5 where m5.rid = q.rid and step > 0) as o5, (select count(*) from m7 where m7.rid = q.rid and step > 0) as h7 from q join st using (rid) left join mi using (rid)),
s as (select case when grouping(grp) = 1 then 'overall' else grp end as grp, count(*) as n, sum((np > 0 or abst)::int) / count(*) as ifr, sum(miou) / count(*) as miou, cast(sum(h5) as bigint) as h5, cast(sum(h7) as bigint) as h7, sum(np) as np, sum(ng) as ng, sum(o5) as o5 from it group by grouping sets ((), (grp))),
z as (select *, case when np > 0 then h5 / np else 0 end as p5, case when ng > 0 then h5 / ng else 0 end as r5, case when np > 0 then h7 / np else 0 end as p7, case when ng > 0 then h7 / ng else 0 end as r7 from s)
select grp, n, h5 as hits5, h7 as hits7, round(ifr, 6) as ifr, round(miou, 6) as merged_iou, round(p5, 6) as p5, round(r5, 6) as r5, round(case when p5 + r5 > 0 then 2 * p5 * r5 / (p5 + r5) else 0 end, 6) as f5, round(case when h5 > 0 then o5 / h5 * 1000 else 0 end, 6) as onset_ms5, round(p7, 6) as p7, round(r7, 6) as r7, round(case when p7 + r7 > 0 then 2 * p7 * r7 / (p7 + r7) else 0 end, 6) as f7 from z""",
    "ifr_accuracy": _JUDGED + f"""select case when grouping(concept) = 1 then 'overall' else concept end as concept, count(*) as n, round(avg(coalesce(f = 1, false)::int), 6) as ifr, round(avg(coalesce(f = 1 and a = 1, false)::int), 6) as accuracy,
case when grouping(concept) = 1 then 0 else coalesce(nullif(list_position({G.CONCEPTS}, concept), 0), {len(G.CONCEPTS) + 1}) end::integer as place from v group by grouping sets ((), (concept))""",
    "judge_json": _JUDGED + "select item_id, f::double as instruction_following_score, a::double as accuracy_score, c::double as confidence, e as error_reason from v",
}
