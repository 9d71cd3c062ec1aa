"""Selection over qa_items: families, answer classes and strata as delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.operators import excerpt as E
from notefold.operators import selection as S
from notefold.plans.excerpt_queries import RAW_SQL
from notefold.runtime import tables


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item, in the form selections take; items with null keys are left out."""
    q = tables(spark, sf_dir)("qa_items")
    d = q.select("item_id", F.col("v2.family").alias("family"), F.col("v2.answer_class").alias("akey"), F.col("v2.sub").alias("stratum"), F.col("sample_id").alias("clip"), "split",
                 (F.coalesce(F.col("gold_answer_type"), F.lit("")) == "boolean").alias("boolean"), (F.size("answer_spans") == 0).alias("empty"), F.col("evidence_type").isNotNull().alias("understanding"), (F.lower(F.regexp_replace("gold_answer", r'[^A-Za-z]', "")) == "true").alias("yes"), "query_key", F.lower(F.trim("concept")).alias("concept"))
    return d.distinct()


_IT = """it as (select distinct item_id, v2.family as family, v2.answer_class as akey, v2.sub as stratum, sample_id as clip, split, coalesce(gold_answer_type, '') = 'boolean' as boolean, coalesce(len(answer_spans) = 0, false) as empty, evidence_type is not null as understanding, lower(regexp_replace(gold_answer, '[^A-Za-z]', '', 'g')) = 'true' as yes, query_key, lower(trim(concept)) as concept from qa_items)"""


def _rank_sql(src: str, group: str, keys: str, seed: str) -> str:
    parts = ", ".join(f"coalesce(cast({k} as varchar), '')" for k in keys.split(", "))
    part = f"partition by {group} " if group else ""
    return f"(select *, row_number() over ({part}order by md5(concat_ws('|', '{seed}', {parts})), {keys}) as rk from {src})"


def waterfill_caps(spark, sf_dir):
    n = items(spark, sf_dir).where("understanding and family is not null").groupBy("family", "akey").agg(F.count("*").alias("n"), F.bool_and("boolean").alias("boolean"))
    k = n.groupBy("family").agg(F.count("*").alias("k"), F.bool_and("boolean").alias("b"))
    n = n.join(k, "family").withColumn("share", S.share_limit(F.col("k"), F.col("b"), F.lit(False)))
    return S.waterfill_cap(n, ["family"]).join(k, "family").select("family", "cap", F.col("k").alias("classes"))


_CAPS = f"""{_IT}, cn as (select family, akey, count(*) as n, bool_and(boolean) as b from it where understanding and family is not null group by all),
sh as (select family, count(*) as k, max(n) as hi, case when bool_and(b) then 0.55 else greatest(0.35, 1.5 / count(*)) end as share from cn group by family),
ok as (select family, c, any_value(share) as share, sum(least(n, c)) as tot from cn join sh using (family), lateral (select unnest(range(1, hi + 1)) as c) group by family, c)
"""


def waterfill_allocs(spark, sf_dir):
    n = items(spark, sf_dir).where("family is not null and concept is not null").groupBy("concept", "family").agg(F.count("*").alias("cap"))
    return S.waterfill_alloc(n.withColumn("total", F.lit(300).cast("long")), ["concept"], "family").select("concept", "family", "cap", "alloc")


def largest_remainder(spark, sf_dir):
    n = items(spark, sf_dir).where("family is not null").groupBy("family", "stratum", "akey").agg(F.count("*").alias("n")).withColumn("target", F.lit(40).cast("long"))
    return S.largest_remainder(n, ["family"], ["stratum", "akey"]).select("family", "stratum", "akey", "n", "quota")


_LR = f"""{_IT}, ce as (select family, stratum, akey, count(*) as n from it where family is not null group by all),
lr as (select *, sum(n) over w as total, least(40, sum(n) over w) as aim from ce window w as (partition by family)),
l2 as (select *, n * aim // total as base, (n * aim) % total as frac from lr),
l3 as (select *, row_number() over (partition by family order by frac desc, stratum nulls first, akey nulls first) as place, aim - sum(base) over (partition by family) as rest from l2),
quota as (select family, stratum, akey, n, cast(base + case when place <= rest then 1 else 0 end as bigint) as quota from l3)
"""


def stratified_sample(spark, sf_dir):
    rows = items(spark, sf_dir).where("family is not null").select("item_id", "family", "stratum", "akey")
    return S.proportional_subsample(rows, ["family"], ["stratum", "akey"], ["item_id"], 40, "quota")


def hash_split(spark, sf_dir):
    rows = tables(spark, sf_dir)("clips").select("sample_id").distinct()
    return S.exact_split(rows, ["sample_id"], {"train": 0.7, "val": 0.15, "test": 0.15}, 11)


def strata_trimmed(spark, sf_dir):
    rows = items(spark, sf_dir).where("understanding and family is not null and stratum is not null and akey is not null").select("item_id", "family", "stratum", "akey", "boolean")
    b = rows.groupBy("family").agg(F.bool_and("boolean").alias("boolean"))
    return S.strata_trim(rows.drop("boolean").join(b, "family"), ["item_id"], 5).select("item_id", "family", "stratum", "akey")


def empties_capped(spark, sf_dir):
    rows = items(spark, sf_dir).where("not understanding and family is not null").select("item_id", "family", "empty")
    return S.empties_capped(rows, ["family"], ["item_id"], 3).select("item_id", "family", "empty")


def yesno_capped(spark, sf_dir):
    """Yes/no items of a concept within a tenth of what the concept then has; all of them where they are."""
    rows = items(spark, sf_dir).where("understanding and concept is not null")
    return S.yesno_trim(rows, ["item_id"], 9).where("boolean").select("item_id", "concept", "yes")


def vocab_ids(spark, sf_dir):
    """Query keys numbered in sorted order."""
    return S.dense_ids(tables(spark, sf_dir)("qa_items"), "query_key", "query_no")


def slot_items(spark, sf_dir):
    return S.slots(items(spark, sf_dir).where("family is not null and clip is not null"), ["item_id"], 2).select("item_id", "family", "clip", "slot")


def even_notes(spark, sf_dir):
    d = E.clip_excerpts(spark, sf_dir)
    return d.select("sample_id", E.text(S.evenly(F.transform("ev", lambda x: x["i"]), 5)).alias("notes"))


def greedy_balanced_pick(spark, sf_dir):
    d = items(spark, sf_dir).where("family is not null").select("family", "clip", "akey", "stratum", "empty", F.col("item_id").alias("cand_id"))
    return S.greedy_balanced_pick(d, 7)


def test_subset(spark, sf_dir):
    """One item per clip and kind of the test split, concepts, families and classes evenly."""
    d = items(spark, sf_dir).where("split = 'test' and clip is not null and family is not null and concept is not null")
    return S.evaluation_subset(d.select(F.when(F.col("understanding"), "understanding").otherwise("grounding").alias("kind"), "clip", "concept", "family", "akey", "boolean", F.col("item_id").alias("cand_id")), 8)


def slot_picks(spark, sf_dir):
    """Up to three items of a clip and family, each slot balanced over what the ones before left."""
    d = items(spark, sf_dir).where("family is not null and clip is not null").select("family", "clip", "akey", "stratum", "empty", F.col("item_id").alias("cand_id"))
    return S.slot_picks(d, 7)


def _choice(spark, sf_dir):
    return items(spark, sf_dir).where("family is not null and clip is not null and concept is not null").select("family", "concept", "understanding", "clip", "akey", "stratum", "empty", "boolean", "yes", F.col("item_id").alias("cand_id"))


def family_trimmed(spark, sf_dir):
    """Items within the share rules of strata and families, which alternate until nothing changes."""
    d = _choice(spark, sf_dir)
    of = d.groupBy("family").agg(F.bool_and("boolean").alias("boolean"), F.bool_and("understanding").alias("understanding"))
    d = d.drop("boolean", "understanding").join(of, "family").withColumn("stratum", F.coalesce("stratum", F.lit("")))
    return S.family_trim(d, ["cand_id"], 5).select("cand_id", "family", "stratum", "akey")


def selection_build(spark, sf_dir):
    """The whole selection, reported per kind, concept and family."""
    d = S.build(_choice(spark, sf_dir), ["cand_id"], 11, family_cap=400, concept_cap=500)
    return d.groupBy("understanding", "concept", "family").agg(F.count("*").alias("items"), F.count_distinct("clip").alias("clips"), F.count_if("empty").alias("empties"))


def _kinds(spark, sf_dir):
    it = items(spark, sf_dir).where("family is not null and concept is not null")
    return it.join(it.groupBy("family").agg(F.bool_and("boolean").alias("yesno")), "family")


def concept_quota(spark, sf_dir):
    """Every concept of a kind gets the capacity of the scarcest, its yes/no families a tenth of that; families share by waterfill."""
    return S.concept_quota(_kinds(spark, sf_dir)).select("understanding", "concept", "family", "yesno", "cap", "target", "alloc")


def concept_quota_soft(spark, sf_dir):
    """As ``concept_quota``, with at most 100 items a concept instead of the scarcest."""
    return S.concept_quota(_kinds(spark, sf_dir), 100).select("understanding", "concept", "family", "yesno", "cap", "target", "alloc")


def concept_thinned(spark, sf_dir):
    """The items that stay when every family is thinned to its quota, each stratum and class by its share."""
    it = _kinds(spark, sf_dir)
    q = S.concept_quota(it).groupBy("understanding", "concept", "family").agg(F.sum("alloc").alias("target"))
    return S.thinned(it, ["understanding", "concept", "family"], ["stratum", "akey"], ["item_id"], q, "thin").select("item_id", "understanding", "concept", "family", "stratum", "akey")


_ALLOC = """, lv as (select {g}, max(l) as level from (select {g}, l, sum(least(cap, l)) as used, any_value(total) as total from nn, lateral (select unnest(range(0, 1 + greatest(0, least((select max(cap) from nn), total)))) as l) group by {g}, l) where used <= total group by {g}),
ba as (select nn.*, least(cap, level) as base from nn join lv using ({g})),
re as (select *, total - sum(base) over (partition by {g}) as rest, row_number() over (partition by {g} order by cap - least(cap, base) desc, family) as place from ba)
"""
QUERIES = {f.__name__: f for f in (waterfill_caps, waterfill_allocs, largest_remainder, stratified_sample, hash_split, strata_trimmed, empties_capped, yesno_capped, concept_quota_soft, concept_thinned, vocab_ids, slot_items, even_notes, greedy_balanced_pick, slot_picks, family_trimmed, selection_build, test_subset, concept_quota)}
_SLOT = "case family when 'H-G2' then 3 when 'H-U1' then 2 when 'A-G1' then 2 when 'A-G2' then 2 when 'A-U1' then 2 when 'A-U2' then 2 else 1 end"
ORACLE = {
    "waterfill_caps": f"with {_CAPS} select family, cast(greatest(1, coalesce(max(c) filter (where c <= share * tot + 1e-9), 1)) as bigint) as cap, (select k from sh where sh.family = ok.family) as classes from ok group by family",
    "waterfill_allocs": f"with {_IT}, nn as (select concept, family, count(*) as cap, 300 as total from it where family is not null and concept is not null group by all)" + _ALLOC.format(g="concept") + "select concept, family, cap, cast(base + case when cap > base and place <= rest then 1 else 0 end as bigint) as alloc from re",
    "largest_remainder": f"with {_LR} select * from quota",
    "stratified_sample": f"with {_LR} select r.item_id, r.family, r.stratum, r.akey from {_rank_sql('(select * from it where family is not null)', 'family, stratum, akey', 'item_id', 'quota')} r join quota q on r.family = q.family and r.stratum is not distinct from q.stratum and r.akey is not distinct from q.akey where rk <= quota",
    "hash_split": f"with c as (select distinct sample_id from clips), r as (select *, count(*) over () as n from {_rank_sql('c', '', 'sample_id', '11')}) select sample_id, case when rk <= floor(n * 0.7 + 1e-9) then 'train' when rk <= floor(n * 0.85 + 1e-9) then 'val' else 'test' end as new_split from r",
    "strata_trimmed": f"""with {_IT}, u as (select * exclude (boolean), bool_and(boolean) over (partition by family) as boolean from it where understanding and family is not null and stratum is not null and akey is not null),
n0 as (select family, stratum, akey, any_value(boolean) as boolean, count(*) as n from u group by family, stratum, akey),
n1 as (select * from (select *, greatest(2, 0.05 * sum(n) over (partition by family, stratum)) as least_ from n0) where n >= least_),
n2 as (select *, case when boolean then 0.55 when k >= 3 then 1.1 / k else greatest(0.35, 1.5 / k) end as share from (select *, count(*) over (partition by family, stratum) as k from n1) where k >= 2),
ok as (select family, stratum, c, any_value(share) as share, sum(least(n, c)) as tot from n2, lateral (select unnest(range(1, 1 + (select max(n) from n2))) as c) group by family, stratum, c),
hi as (select family, stratum, max(n) as hi from n2 group by all),
cp as (select family, stratum, greatest(1, coalesce(max(c) filter (where c <= share * tot + 1e-9 and c <= hi), 1)) as cap from ok join hi using (family, stratum) group by family, stratum)
select r.item_id, r.family, r.stratum, r.akey from {_rank_sql('u', 'family, stratum, akey', 'item_id', '5')} r join n2 using (family, stratum, akey) join cp using (family, stratum) where rk <= cap""",
    "empties_capped": f"with {_IT}, u as (select item_id, family, empty from it where not understanding and family is not null), f as (select family, floor(count(*) * 0.2 / (1 - 0.2) + 1e-9) as cap from u where not empty group by family) select item_id, family, empty from u where not empty union all select r.item_id, r.family, r.empty from {_rank_sql('(select * from u where empty)', 'family', 'item_id', '3')} r join f using (family) where rk <= cap",
    "yesno_capped": f"""with {_IT}, u as (select * from it where understanding and concept is not null),
o as (select concept, cast(floor(count(*) filter (where not boolean) * 0.1::double / (1 - 0.1::double)) as bigint) as lim, count(*) filter (where boolean and coalesce(yes, false)) as t, count(*) filter (where boolean and not coalesce(yes, false)) as f from u group by concept),
k as (select *, least(t, lim - least(f, lim - least(t, lim // 2))) as nt, least(f, lim - least(t, lim // 2)) as nf from o)
select r.item_id, r.concept, r.yes from {_rank_sql('(select item_id, concept, coalesce(yes, false) as yes from u where boolean)', 'concept, yes', 'item_id', '9')} r join k using (concept) where t + f <= lim or rk <= case when yes then nt else nf end""",
    "vocab_ids": "select query_key, row_number() over (order by query_key) - 1 as query_no from (select distinct query_key from qa_items where query_key is not null)",
    "slot_items": f"with {_IT} select item_id, family, clip, rk as slot from {_rank_sql('(select * from it where family is not null and clip is not null)', 'family, clip', 'item_id', '2')} where rk <= {_SLOT}",
    "even_notes": RAW_SQL + ", z as (select rid, list(i order by i) as v from n group by rid) select sample_id, case when len(v) <= 5 then list_aggregate(list_transform(v, lambda x: cast(x as varchar)), 'string_agg', ',') else list_aggregate(list_transform(range(5), lambda k: cast(v[1 + k * (len(v) - 1) // 4] as varchar)), 'string_agg', ',') end as notes from c join z using (rid)",
}

_NN = """ky as (select *, bool_and(boolean) over (partition by family) as yesno from it where family is not null and concept is not null),
n0 as (select understanding, concept, family, any_value(yesno) as yesno, count(*) as cap from ky group by understanding, concept, family),
cp as (select understanding, concept, coalesce(sum(cap) filter (where not yesno), 0) as n, coalesce(sum(cap) filter (where yesno), 0) as b from n0 group by all),
c2 as (select *, case when understanding then n + least(b, n // 9) else n end as room from cp),
c3 as (select *, cast({target} as bigint) as target from c2),
nn as (select n0.*, target, cast(case when yesno then least(b, floor(target * 0.1::double)) else target - least(b, floor(target * 0.1::double)) end as bigint) as total from n0 join c3 using (understanding, concept))"""
_QUOTA = "with " + _IT + ", " + _NN + _ALLOC.format(g="understanding, concept, yesno") + ", al as (select understanding, concept, family, yesno, cap, cast(target as bigint) as target, cast(base + case when cap > base and place <= rest then 1 else 0 end as bigint) as alloc from re)"
ORACLE["concept_quota"] = _QUOTA.replace("{target}", "min(room) over (partition by understanding)") + " select * from al"
ORACLE["concept_quota_soft"] = _QUOTA.replace("{target}", "least(room, 100)") + " select * from al"
ORACLE["concept_thinned"] = _QUOTA.replace("{target}", "min(room) over (partition by understanding)") + f""", ce as (select understanding, concept, family, stratum, akey, count(*) as n from ky group by all),
lr as (select ce.*, sum(n) over w as total, least(alloc, sum(n) over w) as aim from ce join al using (understanding, concept, family) window w as (partition by understanding, concept, family)),
l2 as (select *, n * aim // total as base, (n * aim) % total as frac from lr),
l3 as (select *, base + case when row_number() over (partition by understanding, concept, family order by frac desc, stratum nulls first, akey nulls first) <= aim - sum(base) over (partition by understanding, concept, family) then 1 else 0 end as quota from l2)
select r.item_id, r.understanding, r.concept, r.family, r.stratum, r.akey from {_rank_sql('ky', 'understanding, concept, family, stratum, akey', 'item_id', 'thin')} r
join l3 q on r.understanding = q.understanding and r.concept = q.concept and r.family = q.family and r.stratum is not distinct from q.stratum and r.akey is not distinct from q.akey where rk <= quota"""
