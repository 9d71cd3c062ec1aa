"""Samples with target shares per category: systematic unequal-probability sampling with repaired floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions.ids import sql_stripped, stripped
from notefold.llm.terms import SQL_ITEMS, distinct_items, gold_category, sql_json_scalar, value_term
from notefold.runtime import cut, tables

SEED = 1


def categories(items: DataFrame) -> DataFrame:
    """``field_name, item_id, split, category`` for each field in which the item has one category."""
    split = F.lower(stripped(F.col("split")))
    fields = F.array(
        F.struct(F.lit("concept").alias("field_name"), value_term(F.col("concept")).alias("category")),
        F.struct(F.lit("query_key").alias("field_name"), value_term(F.col("query_key")).alias("category")),
        F.struct(F.lit("gold_answer").alias("field_name"), gold_category(F.col("gold_answer")).alias("category")),
    )
    return items.select("item_id", split.alias("split"), F.inline(fields)).where("split is not null and category is not null")


def targets(plans: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per plan and category in term form: ``want_milli`` is target_permille * sample_size, in
    thousandths of an item. Targets that name the same category add their shares and keep the
    larger floor; null numbers count as 0, blank categories and unknown plans are left out."""
    as_term = F.when(F.col("field_name") == "gold_answer", gold_category(F.col("category"))).otherwise(value_term(F.col("category")))
    p = plans.select("plan_id", F.lower(stripped(F.col("split"))).alias("split"), F.lower(stripped(F.col("field_name"))).alias("field_name"), "sample_size").distinct()
    w = wanted.select("plan_id", "category", "target_permille", "min_items").distinct()
    return (
        w.join(p, "plan_id").withColumn("category", as_term).where("category is not null")
        .groupBy("plan_id", "split", "field_name", "category")
        .agg((F.sum(F.coalesce("target_permille", F.lit(0)).cast("long")) * F.coalesce(F.first("sample_size"), F.lit(0))).alias("want_milli"), F.coalesce(F.max("min_items"), F.lit(0)).cast("long").alias("floor"))
    )


def available(cats: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals with the number of items there are; counts combine before the shuffle."""
    n = cats.groupBy("field_name", "split", "category").agg(F.count("*").alias("have"))
    need = F.greatest("floor", F.ceil(F.col("want_milli") / F.lit(1000).cast("decimal(10,0)")).cast("long"))
    return goals.join(n, ["field_name", "split", "category"], "left").withColumn("have", F.coalesce("have", F.lit(0))).withColumn("need", need)


def systematic_sample(cats: DataFrame, goals: DataFrame, seed: int = SEED, supply: DataFrame | None = None) -> DataFrame:
    """``plan_id, category, item_id, reason`` with ``reason`` ``crossing`` or ``floor``.

    Categories stand in sorted order, their items in a random order fixed by seed and item. Each
    item of a category with want w and n items has inclusion probability min(1, w/n); the running
    sum of these over the plan, plus one random start, selects an item where it passes an integer.
    Sums are exact integers in thousandths. The rank of an item is the number of items in lower
    buckets of its random key (12 bits of the md5 of seed, plan and item), from a prefix sum over at most
    4,096 pre-aggregated rows, plus its rank in the bucket: no task sees all items of a category. Categories drawn below their floor get
    their next items in random order until the floor or the last item is reached, beyond the
    sample size if need be. An item may belong to several plans. ``supply`` is :func:`available` of the goals, where it is known already."""
    g = available(cats, goals) if supply is None else supply
    plan = Window.partitionBy("plan_id").orderBy("category").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("mass", F.least("want_milli", F.col("have") * 1000)).withColumn("base", F.coalesce(F.sum("mass").over(plan), F.lit(0)))
    g = cut(g.withColumn("start", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("plan_id").cast("string"))), 1, 8), 16, 10).cast("long") % 1000))  # a row per target
    # 60 bits of the md5 as a number: it travels in 8 bytes, and its first 12 bits are the bucket
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("plan_id").cast("string"), F.col("item_id").cast("string"))), 1, 15), 16, 10).cast("long")
    # targets are as many as the plans name, not as the data hold: a bound proven by their table
    small = g.count() <= 100_000
    side = F.broadcast(g) if small else g
    items = cats.join(side, ["field_name", "split", "category"]).select("plan_id", "category", "item_id", key.alias("rnd"))
    items = items.withColumn("bucket", F.shiftright("rnd", 48).cast("int"))
    per = items.groupBy("plan_id", "category", "bucket").agg(F.count("*").alias("n"))
    low = per.withColumn("low", F.coalesce(F.sum("n").over(Window.partitionBy("plan_id", "category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = Window.partitionBy("plan_id", "category", "bucket").orderBy("rnd", "item_id")
    ranked = items.withColumn("r", F.row_number().over(here)).drop("rnd").join(low, ["plan_id", "category", "bucket"]).withColumn("rank", F.col("low") + F.col("r"))
    ranked = ranked.join(side.select("plan_id", "category", "have", "mass", "base", "start", "floor"), ["plan_id", "category"])
    edge = lambda rank: F.expr(f"cast(((cast(start + base as decimal(18,0)) * have + cast(mass as decimal(18,0)) * ({rank})) div (cast(have as decimal(18,0)) * 1000)) as long)")
    ranked = ranked.withColumn("upto", edge("rank") - edge("0")).withColumn("crossing", edge("rank") > edge("rank - 1"))
    # the selected of a category are known from its borders; the floor is filled by the first unselected ones
    total = edge("have") - edge("0")
    lack = F.greatest(F.lit(0), F.least("floor", "have") - total)
    reason = F.when(F.col("crossing"), "crossing").when((F.col("rank") - F.col("upto")) <= lack, "floor")
    return ranked.withColumn("reason", reason).where("reason is not null").select("plan_id", "category", "item_id", "reason")


def drawn_goals(cats: DataFrame, goals: DataFrame) -> DataFrame:
    """:func:`available` goals with ``drawn``, the number of items the sample draws for them."""
    supply = cut(available(cats, goals))  # a row per target
    drawn = systematic_sample(cats, goals, SEED, supply).groupBy("plan_id", "category").agg(F.count("*").alias("drawn"))
    return supply.join(drawn, ["plan_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))


def short_of(cats: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals the sample draws too few items for; a draw below the need by its fraction only is told apart by the exact count."""
    return drawn_goals(cats, goals).where("drawn < need and have < need")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tables(spark, sf_dir)
    items = distinct_items(t("qa_items"), "split", "concept", "query_key", "gold_answer")
    return cut(categories(items)), targets(t("sample_plans"), t("sample_targets"))  # counted, drawn from and ranked: written once


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_of(*_inputs(spark, sf_dir)).select("plan_id", "category").distinct()


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic_sample(*_inputs(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, floor, supply and draw of every category of every plan."""
    d = drawn_goals(*_inputs(spark, sf_dir))
    return d.select("plan_id", "category", "want_milli", F.col("floor").alias("min_items"), "have", "drawn", (F.col("have") >= F.col("need")).alias("can_be_met"))


_CAT = f"""{SQL_ITEMS},
cat as (
  select 'concept' as field_name, item_id, lower({sql_stripped('split')}) as split, {sql_stripped('lower(concept)')} as category from items
  union all select 'query_key', item_id, lower({sql_stripped('split')}), {sql_stripped('lower(query_key)')} from items
  union all select 'gold_answer', item_id, lower({sql_stripped('split')}), {sql_json_scalar('gold_answer')} from items where coalesce(try(json_type(gold_answer)), '') <> 'ARRAY')"""
_TERM = f"case when p.field_name = 'gold_answer' then {sql_json_scalar('category')} else {sql_stripped('lower(category)')} end"
_DRAW = f"""with {_CAT},
want as (
  select plan_id, p.split, p.field_name, {_TERM} as category, sum(coalesce(target_permille, 0)) * any_value(coalesce(sample_size, 0)) as milli, coalesce(max(min_items), 0) as floor_
  from (select distinct plan_id, category, target_permille, min_items from sample_targets) join sample_plans p using (plan_id) group by all),
goal as (select w.*, (select count(*) from cat c where c.field_name = w.field_name and c.split = w.split and c.category = w.category) as have from want w where w.category is not null),
mass as (
  select *, least(milli, have * 1000) as mass, coalesce(sum(least(milli, have * 1000)) over (partition by plan_id order by category rows between unbounded preceding and 1 preceding), 0)
    + cast('0x' || substr(md5('{SEED}|' || plan_id), 1, 8) as bigint) % 1000 as base from goal),
rank as (
  select m.*, item_id, row_number() over (partition by plan_id, m.category order by md5('{SEED}|' || plan_id || '|' || item_id), item_id) as r
  from mass m join cat c on c.field_name = m.field_name and c.split = m.split and c.category = m.category),
edge as (select *, (base * have + mass * r) // (have * 1000) as here, (base * have + mass * (r - 1)) // (have * 1000) as prev, (base * have) // (have * 1000) as zero, (base * have + mass * have) // (have * 1000) as last_ from rank),
drawn as (
  select plan_id, category, item_id, case when here > prev then 'crossing' when r - (here - zero) <= least(floor_, have) - (last_ - zero) then 'floor' end as reason from edge)
"""
ORACLE = {
    "p6_found": f"""with {_CAT},
goal as (
  select plan_id, p.split, p.field_name, {_TERM} as category, greatest(coalesce(min_items, 0), cast(ceil(cast(coalesce(target_permille, 0) * sample_size as decimal(18, 0)) / 1000) as bigint)) as need
  from sample_targets join sample_plans p using (plan_id))
select distinct g.plan_id, g.category from goal g
where g.category is not null and need > (select count(*) from cat c where c.field_name = g.field_name and c.split = g.split and c.category = g.category)""",
    "p6_sample": _DRAW + "select plan_id, category, item_id, reason from drawn where reason is not null",
    "p6_report": _DRAW + """select plan_id, category, cast(milli as bigint) as want_milli, cast(floor_ as bigint) as min_items, have, (select count(*) from drawn d where d.plan_id = g.plan_id and d.category = g.category and reason is not null) as drawn,
  have >= greatest(floor_, cast(ceil(cast(milli as decimal(18, 0)) / 1000) as bigint)) as can_be_met from goal g""",
}
QUERIES = {"p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report}
