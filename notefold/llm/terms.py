"""Terms of question-answer items as columns, shared by counting and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.ids import bound, plain_number, sql_plain_number, sql_stripped, stripped


def value_term(c: Column) -> Column:
    """A plain value as a term: trimmed, lower case, null when blank."""
    return stripped(F.lower(c))


def _json_term(text: Column) -> Column:
    return bound(value_term(text), plain_number)


def _is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def gold_terms(c: Column) -> Column:
    """The terms of JSON text: one of a scalar, those of the elements of a list; null and blank ones
    are left out. What isn't valid JSON counts as text."""
    text = lambda v: F.when(v.isNull(), c).otherwise(F.try_variant_get(v, "$", "string"))
    raw = bound(F.try_parse_json(c), lambda v: F.when(_is_list(v), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(text(v))))
    return F.filter(F.transform(raw, _json_term), lambda x: x.isNotNull())


def gold_category(c: Column) -> Column:
    """The term of a scalar; null for a list."""
    text = bound(F.try_parse_json(c), lambda v: F.when(v.isNull(), c).when(~_is_list(v), F.try_variant_get(v, "$", "string")))
    return _json_term(text)


FIELDS = ("gold_answer", "concept", "query_key")


def distinct_items(qa: DataFrame, *columns: str) -> DataFrame:
    """One row per item_id; of repeated deliveries that loaded last, equal ones in any order."""
    pick = F.max(F.struct(F.col("loaded_at"), *[F.col(c) for c in columns])).alias("last")
    return qa.where("item_id is not null").groupBy("item_id").agg(pick).select("item_id", *[F.col(f"last.{c}").alias(c) for c in columns])


def item_terms(items: DataFrame) -> DataFrame:
    """``field_name, first, term, times``: a row per item, field and different term; ``first`` marks one row per item and field."""
    one = lambda name: F.filter(F.array(value_term(F.col(name))), lambda x: x.isNotNull())
    terms = F.array(*[F.struct(F.lit(f).alias("field_name"), (gold_terms(F.col(f)) if f == "gold_answer" else one(f)).alias("terms")) for f in FIELDS])
    each = items.select(F.inline(terms)).where(F.size("terms") > 0)
    return each.select("field_name", "terms", F.posexplode(F.array_distinct("terms")).alias("pos", "term")).select(
        "field_name", (F.col("pos") == 0).cast("long").alias("first"), "term", F.size(F.filter("terms", lambda x: x == F.col("term"))).cast("long").alias("times")
    )


SQL_ITEMS = "items as (select * from (select *, row_number() over (partition by item_id order by loaded_at desc nulls last) as rn from qa_items where item_id is not null) where rn = 1)"


def sql_json_scalar(x: str) -> str:
    raw = f"case when json_valid({x}) then try(json_extract_string({x}, '$')) else {x} end"
    return sql_plain_number(f"({sql_stripped(f'lower({raw})')})")


SQL_TERMS = f"""
{SQL_ITEMS},
raw as (
  select 'concept' as field_name, item_id, {sql_stripped('lower(concept)')} as term from items
  union all select 'query_key', item_id, {sql_stripped('lower(query_key)')} from items
  union all select 'gold_answer', item_id, {sql_json_scalar('gold_answer')} from items where coalesce(try(json_type(gold_answer)), '') <> 'ARRAY'
  union all select 'gold_answer', item_id, {sql_plain_number(f"({sql_stripped('lower(x)')})")} from (select item_id, json_extract_string(j, '$') as x from (
    select item_id, unnest(try(from_json(gold_answer, '["json"]'))) as j from items where try(json_type(gold_answer)) = 'ARRAY'))),
term as (select * from raw where term is not null)
"""
