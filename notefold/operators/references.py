"""References to keys that are missing, gone or not there yet (orphan references)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions.ids import clip_id, path_key, sql_clip_id, sql_path_key
from notefold.runtime import heaviest, tables

SALT_ROWS = 50_000


def parent_keys(df: DataFrame, table: str, key, added, removed) -> DataFrame:
    """Long form of a parent table: +1 where a key begins to exist, -1 where it ends.

    Periods that are empty or begin at no known time hold nothing and are left out."""
    p = df.select(F.lit(table).alias("parent"), key.alias("key"), added.alias("a"), removed.alias("r"))
    p = p.where(F.col("key").isNotNull() & F.col("a").isNotNull() & (F.col("r").isNull() | (F.col("r") > F.col("a"))))
    steps = F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("r").alias("t"), F.lit(-1).alias("d")))
    return p.select("parent", "key", F.inline(steps)).where(F.col("t").isNotNull())


def child_keys(df: DataFrame, table: str, field: str, parent: str, key, ref_key, at) -> DataFrame:
    """Long form of a referring field; blank references and references without a time are none."""
    c = df.select(F.lit(parent).alias("parent"), key.alias("key"), at.alias("t"), F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), ref_key.cast("string").alias("ref_key"))
    return c.where(F.col("key").isNotNull() & F.col("t").isNotNull())


def flagged_references(parents: list[DataFrame], children: list[DataFrame]) -> DataFrame:
    """Every distinct reference with ``orphan``: no period of its key holds the time of the reference.

    Parent and child keys are united in tagged long form and grouped by (parent, key, day). The
    number of open periods at the start of a day is a prefix sum over the days of a key, taken from
    pre-aggregated counts, so no task ever sees all rows of a key; the fine order is needed only
    inside a day, and days of a key with many references are salted.

    Nulls and blanks in keys or times make no reference. Repeated rows count once. A reference at
    the very moment a key is added finds it, at the moment it is removed does not. Empty tables give
    an empty result; empty parents make every reference an orphan."""
    day = F.to_date("t").alias("day")
    steps = reduce(DataFrame.unionByName, parents).groupBy("parent", "key", "t").agg(F.sum("d").cast("long").alias("d")).select("*", day)
    refs = reduce(DataFrame.unionByName, children).distinct().select("*", day)
    per_day = (
        steps.select("parent", "key", "day", "d", F.lit(0).alias("n"))
        .unionByName(refs.select("parent", "key", "day", F.lit(0).cast("long").alias("d"), F.lit(1).alias("n")))
        .groupBy("parent", "key", "day").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    )
    before = Window.partitionBy("parent", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_day.select("parent", "key", "day", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d"), "n").where("n > 0").drop("n")
    hot = heaviest(per_day, least=SALT_ROWS).select("parent", "key", "day", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    null = F.lit(None).cast("string")
    sides = steps.select("parent", "key", "day", "t", "d").unionByName(opening.select("parent", "key", "day", F.lit(None).cast(steps.schema["t"].dataType).alias("t"), "d"))
    salts = F.coalesce("salts", F.lit(1))
    sides = sides.join(F.broadcast(hot), ["parent", "key", "day"], "left").select("parent", "key", "day", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "t", "d", F.lit(0).alias("tag"), null.alias("ref_table"), null.alias("ref_field"), null.alias("ref_key"))
    asks = refs.join(F.broadcast(hot), ["parent", "key", "day"], "left").select("parent", "key", "day", F.pmod(F.hash("ref_key"), salts).cast("int").alias("salt"), "t", F.lit(0).cast("long").alias("d"), F.lit(1).alias("tag"), "ref_table", "ref_field", "ref_key")
    order = Window.partitionBy("parent", "key", "day", "salt").orderBy(F.col("t").asc_nulls_first(), "tag").rowsBetween(Window.unboundedPreceding, 0)
    long = sides.unionByName(asks).withColumn("open", F.sum("d").over(order))
    return long.where("tag = 1").select("ref_table", "ref_field", "ref_key", "key", "t", F.date_format("t", "yyyy-MM").alias("period"), (F.col("open") <= 0).alias("orphan"))


def _project_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    clips, qa = t("clips"), t("qa_items")
    parents = [
        parent_keys(clips, "clips", clip_id(F.col("sample_id")), F.col("added_at"), F.col("removed_at")),
        parent_keys(t("audio_files"), "audio_files", path_key(F.col("audio_path")), F.col("added_at"), F.col("removed_at")),
    ]
    children = [
        child_keys(clips, "clips", "source_sample_id", "clips", clip_id(F.col("source_sample_id")), F.col("sample_id"), F.col("added_at")),
        child_keys(qa, "qa_items", "sample_id", "clips", clip_id(F.col("sample_id")), F.col("item_id"), F.col("created_at")),
        child_keys(qa, "qa_items", "audio_path", "audio_files", path_key(F.col("audio_path")), F.col("item_id"), F.col("created_at")),
    ]
    return flagged_references(parents, children)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project_references(spark, sf_dir).where("orphan").select("ref_table", "ref_field", "ref_key", "period").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans and all references per table, field and month."""
    r = _project_references(spark, sf_dir)
    return r.groupBy("ref_table", "ref_field", "period").agg(F.count_if("orphan").alias("orphans"), F.count("*").alias("refs"))


_REFS_SQL = f"""
with par as (
  select 'clips' as parent, {sql_clip_id('sample_id')} as k, added_at as a, removed_at as r from clips
  union all select 'audio_files', {sql_path_key('audio_path')}, added_at, removed_at from audio_files),
ref as (
  select 'clips' as ref_table, 'source_sample_id' as ref_field, 'clips' as parent, {sql_clip_id('source_sample_id')} as k, sample_id as ref_key, added_at as t from clips
  union select 'qa_items', 'sample_id', 'clips', {sql_clip_id('sample_id')}, cast(item_id as varchar), created_at from qa_items
  union select 'qa_items', 'audio_path', 'audio_files', {sql_path_key('audio_path')}, cast(item_id as varchar), created_at from qa_items),
flag as (
  select *, strftime(t, '%Y-%m') as period,
    not exists (select 1 from par where par.parent = ref.parent and par.k = ref.k and par.a <= ref.t and (par.r is null or ref.t < par.r)) as orphan
  from ref where k is not null and t is not null)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLE = {
    "p2_found": _REFS_SQL + "select distinct ref_table, ref_field, ref_key, period from flag where orphan",
    "p2_report": _REFS_SQL + "select ref_table, ref_field, period, count(*) filter (where orphan) as orphans, count(*) as refs from flag group by all",
}
