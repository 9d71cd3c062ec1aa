"""Splits that keep related records together: hash-to-min components, weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions.ids import clip_id, split_name, sql_clip_id, sql_split_name
from notefold.runtime import cut, discard, heaviest, tables

HOT_MEMBERS = 100_000
PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _print() -> list:
    """Order-free fingerprint of the clusters: rows, sum and xor of row hashes."""
    h = F.xxhash64("node", "member")
    return [F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("xor")]


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, hot: int = HOT_MEMBERS) -> DataFrame:
    """``node, component`` of every id in ``edges`` (and ``nodes``); the component is its smallest id.

    Hash-to-min: each node keeps a cluster, at first itself and its neighbours; in a round it sends
    its cluster to the smallest member and that member to all others, until no cluster changes.
    Clusters are kept in long form ``(node, member)``, one row each, so none is ever gathered in a
    task. Minima are taken by aggregates that combine before the shuffle; nodes with more than
    ``hot`` members, of which there can be at most 1,024 counted here, get their minimum by a
    broadcast of those few rows, so that a cluster with a third of all rows is not joined in one
    task. Every round is written to the shared folder, which ends the lineage.

    Edges with a null end count as nodes alone; repeated edges and edges to oneself change nothing;
    empty input gives no rows."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = pairs.where("x is not null and y is not null")
    ids = pairs.select("x").union(pairs.select("y"))
    if nodes is not None:
        ids = ids.union(nodes.select(F.col(nodes.columns[0])))
    ids = ids.where("x is not null").select(F.col("x").alias("node"), F.col("x").alias("member"))
    state, seen = cut(ids.union(both.toDF("node", "member")).union(both.select("y", "x").toDF("node", "member")).distinct(), _print())
    while True:
        least, most = cut(state.groupBy("node").agg(F.min("member").alias("least"), F.count("*").alias("n")), [F.max("n").alias("n")])
        if (most["n"] or 0) < hot:
            known = state.join(least.drop("n"), "node")
        else:
            many = F.broadcast(heaviest(least, least=hot).drop("n"))
            cold = state.join(many.select("node"), "node", "left_anti").join(least.drop("n"), "node")
            known = state.join(many, "node").unionByName(cold)
        sent = F.array(F.struct(F.col("least").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))
        new, now = cut(known.select(F.inline(sent)).distinct(), _print())
        discard(state)
        discard(least)
        state = new
        if now == seen:
            return state.groupBy("node").agg(F.min("member").alias("component"))
        seen = now


def rendezvous_split(key, proportions: dict[str, float] = PROPORTIONS, seed: str = "split"):
    """The split with the highest weighted rendezvous score -w/ln(u) of the key.

    ``u`` in (0,1) is drawn from 52 bits of the md5 of seed, split and key. Changing one proportion
    moves only keys to or from that split. A null key has no split."""
    scores = []
    for name, weight in sorted(proportions.items()):
        if weight <= 0:
            continue
        u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(name).alias("name")))
    return F.when(key.isNotNull(), F.greatest(*scores)["name"] if len(scores) > 1 else scores[0]["name"])


def families(clips: DataFrame) -> DataFrame:
    """``family_id, sample_id, split`` of every clip; the family id is the smallest sample_id with a row."""
    c = clips.select("sample_id", clip_id(F.col("sample_id")).alias("id"), clip_id(F.col("source_sample_id")).alias("src"), split_name(F.col("split"), F.col("sample_id")).alias("split")).where("id is not null")
    comp = components(c.select("id", "src").distinct(), "id", "src")
    rows = cut(c.select("sample_id", "id", "split").distinct().join(comp, F.col("id") == F.col("node")).select("component", "sample_id", "split"))
    name = rows.groupBy("component").agg(F.min("sample_id").alias("family_id"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    return _by_component(rows, name)


def _by_component(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with the facts of their component; components with very many rows by a broadcast of at most 1,024."""
    hot = F.broadcast(heaviest(rows.groupBy("component").count().withColumnRenamed("count", "n"), least=HOT_MEMBERS).select("component"))
    few = facts.join(hot, "component", "left_semi").limit(1024)
    return rows.join(F.broadcast(few), "component").unionByName(rows.join(hot, "component", "left_anti").join(facts, "component"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = families(tables(spark, sf_dir)("clips"))
    return f.where("lo <> hi").select("family_id", "sample_id").distinct()


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip with its family and the split assigned to the family."""
    f = families(tables(spark, sf_dir)("clips"))
    return f.select("sample_id", "family_id", rendezvous_split(F.col("family_id")).alias("new_split")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and families per assigned split, the share of clips it got and the share it was to get: a very large
    family moves its split off the target, as it is never cut."""
    s = p1_splits(spark, sf_dir).groupBy("family_id", "new_split").agg(F.count("*").alias("clips"))
    g = s.groupBy("new_split").agg(F.sum("clips").alias("clips"), F.count("*").alias("families"), F.max("clips").alias("largest_family"))
    want = F.create_map(*[F.lit(x) for kv in PROPORTIONS.items() for x in kv])
    total = F.sum("clips").over(Window.partitionBy(F.lit(0)))  # over a row per split
    return g.select("new_split", "clips", "families", "largest_family", F.round(F.col("clips") / total, 6).alias("share"), F.try_element_at(want, F.col("new_split")).alias("target"))


_FAMILIES_SQL = f"""
with recursive c as (
  select distinct sample_id, {sql_clip_id('sample_id')} as id, {sql_clip_id('source_sample_id')} as src, {sql_split_name('split', 'sample_id')} as sp from clips),
e as (select id as x, src as y from c where src is not null union select src, id from c where src is not null),
reach(x, y) as (select id, id from c union select r.x, e.y from reach r join e on r.y = e.x),
fam as (
  select r.x, min(o.sample_id) as family_id, count(distinct o.sp) as splits from reach r join c o on o.id = r.y group by r.x)
"""
QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_report": p1_report}
_U = "(cast('0x' || substr(md5('split|{name}|' || family_id), 1, 13) as bigint) + 0.5::double) / 4503599627370496"
_SPLIT_SQL = ", sp as (select distinct sample_id, family_id from fam join c on c.id = fam.x), sc as (select sample_id, family_id, unnest([" + ", ".join(f"struct_pack(score := -{w}::double / ln({_U.format(name=n)}), name := '{n}')" for n, w in sorted(PROPORTIONS.items())) + "]) as s from sp), won as (select sample_id, family_id, max(s).name as new_split from sc group by all)"
ORACLE = {
    "p1_splits": _FAMILIES_SQL + _SPLIT_SQL + " select sample_id, family_id, new_split from won",
    "p1_report": _FAMILIES_SQL + _SPLIT_SQL + f""", fs as (select family_id, new_split, count(*) as k from won group by all)
select new_split, cast(sum(k) as bigint) as clips, count(*) as families, max(k) as largest_family, round(sum(k) / (select count(*) from won), 6) as share, case new_split {' '.join(f"when '{n}' then {w}::double" for n, w in PROPORTIONS.items())} end as target from fs group by new_split""",
    "p1_found": _FAMILIES_SQL + "select distinct family_id, sample_id from fam join c on c.id = fam.x where splits > 1",
}
