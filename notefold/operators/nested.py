"""Flat tables from deeply nested JSON records, by Dewey labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.ids import stripped
from notefold.functions.jsontext import parse
from notefold.runtime import cut, tables


@dataclass(frozen=True)
class Kind:
    """What a nested object of one kind holds: ``children`` maps a member to (kind, mark); ``values``
    names scalar members to keep, each with the path to it. A child may be one object or a list of
    them, and where ``text`` names it, JSON text of these."""

    children: dict[str, tuple[str, str]] = field(default_factory=dict)
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    text: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Grammar:
    """Kinds of objects, the kind at the top with its mark, and members that merely wrap it."""

    kinds: dict[str, Kind]
    top: str
    mark: str
    wrappers: tuple[str, ...] = ()


NODE = "node string, parent string, path string, kind string, pos int, vals map<string,string>"


def _plain(v) -> str | None:
    if v is None or isinstance(v, str):
        return v if v is None else v.encode("utf-8", "replace").decode()
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return "/".join(_plain(x) or "" for x in v if not isinstance(x, (list, dict)))
    if isinstance(v, dict):
        parts = [v["beats"], v["unit"]] if "beats" in v and "unit" in v else v.values()
        return "/".join(_plain(x) or "" for x in parts if not isinstance(x, (list, dict)))
    return str(v)


def _tops(value, wrappers) -> list:
    while isinstance(value, dict):
        inner = next((value[w] for w in wrappers if isinstance(value.get(w), (dict, list))), None)
        if inner is None:
            return [value]
        value = inner
    if not isinstance(value, list):
        return []
    return [next((x[w] for w in wrappers if isinstance(x, dict) and isinstance(x.get(w), dict)), x) for x in value]


def shred(text: str | None, g: Grammar) -> Iterator[tuple]:
    """Nodes of one record as (label, parent label, schema path, kind, position, values).

    A label is the parent's label, a dot, the mark of the member and the ordinal in its list:
    cutting the last part gives the parent. Uses a stack, so depth has no limit."""
    if text is None:
        return
    try:
        value = parse(text)
    except ValueError:
        return
    stack = [(x, g.top, f"{g.mark}{i}", None, g.top, i) for i, x in enumerate(_tops(value, g.wrappers)) if isinstance(x, dict)]
    while stack:
        obj, kind, label, parent, path, pos = stack.pop()
        spec = g.kinds[kind]
        vals = {}
        for name, way in spec.values.items():
            v = obj
            for w in way:
                v = v.get(w) if isinstance(v, dict) else None
            if v is not None:
                vals[name] = _plain(v)
        yield label, parent, path, kind, pos, vals
        for member, (child, mark) in spec.children.items():
            v = obj.get(member)
            if isinstance(v, str) and member in spec.text:
                try:
                    v = parse(v)
                except ValueError:
                    continue
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(x, dict):
                    stack.append((x, child, f"{label}.{mark}{i}", label, f"{path}.{member}", i))


def nodes(df: DataFrame, record: str, payload: str, grammar: Grammar) -> DataFrame:
    """All labelled nodes: ``record_id, version, node, parent, path, kind, pos, vals``.

    ``version`` is a hash of the payload, so deliveries of one record that differ stay apart, and
    equal ones are taken once. Null and broken payloads give no nodes, valid JSON without objects
    none either. Other columns, whatever their names, are not read."""
    src = df.select(F.col(record).alias("record_id"), F.xxhash64(payload).alias("version"), F.col(payload).alias("payload"))
    types = "record_id " + src.schema["record_id"].dataType.simpleString() + ", version long, " + NODE

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for rid, ver, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.extend((rid, ver, *n[:5], list(n[5].items())) for n in shred(text, grammar))
                if len(out) > 20_000:
                    yield batch(b, out)
                    out = []
            yield batch(b, out)

    def batch(b, out):
        cols = list(zip(*out)) or [()] * 8
        kinds = [b.schema.field(0).type, pa.int64(), *[pa.string()] * 4, pa.int32(), pa.map_(pa.string(), pa.string())]
        names = ["record_id", "version", "node", "parent", "path", "kind", "pos", "vals"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return src.mapInArrow(run, types)


def flat_table(all_nodes: DataFrame, kind: str, values: list[str], name: str | None = None) -> DataFrame:
    """The nodes of one kind as a table ``record_id, version, <kind>_id, parent_id, <kind>_pos, path, <values>``.

    The parent id is the own label without its last part."""
    n = name or kind
    return (
        all_nodes.where(F.col("kind") == kind)
        .select("record_id", "version", F.col("node").alias(f"{n}_id"), F.nullif(F.regexp_replace("node", r"\.?[^.]+$", ""), F.lit("")).alias("parent_id"), F.col("pos").alias(f"{n}_pos"), "path", *[F.col("vals")[v].alias(v) for v in values])
        .dropDuplicates(["record_id", "version", f"{n}_id"])
    )


METAS = Grammar(
    kinds={
        "meta": Kind({"construction": ("step", "s")}, {"sample_id": ("sample_id",), "split": ("split",), "filename": ("filename",), "time_signature": ("basic_info", "time_signature"), "tempo_bpm": ("basic_info", "tempo_bpm")}, frozenset({"construction"})),
        "step": Kind({"edits": ("edit", "e"), "source": ("meta", "m")}, {"kind": ("kind",), "semitones": ("semitones",), "source_bar": ("source_bar",)}),
        "edit": Kind({}, {"note_index": ("note_index",), "field": ("field",), "delta": ("delta",)}),
    },
    top="meta", mark="m", wrappers=("meta", "records"),
)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(tables(spark, sf_dir)("meta_raw"), "record_id", "payload", METAS)


def metas_table(all_nodes: DataFrame) -> DataFrame:
    t = flat_table(all_nodes, "meta", ["sample_id", "split", "filename", "time_signature", "tempo_bpm"])
    return t.withColumn("time_signature", F.coalesce(F.regexp_replace("time_signature", r"\s+", ""), F.lit("")))


def steps_table(all_nodes: DataFrame) -> DataFrame:
    """Steps with ``meta_pos`` of their record's meta and ``step_path``, both read off the label."""
    t = flat_table(all_nodes, "step", ["kind", "semitones", "source_bar"])
    return t.select(
        "*", F.regexp_extract("step_id", r"^m(\d+)", 1).cast("int").alias("meta_pos"),
        F.array_join(F.regexp_extract_all("step_id", F.lit(r"\.s(\d+)"), F.lit(1)), "/").alias("step_path"),
    ).withColumn("kind", F.coalesce(stripped(F.col("kind")), F.lit("")))


def edits_table(all_nodes: DataFrame) -> DataFrame:
    return flat_table(all_nodes, "edit", ["note_index", "field", "delta"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cut(_nodes(spark, sf_dir).select("record_id", "version", "node", "path", "kind", "pos", "vals"))  # payloads are parsed once for the three tables
    metas = metas_table(n).select("record_id", "version", F.col("meta_id").alias("parent_id"), "time_signature")
    edits = edits_table(n).select("record_id", "version", F.col("parent_id").alias("step_id"), "edit_pos")
    return (
        steps_table(n).join(metas, ["record_id", "version", "parent_id"])
        .join(edits, ["record_id", "version", "step_id"], "left")
        .select("record_id", "meta_pos", "step_path", F.coalesce("edit_pos", F.lit(-1)).alias("edit_pos"), "kind", "time_signature").distinct()
    )


def p3_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metas_table(_nodes(spark, sf_dir)).select("record_id", "meta_id", "parent_id", "meta_pos", "sample_id", "time_signature").distinct()


def p3_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_table(_nodes(spark, sf_dir)).select("record_id", "edit_id", "parent_id", "edit_pos", "note_index", "field", "delta").distinct()


QUERIES = {"p3_found": p3_found, "p3_metas": p3_metas, "p3_edits": p3_edits}
_LIST = "case json_type({x}) when 'ARRAY' then from_json({x}, '[\"json\"]') when 'OBJECT' then [{x}] else [] end"
_NESTED_SQL = f"""with recursive raw as (select distinct record_id, try(cast(payload as json)) as j from meta_raw where payload is not null),
un as (select record_id, case when json_type(j) = 'OBJECT' then coalesce(j->'meta', j->'records', j) else j end as j from raw where j is not null),
m(record_id, meta_pos, path, meta) as (
  select record_id, k, '', x from (select record_id, unnest({_LIST.format(x='j')}) as x, cast(unnest(range(len({_LIST.format(x='j')}))) as integer) as k from un) where json_type(x) = 'OBJECT'
  union all
  select record_id, meta_pos, path || i || '/', s->'source' from (
    select record_id, meta_pos, path, unnest(steps) as s, unnest(range(len(steps))) as i from (
      select record_id, meta_pos, path, {_LIST.format(x='c')} as steps from (select *, case when json_type(meta->'construction') = 'VARCHAR' then try(cast(meta->>'construction' as json)) else meta->'construction' end as c from m)))
  where json_type(s->'source') = 'OBJECT'),
st as (
  select record_id, meta_pos, path || i as step_path, s, ts from (
    select record_id, meta_pos, path, ts, unnest(steps) as s, unnest(range(len(steps))) as i from (
      select record_id, meta_pos, path, meta->'basic_info'->'time_signature' as ts, {_LIST.format(x='c')} as steps from (select *, case when json_type(meta->'construction') = 'VARCHAR' then try(cast(meta->>'construction' as json)) else meta->'construction' end as c from m))
  ) where json_type(s) = 'OBJECT'),
z as (select *, {_LIST.format(x="(s->'edits')")} as edits, coalesce(trim(s->>'kind'), '') as kind, coalesce(case json_type(ts) when 'VARCHAR' then replace(ts->>'$', ' ', '') when 'ARRAY' then (ts->>0) || '/' || (ts->>1) when 'OBJECT' then (ts->>'beats') || '/' || (ts->>'unit') end, '') as time_signature from st)
"""
_META_ID = "'m' || meta_pos || regexp_replace(path, '([0-9]+)/', '.s\\1.m0', 'g')"
_SIGNATURE = "coalesce(case json_type({x}) when 'VARCHAR' then regexp_replace({x}->>'$', '\\s+', '', 'g') when 'ARRAY' then ({x}->>0) || '/' || ({x}->>1) when 'OBJECT' then ({x}->>'beats') || '/' || ({x}->>'unit') end, '')"
ORACLE = {
    "p3_found": _NESTED_SQL + "select distinct record_id, meta_pos, step_path, cast(unnest(case when len(edits) = 0 then [-1] else range(len(edits)) end) as integer) as edit_pos, kind, time_signature from z",
    "p3_metas": _NESTED_SQL + f"""select distinct record_id, {_META_ID} as meta_id, nullif(regexp_replace({_META_ID}, '\\.?[^.]+$', ''), '') as parent_id, case when path = '' then meta_pos else 0 end as meta_pos,
  meta->>'sample_id' as sample_id, {_SIGNATURE.format(x="(meta->'basic_info'->'time_signature')")} as time_signature from m""",
    "p3_edits": _NESTED_SQL + """, ed as (select record_id, 'm' || meta_pos || regexp_replace(regexp_replace(step_path, '([0-9]+)$', '.s\\1'), '([0-9]+)/', '.s\\1.m0', 'g') as step_id, unnest(edits) as e, unnest(range(len(edits))) as i from z)
select distinct record_id, step_id || '.e' || i as edit_id, step_id as parent_id, cast(i as integer) as edit_pos, e->>'note_index' as note_index, e->>'field' as field, e->>'delta' as delta from ed where json_type(e) = 'OBJECT'""",
}
