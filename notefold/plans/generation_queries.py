"""Generated, transposed and short clips, and files, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notefold.functions.ids import split_name, sql_split_name
from notefold.operators import excerpt as E
from notefold.operators import generation as N
from notefold.operators import structured as G
from notefold.operators.selection import dense_ids
from notefold.sources import files
from notefold.plans.excerpt_queries import RAW_SQL
from notefold.runtime import tables


def generated_clips(s, d):
    """As many new clips as there are rows of clips, analysed."""
    g = N.generate(s, tables(s, d)("clips").count())
    x = E.excerpts(g.withColumn("sample_id", F.format_string("gen_%06d", "n")).select("sample_id", "meter", "bpm", "music_start", "bar_dur", "relation", "valid", "notes"))
    return x.select("sample_id", "meter", "bpm", "relation", "valid", "usable", "n", F.size(E.in_bar(1)).alias("n1"))


def structured_clips(s, d):
    """As many structured clips as there are rows of clips, per structure, repetition and pattern."""
    g = G.generate(s, tables(s, d)("clips").count())
    return g.groupBy("structure", "repetition", "pattern").agg(F.count("*").alias("clips"), F.sum(F.size("notes")).alias("notes"), F.max("tries").alias("tries"))


def transposed_clips(s, d):
    """Clips made of a bar and its shifted copy, from the version of each clip that was added last."""
    c = tables(s, d)("clips")
    added = F.col("added_at") if "added_at" in c.columns else F.lit(0)  # rows added at the same time are told apart by their content
    last = c.groupBy("sample_id").agg(F.max_by(F.struct(*c.columns), F.struct(added, F.md5(F.to_json(F.struct(*c.columns))))).alias("c")).select("c.*")
    e = E.excerpts(E.as_clips(last)).withColumn("split", split_name(F.col("split"), F.col("sample_id")))
    t = N.transposed(e, {"train": 120, "val": 20, "test": 60})
    return t.select("sample_id", "split", "semitones", F.size("notes").alias("notes"), F.array_join(F.transform("notes", lambda x: x["pitch"].cast("string")), ",").alias("pitches"))


def short_generated(s, d):
    g = N.short_clips(s, tables(s, d)("clips").count())
    return g.select("n", F.size("notes").alias("notes"), F.array_join(F.transform("notes", lambda x: x["pitch"].cast("string")), ",").alias("pitches"), F.round(F.get("notes", F.size("notes") - 1)["end"], 6).alias("last_end"))


def short_dataset(s, d):
    """Short clips fitted to their length, per split and number of notes."""
    g = N.short_dataset(s, tables(s, d)("clips").count())
    return g.groupBy("split", F.size("notes").alias("notes")).agg(F.count("*").alias("clips"))


def metadata_table(s, d):
    c = tables(s, d)("clips").withColumn("split", split_name(F.col("split"), F.col("sample_id")))
    return files.metadata_table(c)


def quarantine(s, d):
    """Clips kept when those with a removal time are put aside."""
    c = tables(s, d)("clips")
    keep, _ = files.quarantined(c.select("sample_id"), c.where("removed_at is not null").select("sample_id"), "removed")
    return keep.distinct()


def modality_files(s, d):
    return files.modalities(tables(s, d)("clips").where("removed_at is not null").select("sample_id").distinct())


def content_digest(s, d):
    return files.content_digest(tables(s, d)("manifest").select("id", "source", "semitones")).select("rows")


def content_digest_whole(s, d):
    """Rows, sum and xor of the hashes of whole rows, so that tables of equal size and other content differ."""
    return files.content_digest(tables(s, d)("manifest"))


def concept_ids(s, d):
    """Concept tags of clips numbered in sorted order."""
    return dense_ids(tables(s, d)("clips").select(F.explode("concepts").alias("concept")), "concept", "concept_no")


def concept_pairs(s, d):
    """Tags as field and value, counted."""
    c = tables(s, d)("clips").select(F.explode("concepts").alias("tag"))
    return c.groupBy(F.split_part("tag", F.lit(":"), F.lit(1)).alias("field"), F.split_part("tag", F.lit(":"), F.lit(2)).alias("value")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (generated_clips, structured_clips, transposed_clips, short_generated, short_dataset, metadata_table, quarantine, modality_files, content_digest, content_digest_whole, concept_ids, concept_pairs)}
ORACLE = {
    "metadata_table": f"select sp || '/wav/' || sample_id || '.wav' as audio_path, sp || '/midi/' || sample_id || '.mid' as midi_path, sp || '/meta/' || sample_id || '.json' as json_path, coalesce(list_min(list_transform(notes, lambda x: x.start)), 0) as first_onset, coalesce(list_max(list_transform(notes, lambda x: x.\"end\")), 0) as last_offset, sp as split from (select *, {sql_split_name('split', 'sample_id')} as sp from clips)",
    "quarantine": "select distinct sample_id from clips where sample_id not in (select sample_id from clips where removed_at is not null)",
    "modality_files": "select sample_id, unnest(['wav', 'midi', 'meta']) as modality, unnest([split_part(sample_id, '_', 1) || '/wav/' || sample_id || '.wav', split_part(sample_id, '_', 1) || '/midi/' || sample_id || '.mid', split_part(sample_id, '_', 1) || '/meta/' || sample_id || '.json']) as file from (select distinct sample_id from clips where removed_at is not null)",
    "content_digest": "select count(*) as rows from manifest",
    "concept_ids": "select concept, row_number() over (order by concept) - 1 as concept_no from (select distinct unnest(concepts) as concept from clips)",
    "concept_pairs": "select split_part(tag, ':', 1) as field, split_part(tag, ':', 2) as value, count(*) as n from (select unnest(concepts) as tag from clips) group by all",
}

_H = "(cast('0x' || substr(md5('{seed}|{name}|' || {of}), 1, 8) as bigint) % {k})"
_LAST = RAW_SQL.replace("as bpb from clips)", "as bpb from (select * from clips qualify row_number() over (partition by sample_id order by added_at desc nulls last) = 1))")
ORACLE["transposed_clips"] = _LAST + f""", b as (select rid, any_value(sample_id) as sample_id, min(pitch) as lo, max(pitch) as hi, list(pitch order by i) as ps from n where bar = 1 group by rid),
w as (select b.sample_id, {sql_split_name('c.split', 'b.sample_id')} as split, ps, list_filter({N.SHIFTS}, lambda s: lo + s >= {N.PITCH_LOW} and hi + s <= {N.PITCH_HIGH}) as fits, {N.SHIFTS}[1 + {_H.format(seed=3, name='shift', of='b.sample_id', k=len(N.SHIFTS))}] as want from b join c using (rid)),
z as (select *, list_sort(list_transform(fits, lambda s: struct_pack(o := abs(s - want), s := s)))[1].s as semitones from w where len(fits) > 0),
r as (select *, row_number() over (partition by split order by md5('3|' || sample_id), sample_id) as k from z)
select sample_id, split, cast(semitones as integer) as semitones, cast(2 * len(ps) as integer) as notes, array_to_string(list_concat(ps, list_transform(ps, lambda p: p + semitones)), ',') as pitches from r where k <= case split when 'train' then 120 when 'val' then 20 when 'test' then 60 else 0 end"""
_D = lambda name, k: _H.format(seed=5, name=name, of="id", k=k)
_STEP = lambda i: f"case when {_D(f'way{i}', 2)} = 0 then 1 else -1 end * ({_D(f'step{i}', 12)} + 1)"
ORACLE["short_generated"] = f"""with t as (select id, id % 3 + 1 as m, {_D('pitch', 64)} + 33 as p0, {_STEP(1)} as s1, {_STEP(2)} as s2 from range(0, (select count(*) from clips)) r(id)),
u as (select *, [p0, p0 + s1, p0 + s1 + s2] as ps, [{', '.join(f"0.2::double + {k} * 0.9::double + {_D(f'gap{k}', 300)} / 1000.0::double + 0.2::double + {_D(f'len{k}', 300)} / 1000.0::double" for k in range(3))}] as ends from t)
select id as n, cast(m as integer) as notes, array_to_string(list_transform(ps[1:m], lambda p: greatest(21, least(108, p))), ',') as pitches, round(ends[m], 6) as last_end from u"""
ORACLE["short_dataset"] = """with t as (select id, cast(id % 3 + 1 as integer) as m, count(*) over () as n, row_number() over (order by md5('5|' || id), id) as rk from range(0, (select count(*) from clips)) r(id))
select case when rk <= floor(n * 0.7 + 1e-9) then 'train' when rk <= floor(n * 0.85 + 1e-9) then 'val' else 'test' end as split, m as notes, count(*) as clips from t group by all"""
