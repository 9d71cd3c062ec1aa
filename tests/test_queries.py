"""Every query of the core against its SQL, over the whole smallest tables."""

import os

import pytest

from notefold.plans import registry
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    compare(spark, FOLDER, QUERIES[name], ORACLE[name])


def _clips(spark):
    return spark.read.parquet(f"{FOLDER}/clips.parquet")


def _once(df, *keys):
    """No two rows with the same keys; the rows."""
    rows = df.collect()
    assert len({tuple(r[k] for k in keys) for r in rows}) == len(rows) > 0
    return rows


def _keys(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def _build(spark, df):
    rows = _once(df, "understanding", "concept", "family")
    assert all(0 < r.clips <= r["items"] and 0 <= r.empties <= 0.25 * r["items"] + 1 for r in rows if not r.understanding)


def _questions(spark, df, name):
    rows = df.collect()
    assert len(rows) == QUERIES[name](spark, FOLDER).count() and all("{" not in r.question and r.a0 and r.a1 and r.a2 for r in rows)
    assert all((r.box == "") == (r.a0 == "none") for r in rows if "-G" in r.fam)


#: what must hold of the queries no SQL stands for; their operators are tested on fixtures besides
HOLDS = {
    "content_digest_whole": lambda s, df: df.first().rows == s.read.parquet(f"{FOLDER}/manifest.parquet").count() and df.first().xor is not None,
    "family_trimmed": lambda s, df: {r.cand_id for r in _once(df, "cand_id")} < {r[0] for r in s.read.parquet(f"{FOLDER}/qa_items.parquet").select("item_id").collect()},
    "generated_clips": lambda s, df: len(_once(df, "sample_id")) == _clips(s).count() and df.where("not valid or n1 = 0").count() == 0,
    "structured_clips": lambda s, df: sum(r.clips for r in _once(df, "structure", "repetition", "pattern")) == _clips(s).count() and max(r.tries for r in df.collect()) < 50,
    "greedy_balanced_pick": lambda s, df: len(_once(df, "family", "clip")) > 50,
    "slot_picks": lambda s, df: len(_once(df, "cand_id")) >= len(_once(df.where("slot = 0"), "family", "clip")),
    "test_subset": lambda s, df: len(_once(df, "kind", "clip")) > 0,
    "jitter_stable": lambda s, df: 0 < df.count() and _keys(df, "sample_id", "fam", "sub", "akey", "notes") <= _keys(QUERIES["candidate_rows"](s, FOLDER), "sample_id", "fam", "sub", "akey", "notes"),
    "midi_round_trip_whole": lambda s, df: df.count() == _clips(s).count() and df.where("faithful").count() > 0.8 * df.count(),
    "rendered_questions": lambda s, df: _questions(s, df, "candidate_rows"),
    "short_questions": lambda s, df: _questions(s, df, "short_candidates"),
    "selection_build": _build,
    "text_baseline": lambda s, df: all(0 <= r.accuracy <= 1 and r.majority <= 1 for r in df.collect()),
    "rebuild_report": lambda s, df: all(r.wrong == 0 and r.broken == 0 and r.records >= r.clips > 0 for r in _once(df, "kind", "concept")),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_holds(spark, name):
    assert HOLDS[name](spark, QUERIES[name](spark, FOLDER)) in (True, None)


def test_entry_without_llm_names():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
