"""The rebuild works in passes that need little disk, with the same result as at once."""

import os
import random

from pyspark.sql import functions as F

from notefold import runtime
from notefold.operators import candidates as C
from notefold.operators import excerpt as E
from notefold.operators import selection as S
from notefold.operators import structured as G
from notefold.plans import rebuild_queries as P


def _clips(spark, n):
    g = G.generate(spark, n).withColumn("sample_id", F.format_string("new_%09d", "n")).withColumn("split", F.lit("train"))
    return g.select("sample_id", "split", "notes", "meter", "bpm", "music_start", "bar_dur").localCheckpoint()


def test_no_candidate_is_written_with_its_clip(spark, monkeypatch):
    """What is written in a rebuild has a row per clip with its notes, or narrow rows of candidates; and the records are stable candidates as they were asked for."""
    seen, write = [], runtime.cut

    def told(df, *a, **k):
        seen.append(set(df.columns))
        return write(df, *a, **k)

    for m in (P, S):
        monkeypatch.setattr(m, "cut", told)
    clips = _clips(spark, 40)
    found = P.build_records(clips, family_cap=30, concept_cap=40)
    records = found[0] if isinstance(found, tuple) else found
    got = {(r.sample_id, r.fam, r.sub, r.params, tuple(r.idx), r.gold) for r in records.select("sample_id", "fam", "sub", "params", "idx", "gold").collect()}
    assert len(got) == records.count() > 300 and not [c for c in seen if "ev" in c and "fam" in c]
    every = {(r.sample_id, r.fam, r.sub, r.params, tuple(r.idx or ()), r.gold) for r in C.candidates(E.excerpts(clips).where("usable")).collect()}
    assert got <= every


def test_stable_candidates_tell_what_the_choice_needs(spark):
    """``empty``, yes/no families and the first of each class, against the candidates with their notes."""
    clips = _clips(spark, 40)
    own = C.stable(clips, fields=("sample_id", "fam", "sub", "params", "akey", "stratum", "empty", "fresh")).localCheckpoint()
    want = {(r.sample_id, r.fam, r.sub, r.params): (r.akey, r.stratum, not r.idx, r.gtype == "boolean") for r in C.candidates(E.excerpts(clips).where("usable")).collect()}
    rows = own.collect()
    assert len(rows) == len({tuple(r)[:4] for r in rows}) > 1000
    assert all((r.akey, r.stratum, r.empty, r.fam in C.BOOLEAN) == want[tuple(r)[:4]] for r in rows)
    assert own.where("fresh").count() == own.select("sample_id", "fam", "akey", "stratum", "empty").distinct().count()


def test_passes_choose_as_at_once(spark):
    rng = random.Random(12)
    rows = []
    for fam, concept, kind, boolean in (("u1", "a", True, False), ("u2", "a", True, True), ("H-U1", "b", True, False), ("g1", "a", False, False), ("H-G2", "b", False, False)):
        for i in range(400):
            cls = rng.choice(["true", "false"]) if boolean else rng.choice("pqqrrrr")
            rows.append((fam, concept, kind, f"c{rng.randrange(150)}", cls, rng.choice(["", "s"]), not kind and rng.random() < 0.4, boolean, cls == "true", f"{fam}-{i}"))
    seen: set = set()
    rows = [(*r, not (r[:1] + r[3:7] in seen or seen.add(r[:1] + r[3:7]))) for r in rows]
    d = spark.createDataFrame(rows, "family string, concept string, understanding boolean, clip string, akey string, stratum string, empty boolean, boolean boolean, yes boolean, cand_id string, fresh boolean")
    slots = lambda d: sorted((r.family, r.slot, r.cand_id) for r in d.collect())
    parts = S.slot_picks_in_passes(d, 3, 150)
    assert len(parts) >= 8 and sorted(x for _, t in parts for x in slots(t)) == slots(S.slot_picks(d, 3))
    cut_up = S.slot_picks_in_passes(d, 3, 60, block=50)  # blocks of a family in several passes
    assert len({x[2] for _, t in cut_up for x in slots(t)}) == sum(t.count() for _, t in cut_up) and sum("g1" in f for f, _ in cut_up) > 3
    whole = lambda most: sorted(r.cand_id for r in S.build(d, ["cand_id"], 3, family_cap=60, most=most).collect())
    assert whole(None) == whole(300) != []


def test_shares_hold_all_blocks_once():
    sizes = [("a", 10, 1), ("b", 100, 10), ("c", 0, 1), ("d", 35, 4), ("e", 500, 1)]
    shares = S._shares(sizes, 40)
    blocks = sorted((f, k) for share in shares for f, lo, hi in share for k in range(lo, hi))
    assert blocks == sorted((f, k) for f, _, n in sizes for k in range(n))
    each = {f: max(1, n // b) for f, n, b in sizes}
    assert all(sum((hi - lo) * each[f] for f, lo, hi in share) <= 40 or len(share) == 1 for share in shares)


def test_only_what_is_given_stays(spark):
    out = runtime.alone(lambda: runtime.cut(runtime.cut(spark.range(5)).where("id > 1")))
    first = []
    runtime.alone(lambda: first.append(runtime.cut(spark.range(5))) or 1)
    assert out.count() == 3 and os.path.isdir(out._notefold_path.removeprefix("file://").removeprefix("file:"))
    assert not os.path.exists(first[0]._notefold_path.removeprefix("file://").removeprefix("file:"))


def test_second_derivation_in_parts(spark):
    assert P.different(_clips(spark, 6), most=4) == 0
