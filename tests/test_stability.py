"""Stability under jitter against a comparison draw by draw."""

import random

from pyspark.sql import functions as F

from notefold.operators import candidates as C
from notefold.operators import excerpt as E

CLIPS = "sample_id string, split string, notes array<struct<start:double,end:double,pitch:int,velocity:int>>, meter string, bpm int, music_start double, bar_dur double"
SAME = ["fam", "sub", "params", "akey", "idx", "gold"]


def _clips(spark):
    """Two bars of quarter notes in 4/4 at 120 bpm, in a third of the clips some of them a few milliseconds from the limit of 0.18 beats, one clip in two versions."""
    r = random.Random(4)
    data = []
    for k in range(12):
        at = [0.5 * i + (r.choice((0.0, 0.085, 0.088, 0.09)) if i % 4 and k % 3 == 0 else 0.0) for i in range(8)]
        ends = [*at[1:], 4.0]
        notes = [(s, e, p, 80) for s, e, p in zip(at, ends, r.choice(([60, 64, 67, 60, 62, 65, 69, 62], [60, 62, 64, 65, 67, 60, 60, 72])))]
        data.append((f"c{k // 2 if k < 2 else k}", "train", notes, "4/4", 120, 0.0, 2.0))
    return spark.createDataFrame([*data, data[0]], CLIPS)


def _table(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.sample_id, set()).add(tuple(str(r[c]) for c in SAME))
    return out


def _brute(clips, draws):
    """Rows by clip, each draw on its own; ``clips`` have one row a clip."""
    exs = E.excerpts(C.jittered(clips, draws)).withColumn("sample_id", F.concat_ws("#", "sample_id", F.col("draw").cast("string")))
    tables = _table(C.candidates(exs, cover=0.5))
    value = F.transform("ev", lambda x: F.concat_ws("=", x["i"].cast("string"), E.value_name(x["value"])))
    values = {r.sample_id: r.v for r in exs.where(F.expr(f"{E.ON_GRID} and values_ok") & E.tempo_consistent()).select("sample_id", value.alias("v")).collect()}
    want = []
    for r in C.candidates(E.excerpts(clips), cover=0.5).collect():
        k, copies = tuple(str(r[c]) for c in SAME), [f"{r.sample_id}#{n}" for n in range(1, draws + 1)]
        if all(f"{r.idx[0]}={r.gold}" in values.get(c, ()) if r.fam == "R-U3" else k in tables.get(c, ()) for c in copies):
            want.append((r.sample_id, *k))
    return sorted(want)


def test_stable_is_what_every_draw_gives(spark):
    clips = _clips(spark)
    mine = sorted((r.sample_id, *(str(r[c]) for c in SAME)) for r in C.stable(clips, cover=0.5).collect())
    single = clips.where("sample_id <> 'c0'")
    assert [x for x in mine if x[0] != "c0"] == _brute(single, 10)
    assert {"R-G2", "R-U3", "T-G1", "I-G1", "B-U1", "Rp-U2"} <= {x[1] for x in mine}
    assert sum(x[0] != "c0" for x in mine) < C.candidates(E.excerpts(single), cover=0.5).count()
    assert sum(x[:3] == ("c0", "T-U3", "distinct_names") for x in mine) == 2  # both versions, the repeated row once


def test_jitter_makes_no_overlap(spark):
    ev = C.jittered(_clips(spark)).select("notes").collect()
    assert all(a.end <= b.start for r in ev for a, b in zip(r.notes, r.notes[1:])) and all(n.end - n.start >= 0.05 - 1e-9 for r in ev for n in r.notes)


def test_query_has_every_family(spark):
    from notefold.plans import registry

    d = "/root/testdata/sf0.001"
    fams = {r.fam for r in registry.queries()["jitter_stable"](spark, d).select("fam").distinct().collect()}
    assert {"R-G2", "T-G1", "I-G1", "B-U1", "H-G2", "Rp-U2"} <= fams


def _odd_clips(spark):
    """Clips of the test tables, on the grid and as they are, and clips whose frame, tempo, meter or notes are missing or odd."""
    d = "/root/testdata/sf0.001"
    own = E.clip_rows(spark, d).dropDuplicates(["sample_id"])
    laid, real = E.quantised(own), own.withColumn("sample_id", F.concat_ws("", F.lit("real_"), "sample_id"))
    r, data = random.Random(9), []
    frames = [("3/4", 100, 0.4), ("6/8", 120, 0.0), ("2/4", 90, 0.5), ("4/4", 120, -0.3), ("5/4", 120, 0.0), (None, 120, 0.0), ("4/4", None, 0.0), ("4/4", 0, 0.0), ("4/4", 120, None)]
    beats = {"3/4": 3, "6/8": 6, "2/4": 2}
    for k in range(36):
        meter, bpm, at = frames[k % len(frames)]
        n, half = beats.get(meter, 4), 30 / (bpm or 120)
        bar = 2 * n * half
        places = sorted({0, 2 * n, *r.sample(range(4 * n), r.randint(2, 2 * n))})
        low = r.choice((60, 61, 67))
        pitch = [low + r.choice((0, 4, 7, 4, 12, 2)) for _ in places] if k % 2 else [low + (0, 4, 7, 4)[j % 4] for j in range(len(places))]
        notes = [((at or 0.0) + p * half + r.choice((0.0, 0.0, 0.09, 0.178 * 2 * half)) * (k % 3 == 1 and p % (2 * n) > 0), (at or 0.0) + q * half, x, 80) for p, q, x in zip(places, [*places[1:], 4 * n], pitch)]
        if k % 9 == 3:
            notes += [(notes[1][0] + 0.002, notes[1][1], 59, None), (None, 1.0, 60, 80), (0.1, 0.5, None, 80)]
        if k % 9 == 2:  # a note that ends before it begins
            notes[1] = (notes[1][0], notes[1][0] - 0.001, notes[1][2], 80)
        data.append((f"odd_{k}", "train", notes, meter, bpm, at, bar))
    data += [("none", "train", [], "4/4", 120, 0.0, 2.0), ("null", "train", None, "4/4", 120, 0.0, 2.0), ("one", "train", [(0.0, 2.0, 60, 80)], "4/4", 120, 0.0, 2.0)]
    return laid.unionByName(real).unionByName(spark.createDataFrame(data, CLIPS))


def test_stable_of_odd_clips_is_what_every_draw_gives(spark):
    clips = _odd_clips(spark).localCheckpoint()
    got = C.stable(clips, cover=0.5, draws=3).localCheckpoint()
    every = C.candidates(E.excerpts(clips), cover=0.5).select(*got.columns)
    assert got.exceptAll(every).count() == 0  # no field differs from what the expressions give
    mine = sorted((r.sample_id, *(str(r[c]) for c in SAME)) for r in got.collect())
    assert mine == _brute(clips, 3)
    families = {x[1] for x in mine}
    assert families == {r.fam for r in every.select("fam").distinct().collect()} and {"R-G5", "R-G6", "R-U4", "A-G2", "Rp-U1", "H-U2"} <= families
    assert {"real_", "odd_"} <= {x[0][: x[0].index("_") + 1] for x in mine if "_" in x[0]}


def test_one_generator_of_stable(spark):
    clips = _clips(spark)
    fams = lambda df: {r.fam for r in df.select("fam").distinct().collect()}
    for g in C.GENERATORS:
        assert fams(C.stable(clips, [g], cover=0.5, draws=2)) <= fams(C.candidates(E.excerpts(clips), [g], cover=0.5))
    assert fams(C.stable(clips, ["bars"])) == {"B-G1", "B-G2", "B-U1", "B-U2", "B-U3", "B-U4"}


def test_stable_shuffles_clips_only(spark):
    """Neither candidates nor their copies leave the row of their clip: one exchange, no join, nothing exploded."""
    plan = C.stable(_clips(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


def test_steady_clips_read_alike():
    """What is called steady, and so not drawn, reads alike however its notes move within the width, most of all by the whole of it; clips near a limit are not called so."""
    import numpy as np

    from notefold.operators import stability as S

    r, width = np.random.default_rng(3), 0.005
    rows, n = 6000, r.integers(3, 11, 6000)
    meter = r.choice(["4/4", "3/4", "2/4", "6/8"], rows)
    bpm, at = r.choice([70.0, 120.0, 200.0], rows), np.zeros(rows)
    bpb = np.array([S.M.BEATS_PER_BAR[m] for m in meter])
    half = 30 / bpm
    start, end = np.zeros((rows, 10)), np.zeros((rows, 10))
    for k in range(rows):
        places = np.sort(np.append(r.choice(np.arange(1, 4 * bpb[k]), min(n[k], 4 * bpb[k] - 1) - 1, replace=False), 0))
        n[k] = len(places)
        # off the grid by near a limit: of places, of the frame, of the line between the bars
        off = r.choice([0, 0, 0, 0.17 * 2 * half[k], 0.18 * 2 * half[k] + r.uniform(-0.02, 0.02), -0.1 + r.uniform(-0.02, 0.02), 0.16 + r.uniform(-0.02, 0.02)], n[k]) * (places > 0) * r.integers(0, 2)
        start[k, : n[k]] = np.sort(places * half[k] + off + r.normal(0, 0.002, n[k]) * r.integers(0, 2) + r.choice([0, 0.03, 0.09]) * r.integers(0, 2))
        end[k, : n[k]] = np.append(start[k, 1 : n[k]], 4 * bpb[k] * half[k]) - r.choice([0, 0.02, 0.055, 0.06 + r.uniform(-0.02, 0.02)], n[k])
    f = S.Frames(n, meter.astype(object), bpm, at, 2 * bpb * half)
    pitch = r.integers(60, 72, (rows, 10))
    base = S.reading(start, end, pitch, f, width)
    steady, inner, changed = base["steady"], np.arange(10) < n[:, None] - 1, np.zeros(rows, bool)
    for d in range(60):
        by = (lambda: r.choice([-width, width], (rows, 10))) if d % 2 else (lambda: r.uniform(-width, width, (rows, 10)))
        s = start + by()
        e = np.maximum(np.fmin(end + by(), np.where(inner, np.roll(s, -1, axis=1), np.nan)), s + 0.05)
        x = S.reading(*S._in_order(s, e, pitch.copy(), n), f)
        for k in S.READ:
            changed |= np.any(x[k] != base[k], axis=1) if x[k].ndim == 2 else x[k] != base[k]
    assert not (changed & steady).any()
    assert steady.sum() > 300 and changed.sum() > 300
    kinds = [base["tempo"], base["sync_ok"], base["frame_full"], ~base["on_grid"], base["longest"].max(axis=1) >= 0]
    assert all((steady & k).sum() > 20 for k in kinds)
