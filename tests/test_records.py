"""The checker and the text contract find what is wrong, not only what is right."""

import pytest
from pyspark.sql import functions as F

from notefold.operators import candidates as C
from notefold.operators import checking as K
from notefold.operators import excerpt as E
from notefold.operators import records as R

NOTE = "array<struct<start:double,end:double,pitch:int,velocity:int>>"


def _clip(pitches, meter="4/4", bpm=120, start=0.5, lengths=None):
    beat, at, out = 60 / bpm, 0.0, []
    for p, n in zip(pitches, lengths or [1.0] * len(pitches)):
        out.append((start + at * beat, start + (at + n) * beat - 0.02, p, 80))
        at += n
    return out


@pytest.fixture(scope="module")
def clips(spark):
    """Arpeggios, a legato line, a clip with a rest, one in 6/8 and one with the notes of bar 2 shifted."""
    rows = [
        ("arpeggio", _clip([60, 64, 67, 60, 62, 65, 69, 65]), "4/4", 120, 0.5, 2.0), ("shifted", _clip([60, 62, 64, 65, 67, 69, 71, 72]), "4/4", 120, 0.5, 2.0),
        ("long", _clip([60, 62, 64, 65, 67, 60], lengths=[2.0, 0.5, 1.5, 1.0, 1.0, 2.0]), "4/4", 120, 0.5, 2.0), ("compound", _clip([60] * 3 + [72] * 9, "6/8", 144), "6/8", 144, 0.5, 2.5),
        ("rest", [n for i, n in enumerate(_clip([60, 64, 67, 60, 62, 65, 69, 65])) if i != 2], "4/4", 120, 0.5, 2.0), ("none", None, "4/4", 120, 0.5, 2.0), ("no frame", _clip([60, 62, 64, 65]), None, None, None, None),
    ]
    return E.excerpts(spark.createDataFrame(rows, f"sample_id string, notes {NOTE}, meter string, bpm int, music_start double, bar_dur double").withColumn("split", F.lit("train")))


def test_both_derivations_agree(clips):
    n = {(r.fam, r.status): r.n for r in K.checked(clips).groupBy("fam", "status").agg(F.count("*").alias("n")).collect()}
    assert {s for _, s in n} == {"equal"} and {f for f, _ in n} >= {"R-G1", "R-G2", "R-G4", "R-G5", "R-G6", "R-U3", "R-U4", "R-U6", "T-U2", "I-G4", "B-G1", "B-U3", "H-G1", "H-U1", "A-G1", "A-U2", "Rp-G1", "Rp-U2"}


def test_wrong_answers_are_found(clips, monkeypatch):
    """Answers changed in the families are told by the other side."""
    moved = {
        "intervals": ("notes_reached_by", lambda lo, hi=None: E.indices(lambda x: F.abs(x["move"]) >= lo + 1)), "bars": ("last_notes_of_bars", lambda: F.array(F.lit(0), F.lit(1))),
        "tonality": ("played", lambda: F.array(F.lit(0))), "rhythm_grounding": ("notes_on_beat", lambda k: E.indices(lambda x: x["grid"] == k)), "repetition": ("bar_shift", lambda d: F.lit(5)),
    }
    for name, (function, wrong) in moved.items():
        with monkeypatch.context() as m:
            m.setattr(E, function, wrong)
            assert K.checked(clips, [name]).where("status = 'different'").count() > 0, name


def test_what_cannot_be_told_is_skipped():
    s = K.Sheet(_clip([60, 62, 64, 65, 67, 69]), "4/4", 120, 0.5, 2.0)
    assert K.expected(s, "Rp-U1", "transposition", "") is None and K.expected(s, "H-U2", "root_motion_up", "") is None and K.expected(s, "R-G4", "x", "value_beats=1.0") is None
    assert K.expected(s, "I-G4", "x", "semitones=2;direction=ascending") == ("notes", [1, 2, 4, 5]) and K.expected(s, "T-U4", "", "") == ("gold", ["C", "D", "E", "F", "G", "A"])


def test_short_clips(spark):
    v = [([(0.0, 0.2, 60, 100), (0.9, 1.1, 72, 60), (1.5, 1.7, 71, 90)],), ([(0.0, 0.2, 60, 100), (0.4, 0.6, 60, 100)],), ([(0.0, 0.2, 60, 50)],), ([(0.0, 0.2, 60, 50), (0.3, 0.4, 64, 100), (1.0, 1.2, 68, 75)],)]
    ph = spark.createDataFrame([(i, *x) for i, x in enumerate(v)], f"phrase int, v {NOTE}").withColumn("sample_id", F.lit("a"))
    got = {(r.fam, r.status) for r in K.checked_short(C.short_candidates(ph)).collect()}
    assert {s for _, s in got} == {"equal"} and {f for f, _ in got} == {"A-PITCH", "O-NOTE", "O-RANGE", "R-PITCH", "R-VEL", "P-PAIR", "P-PDIFF", "P-CONTOUR", "P-INT"}
    assert K.expected_short([60, 62], [80, 90], [0.1], "R-VEL", "rank=loudest", "") is None and K.expected_short([60, 62, 64], [1, 2, 3], [0.1, 0.2], "P-PAIR", "pitch_closest", "") is None


def _records(clips):
    return R.rendered(C.candidates(clips, also=("ev", "rest_free", "frame_full")))


def test_contract_holds_and_every_rule_can_break(clips):
    d = _records(clips).cache()
    assert [r.b for r in d.select(R.broken_contract().alias("b")).where("size(b) > 0").collect()] == []
    none = F.array().cast("array<string>")
    cases = {
        "R-G2": [("question", F.lit("Beat it."), {"meter_missing", "tempo_missing", "beat_missing", "first_beat_missing", "unit_wrong"}), ("context", none, {"tempo_needed", "tempo_not_flagged"})],
        "T-G1": [("question", F.lit("Which?"), {"set_missing"})], "I-U1": [("question", F.lit("Which 12 semitones?"), {"semitones_missing"})],
        "I-G4": [("question", F.concat("question", F.lit(" ascending or falling")), {"direction_wrong"})], "I-G7": [("question", F.lit("Which?"), {"direction_missing"})],
        "R-G4": [("question", F.concat(F.lit("In 4/4 at 120 from the first beat (one beat is a quarter note)"), F.lit("")), {"value_missing"}), ("rest_free", F.lit(False), {"length_with_rests"})],
        "R-U4": [("question", F.lit("4/4 120 first beat quarter note)"), {"reference_missing"}), ("idx", F.array(F.lit(0), F.lit(1)), {"reference_ambiguous"})],
        "R-U3": [("question", F.regexp_replace("question", r"[0-9]+\.[0-9]{2}", "9.99"), {"time_wrong"}), ("ev", F.transform("ev", lambda x: x.withField("start", F.lit(1.0))), {"time_ambiguous"})],
        "B-G1": [("question", F.lit("Where, at 1.25 s?"), {"frame_missing", "time_in_bar_question"}), ("frame_full", F.lit(False), {"frame_not_true"})], "H-U2": [("question", F.lit("equally long"), {"pitch_class_missing"})],
        "R-G5": [("question", F.lit("4/4 120 first beat quarter note)"), {"weights_missing"})], "B-U1": [("question", F.concat("question", F.lit(" up to the start of the next note")), {"note_length_defined"})],
    }
    for fam, changes in cases.items():
        for column, value, names in changes:
            broken = {x for r in d.where(F.col("fam") == fam).withColumn(column, value).select(R.broken_contract().alias("b")).collect() for x in r.b}
            assert names <= broken, (fam, names, broken)


def test_answers_of_every_kind(clips):
    d = {(r.sample_id, r.fam, r.params): r for r in _records(clips).collect()}
    assert list(d["arpeggio", "H-U2", ""].answers) == ["2", "2 semitones", "The answer is 2 semitones."]
    assert list(d["shifted", "B-U4", ""].answers) == ["no", "No.", "No, that is not so."]
    assert list(d["shifted", "T-U4", ""].answers)[0] == "C, D, E, F, G, A, B" and list(d["shifted", "T-U2", "set=C, D, E, F, G, A, B"].answers) == ["none", "None.", "The answer is none."]
    assert d["shifted", "B-G1", ""].box.count("<box>") == 1 and d["shifted", "I-G3", "lo=6"].answers[0] == "none" and d["shifted", "I-G3", "lo=6"].box == ""
    for r in d.values():
        assert len(set(r.variants)) == 3 and len(r.answers) == 3 and "{" not in r.question and all(r.answers)


def test_draws_of_short_clips_are_made_once(spark):
    """Pitches and distances to ask for are drawn once a phrase, however often sets of them are named."""
    from notefold.operators import candidates as C

    ph = spark.createDataFrame([("c", 0, [(0.0, 0.2, 60, 80), (0.4, 0.6, 64, 80)])], "sample_id string, phrase int, v array<struct<start:double,end:double,pitch:int,velocity:int>>")
    plan = C.short_candidates(ph)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except") == 2


def test_short_derivation_does_without_analysis(spark):
    """Phrases take the notes of a clip alone; ranks and values of notes are not worked out for them."""
    from notefold.plans.candidate_queries import short_rederived

    assert "low_rank" not in short_rederived(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_spans_text_rounds_as_decimals(spark):
    """Times in exact binary value, halves to even; null lists and empty ones are told apart."""
    from decimal import ROUND_HALF_EVEN, Decimal

    from notefold.functions import wording as W

    lists = [[(0.125, 2.675), (0.375, 1e6 + 0.005)], None, [], [(-0.001, 0.0)], [(1.005, None)]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, s array<struct<s:double,e:double>>").coalesce(1)
    exact = lambda x: None if x is None else str(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN))
    want = [None if v is None else ";".join(f"{exact(a)}|{exact(b)}" for a, b in v) for v in lists]
    assert [r.t for r in d.orderBy("i").select(W.spans_text("s").alias("t")).collect()] == want


def test_tallies_are_counts_of_the_rows(spark):
    """Counted in Python, statuses add up to the rows, and clips without candidates change nothing."""
    from notefold.operators import candidates as C
    from notefold.operators import checking as K

    notes = "v array<struct<start:double,end:double,pitch:int,velocity:int>>"
    ph = spark.createDataFrame([("a", 0, [(0.0, 0.2, 60, 80), (0.4, 0.6, 64, 20)]), ("b", 1, [(0.0, 0.2, 60, 80)]), ("e", 0, [])], f"sample_id string, phrase int, {notes}")
    c = C.short_candidates(ph)
    rows = [(r.fam, r.status) for r in K.checked_short(c).collect()]
    tally: dict = {}
    for r in K.checked_short(c, tally=True).collect():
        tally[r.fam, r.status] = tally.get((r.fam, r.status), 0) + r.n
    assert rows and tally == {k: rows.count(k) for k in rows}
