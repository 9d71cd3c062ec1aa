"""Cases of analysed clips: notes as (onset, length, pitch) in beats."""

from pyspark.sql import functions as F

from notefold.operators import excerpt as E

SCHEMA = "sample_id string, notes array<struct<start:double,end:double,pitch:int,velocity:int>>, meter string, bpm int, music_start double, bar_dur double"
BEATS = {"2/4": 2, "3/4": 3, "4/4": 4, "6/8": 6}


def clip(spark, seq, meter="4/4", bpm=120, start=0.5, shift=0.0, overlap=False):
    spb = 60 / bpm
    notes = [(start + shift + o * spb, start + shift + (o + d) * spb, p, 80) for o, d, p in seq]
    return E.excerpts(spark.createDataFrame([("x", notes, meter, bpm, start, BEATS[meter] * spb)], SCHEMA))


def value(df, column):
    r = df.select(column.alias("v")).first()[0]
    return list(r) if isinstance(r, list) else r


def steady(pitches, length=1.0):
    return [(i * length, length, p) for i, p in enumerate(pitches)]


EIGHT = steady([60, 62, 64, 65, 67, 69, 71, 72])


def test_bars_and_beats(spark):
    d = clip(spark, [(0, 1, 60), (1, 1, 62), (2, 2, 64), (4, 1, 65), (5, 0.5, 67), (5.5, 0.5, 69), (6, 2, 71)])
    assert value(d, F.transform(E.in_bar(1), lambda x: x["i"])) == [0, 1, 2]
    assert value(d, E.bar_initial_notes()) == [0, 3] and value(d, E.notes_on_beat(2)) == [1, 4] and value(d, E.notes_on_beat(5)) is None
    assert value(d, E.notes_in_second_half()) == [2, 6] and value(d, E.notes_at_bar_middle()) == [2, 6]
    assert value(d, E.notes_with_value(0.5)) == [4, 5] and value(d, E.notes_with_value(3.0)) == []
    assert value(d, E.beat_name(F.get("ev", F.lit(5))["grid"])) == "the second half of beat 2"
    assert value(d, E.value_name(F.lit(2.0))) == "half note"


def test_pickup_has_no_clear_frame(spark):
    d = clip(spark, EIGHT, shift=0.25)
    assert value(d, F.col("frame_clear")) is False and value(d, E.notes_on_beat(1)) is None


def test_ultra_short_is_unusable(spark):
    d = clip(spark, [(0, 0.06, 60), *EIGHT[1:]], bpm=72)
    assert value(d, F.col("ultra_short")) is True and value(d, F.col("usable")) is False and value(d, E.bar_initial_notes()) is None


def test_ambiguous_bar_line(spark):
    d = clip(spark, [(0, 1, 60), (1, 2.5, 62), (3.8, 1, 64), (5, 3, 65)])
    assert value(d, F.col("bar_ambiguous")) is True and value(d, E.longest_note_of_bar(1)) is None


def test_scale(spark):
    d = clip(spark, steady([60, 61, 62, 64, 66, 67, 60, 62]))
    assert value(d, E.notes_outside_scale(0)) == [1, 4] and value(d, E.never_played(0)) == [5, 9, 11] and value(d, E.played()) == [0, 1, 2, 4, 6, 7]


def test_intervals(spark):
    d = clip(spark, steady([60, 62, 62, 68, 65, 66, 60, 72]))
    assert value(d, E.notes_reached_by(1, 2)) == [1, 5] and value(d, E.notes_reached_by(3, 5)) == [4] and value(d, E.notes_reached_by(6)) == [3, 6, 7]
    assert value(d, E.largest_jump()) == 12 and value(d, E.repeated_notes()) == [2] and value(d, E.downward_notes()) == [4, 6]
    assert value(d, E.notes_reached_by_named(6, "ascending")) == [3] and value(d, E.notes_reached_by_named(6, "descending")) == [6] and value(d, E.count_moves_of(6)) == 2
    assert value(d, E.pitch_rank_notes(1)) == [7] and value(d, E.pitch_rank_notes(1, False)) == [0, 6] and value(d, E.pitch_rank_notes(9)) == []


def test_harmony(spark):
    d = clip(spark, steady([57, 60, 64, 57, 65, 69, 72, 65])).withColumn("t1", E.triad_of_bar(1)).withColumn("t2", E.triad_of_bar(2))
    r = d.select("t1.root", "t1.kind", F.col("t2.root").alias("r2"), F.col("t2.kind").alias("k2")).first()
    assert tuple(r) == (9, "minor", 5, "major")
    t1, t2 = F.col("t1"), F.col("t2")
    assert value(d, F.pmod(t2["root"] - t1["root"], F.lit(12))) == 8 and value(d, E.notes_not_in_other_triad(2, t2, t1)) == [4, 7] and value(d, E.triad_member_notes(1, t1, "third")) == [1]
    assert value(clip(spark, [(0, 2, 60), (2, 2, 64), (4, 4, 67)]), E.triad_of_bar(1)) is None


def test_repetition(spark):
    up = clip(spark, steady([60, 62, 64, 65, 65, 67, 69, 70]))
    same = clip(spark, steady([60, 62, 64, 65, 60, 62, 64, 65]))
    mixed = clip(spark, steady([60, 62, 64, 65, 61, 62, 66, 64]))
    for d, want in ((up, (5, 4)), (same, (0, 0)), (mixed, (None, 3))):
        b = d.withColumn("d", E.bar_differences())
        assert (value(b, E.bar_shift(F.col("d"))), value(b, F.size(F.filter("d", lambda v: v != 0)))) == want
    assert value(mixed, E.bar2_notes_differing()) == [4, 6, 7]
    assert value(clip(spark, EIGHT[:7]), E.bar2_notes_differing()) is None


def test_longest_margin_and_rests(spark):
    wide = clip(spark, [(0, 2, 60), (2, 1.5, 62), (3.5, 0.5, 64), (4, 4, 65)])
    assert value(wide, E.longest_note_of_bar(1)) == 0 and value(wide, E.longest_note_of_bar(1, 1.5)) is None and value(wide, E.longest_note_of_bar(2)) is None
    rest = clip(spark, [(0, 0.5, 60), (1, 1, 62), (2, 2, 64), (4, 4, 65)])
    assert value(rest, E.longest_note_of_bar(1)) is None and value(rest, E.notes_with_value(1.0)) is None and value(rest, E.notes_on_beat(2)) == [1]


def test_syncopation(spark):
    d = clip(spark, [(0, 1.5, 60), (1.5, 1.5, 62), (3, 1, 64), (4, 2, 65), (6, 2, 67)])
    assert value(d, E.syncopated_notes()) == [1]
    assert value(clip(spark, EIGHT), E.syncopated_notes()) == []
    assert value(clip(spark, steady([60] * 12), "6/8"), E.syncopated_notes()) is None
    blurred = clip(spark, [(0, 1, 60), (1, 1.17, 62), (2.17, 1.83, 64), (4, 2, 65), (6, 2, 67)])
    assert value(blurred, E.syncopated_notes()) is None


def test_tempo(spark):
    d = clip(spark, EIGHT, bpm=72)
    assert abs(value(d, E.measured_tempo()) - 72) < 1e-6 and value(d, E.tempo_consistent()) is True and value(d, E.shortest_notes_per_bar()) == 4
    assert value(clip(spark, EIGHT[:1] + EIGHT[4:5]), E.measured_tempo()) is None


def test_arpeggio(spark):
    d = clip(spark, steady([60, 64, 67, 60, 60, 64, 67, 64]))
    k1, k2 = E.arpeggio_kind(1), E.arpeggio_kind(2)
    assert (value(d, k1), value(d, k2)) == ("ascending", "updown")
    assert value(d, E.arpeggio_first_cycle(1, k1)) == [0, 1, 2] and value(d, E.arpeggio_first_cycle(2, k2)) == [4, 5, 6, 7]
    assert value(d, E.drop_back_notes(1)) == [3] and value(d, E.drop_back_notes(2)) == []


def test_nulls_and_nothing(spark):
    d = E.excerpts(spark.createDataFrame([("a", None, None, None, None, None), ("b", [], "4/4", 120, 0.0, 2.0), ("c", [(None, 1.0, 60, 1), (0.0, 1.0, None, 1)], "9/9", 0, 0.0, 2.0)], SCHEMA))
    assert [tuple(r) for r in d.select("n", "usable", "frame_clear", "grid_ok", "rest_free").collect()] == [(0, False, False, False, False)] * 3
    assert [r[0] for r in d.select(E.bar_initial_notes()).collect()] == [None] * 3 and [r[0] for r in d.select(E.notes_reached_by(1)).collect()] == [[], [], []]


def test_order_of_rows_and_notes_does_not_matter(spark):
    notes = [(0.5 + 0.5 * i, 1.0 + 0.5 * i, 60 + i, 80) for i in range(8)]
    a = E.excerpts(spark.createDataFrame([("x", notes, "4/4", 120, 0.5, 2.0)], SCHEMA))
    b = E.excerpts(spark.createDataFrame([("x", notes[::-1], "4/4", 120, 0.5, 2.0)], SCHEMA).repartition(3))
    assert a.select("ev").first() == b.select("ev").first()
