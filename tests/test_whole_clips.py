"""Queries that need no beat grid see every note of a clip."""

import pytest

from notefold.plans import registry

CLIPS = "sample_id string, split string, notes array<struct<start:double,end:double,pitch:int,velocity:int>>, basic_info struct<time_signature:string,tempo_bpm:int,music_start_sec:double,bar_duration_sec:double>"
INFO = ("4/4", 120, 0.0, 2.0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two clips that are alike in the lowest notes of two bars, and differ in a chord and behind the second bar."""
    low = [(0.0, 0.4, 60, 80), (2.0, 2.4, 62, 80)]
    a = sorted([*low, (0.0, 0.4, 67, 80), (5.0, 5.4, 72, 80)])
    b = sorted([*low, (0.0, 0.4, 64, 80), (5.0, 5.4, 71, 80)])
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([("train_a", "train", a, INFO), ("test_b", "test", b, INFO)], CLIPS).coalesce(1).write.mode("overwrite").parquet(f"{path}/clips.parquet")
    return path


def test_every_note_counts(spark, folder, rows):
    q = registry.queries()
    assert rows(q["derived_attributes_whole"](spark, folder).select("sample_id", "notes", "high")) == [("test_b", 4, 71), ("train_a", 4, 72)]
    assert rows(q["distinct_names_whole"](spark, folder)) == [("test_b", "C,D,E,B", 4), ("train_a", "C,D,G", 3)]
    assert rows(q["midi_round_trip_whole"](spark, folder)) == [("test_b", 4, True), ("train_a", 4, True)]


def test_other_notes_are_no_twins(spark, folder, rows):
    q = registry.queries()
    assert rows(q["twin_flags"](spark, folder)) == [("test_b", True, True)]
    assert rows(q["twin_flags_whole"](spark, folder)) == [("test_b", False, False)]
    assert rows(q["split_overlap_whole"](spark, folder)) == [("train-test", 0), ("train-val", 0), ("val-test", 0)]


def test_chords_are_transposed_whole(spark, folder, rows):
    got = registry.queries()["transposed_clips"](spark, folder)
    assert rows(got.select("sample_id", "notes")) == [("test_b", 4), ("train_a", 4)]
