"""What is written can be read again."""

import os

from pyspark.sql import functions as F

from notefold.operators import generation as N
from notefold.operators import selection as S
from notefold.sources import files, midi

NOTES = [(0.5, 0.99, 60, 80), (1.0, 1.49, 62, 80), (2.5, 2.99, 65, 80)]


def _clips(spark):
    return spark.createDataFrame([("train_1", "train", NOTES, "4/4", 120, 2), ("val_2", "val", None, "3/4", 90, 0)], f"sample_id string, split string, notes {midi.NOTES}, meter string, bpm int, semitones int")


def test_clips_with_their_metadata(spark, tmp_path, rows):
    assert files.write_clips(_clips(spark), str(tmp_path)).count() == 2
    assert rows(spark.read.json(f"{tmp_path}/meta").select("sample_id", "split", "n_notes")) == [("train_1", "train", 3), ("val_2", "val", None)]
    got = rows(files.read_metadata_csv(spark, f"{tmp_path}/metadata.csv").select("split", "first_onset", "last_offset", "midi_path"))
    assert got == [("train", 0.5, 2.99, "train/midi/train_1.mid"), ("val", 0.0, 0.0, "val/midi/val_2.mid")] and os.path.exists(tmp_path / "train/midi/train_1.mid")


def test_transposed_with_manifest(spark, tmp_path, rows):
    assert rows(files.write_transposed(_clips(spark), str(tmp_path)).select("sample_id")) == [("train_1_2",), ("val_2_0",)]
    assert rows(spark.read.json(f"{tmp_path}/manifest").select("id", "source", "semitones", "tempo_bpm"))[0] == ("train_1_2", "train_1", 2, 120)


def test_lists_vocabulary_and_order(spark, tmp_path, rows):
    ids = spark.createDataFrame([(f"c{i:03}", "few notes") for i in range(200)], "sample_id string, reason string").repartition(7)
    files.write_id_lists({"soft": ids, "hard": ids.where("false")}, str(tmp_path))
    assert rows(files.read_ids(spark, f"{tmp_path}/soft.txt")) == [(f"c{i:03}",) for i in range(200)] and spark.read.json(f"{tmp_path}/soft.json").count() == 200
    parts = [open(tmp_path / "soft.txt" / f).read().split() for f in sorted(os.listdir(tmp_path / "soft.txt")) if f.startswith("part-")]
    assert [x for p in parts for x in p] == [f"c{i:03}" for i in range(200)]
    files.write_vocabulary(S.dense_ids(ids, "sample_id"), f"{tmp_path}/vocab")
    assert spark.read.json(f"{tmp_path}/vocab").agg(F.max("id")).first()[0] == 199
    records = ids.select(F.reverse("sample_id").alias("sample_id"), F.lit("k").alias("query_key"), F.col("sample_id").alias("question"))
    got = [r.sample_id for r in files.ordered_records(records).collect()]
    assert got == sorted(got)


def test_report(spark, tmp_path):
    t = spark.createDataFrame([("a", 2), (None, 1)], "reason string, n long")
    files.write_report({"rejected": t, "nothing": t.where("false")}, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["[rejected]", "  reason=a, n=2", "  reason=none, n=1", "[nothing]"]


def test_generated_clips_are_valid(spark):
    g = N.generate(spark, 200, seed=3).collect()
    assert all(r.valid for r in g) and len({tuple(n.pitch for n in r.notes) for r in g}) > 150
    again = {r.n: r.notes for r in N.generate(spark, 200, seed=3).repartition(7).collect()}
    assert all(again[r.n] == r.notes for r in g)
