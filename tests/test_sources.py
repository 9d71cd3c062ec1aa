import json
import os
import struct

import pytest

from notefold.operators import generation as N
from notefold.sources import files, midi

NOTES = [(0.295455, 0.5, 60, 80), (0.5, 1.768182, 64, 70), (1.768182, 2.0, 60, 1)]


def test_round_trip():
    got = midi.parse(midi.encode(NOTES))
    assert [(p, v) for _, _, p, v in got] == [(p, v) for _, _, p, v in NOTES]
    assert max(abs(a - b) for x, y in zip(got, NOTES) for a, b in zip(x[:2], y[:2])) < 1 / 440
    assert midi.parse(midi.encode([])) == []


def test_running_status_and_tempo_changes():
    body = bytes([0, 0xFF, 0x51, 3, 0x07, 0xA1, 0x20, 0, 0x90, 60, 64, 96, 60, 0, 0, 0xFF, 0x51, 3, 0x0F, 0x42, 0x40, 0, 0x90, 62, 1, 96, 62, 0, 0, 0xFF, 0x2F, 0])
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(body)) + body
    assert midi.parse(data) == [(0.0, 0.5, 60, 64), (0.5, 1.5, 62, 1)]


def test_issue_codes():
    assert midi.issues_of(b"junk")[1] == ["midi:load_failed:ValueError"] and "midi:no_notes" in midi.issues_of(midi.encode([]))[1]
    assert midi.issues_of(midi.encode([(0.0, 1.0, 60, 9), (0.5, 2.0, 62, 9)]))[1] == ["midi:polyphonic_overlap"]


def test_write_and_read(spark, tmp_path):
    clips = spark.createDataFrame([("train_1", "train", NOTES), ("val_1", None, None)], "sample_id string, split string, notes " + midi.NOTES)
    assert midi.write_midi(clips, str(tmp_path)).count() == 2
    (tmp_path / "bad.mid").write_bytes(b"MThd")
    got = {os.path.basename(r.path): (len(r.notes), r.issues) for r in midi.read_midi(spark, str(tmp_path)).collect()}
    assert got["train_1.mid"][0] == 3 and got["val_1.mid"][0] == 0 and got["bad.mid"][1][0].startswith("midi:load_failed")
    spark.dataSource.register(midi.MidiSource)
    assert {os.path.basename(r.path): (len(r.notes), r.issues) for r in spark.read.format("midi").load(str(tmp_path)).collect()} == got


def test_wav(spark, tmp_path):
    head = b"RIFF" + struct.pack("<I", 36 + 8820) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 44100, 88200, 2, 16) + b"data" + struct.pack("<I", 8820)
    (tmp_path / "a.wav").write_bytes(head + b"\0" * 8820)
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    assert {os.path.basename(r.path): (r.frames, r.rate) for r in files.read_wav_headers(spark, str(tmp_path)).collect()} == {"a.wav": (4410, 44100), "b.wav": (None, None)}


def test_predictions_list_or_lines(spark, tmp_path, rows):
    data = [{"sample_id": "a", "question": "q", "prediction": "x"}, {"sample_id": "b", "question": "q", "prediction": None}]
    (tmp_path / "list.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, data)))
    assert rows(files.read_predictions(spark, str(tmp_path / "list.json"))) == rows(files.read_predictions(spark, str(tmp_path / "lines.json"))) == [("a", "q", "x"), ("b", "q", None)]
    (tmp_path / "bad.json").write_text('"text"')
    with pytest.raises(Exception):
        files.read_predictions(spark, str(tmp_path / "bad.json")).collect()


def test_records_and_lists(spark, tmp_path, rows):
    (tmp_path / "ids.txt").write_text("a\n\n b \na\n")
    assert rows(files.read_ids(spark, str(tmp_path / "ids.txt"))) == [("a",), ("b",)]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/x.json").write_text(json.dumps({"sample_id": "x", "basic_info": {"time_signature": "4/4", "tempo_bpm": 90}}, indent=1))
    assert rows(files.frames(files.read_meta(spark, str(tmp_path / "meta"))).select("sample_id", "meter", "bpm")) == [("x", "4/4", 90)]
    (tmp_path / "qa.json").write_text(json.dumps([{"sample_id": "x", "gold_answer": v} for v in (3, "x", ["C"], None)]))
    q = files.read_qa(spark, str(tmp_path / "qa.json"))
    assert rows(q.selectExpr("to_json(gold_answer)")) == sorted([("3",), ('"x"',), ('["C"]',), ("null",)], key=repr) or q.count() == 4
    files.write_json_list(q.select("sample_id"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == [{"sample_id": "x"}] * 4
    keep, log = files.quarantined(q.select("sample_id"), spark.createDataFrame([("x",)], "sample_id string"), "bad")
    assert keep.count() == 0 and log.count() == 4


def test_generated_clips(spark):
    a = N.generate(spark, 60, 1).collect()
    assert sorted(a, key=lambda r: r.n) == sorted(N.generate(spark.newSession(), 60, 1).repartition(3).collect(), key=lambda r: r.n)
    assert sum(r.valid for r in a) >= 55
    for r in a:
        assert all(x.start < x.end and 36 <= x.pitch <= 96 and 40 <= x.velocity <= 110 for x in r.notes) and all(x.end <= y.start + 1e-9 for x, y in zip(r.notes, r.notes[1:]))
    assert N.generate(spark, 0).count() == 0
    assert N.sanitised([(-0.1, 0.2, 60, 1), (0.1, 0.15, 61, 1)]) == [(0.0, 0.2, 60, 1), (0.2, 0.25, 61, 1)]
    assert {len(r.notes) for r in N.short_clips(spark, 30).collect()} == {1, 2, 3}


def test_wav_with_long_chunks_before_the_sound(spark, tmp_path):
    """A LIST chunk of 100 kB, and one of odd length, stand before the data chunk."""
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 44100, 88200, 2, 16)
    extra = b"LIST" + struct.pack("<I", 100_000) + b"\0" * 100_000 + b"odd " + struct.pack("<I", 3) + b"abc\0"
    for name, body in (("c d.wav", fmt + extra), ("e.wav", extra + fmt), ("f.wav", extra)):
        (tmp_path / name).write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + body + b"data" + struct.pack("<I", 8820) + b"\0" * 8820)
    got = {os.path.basename(r.path).replace("%20", " "): (r.frames, r.rate) for r in files.read_wav_headers(spark, str(tmp_path)).collect()}
    assert got == {"c d.wav": (4410, 44100), "e.wav": (4410, 44100), "f.wav": (None, None)}


def test_predictions_of_a_folder_by_file(spark, tmp_path, rows):
    """Each file has its own form; lists and lines may lie side by side, and blanks before them do not matter."""
    one, two = ({"sample_id": k, "question": "q", "prediction": "x"} for k in "ab")
    (tmp_path / "a.json").write_text("\n [" + json.dumps(one, indent=1) + "]")
    (tmp_path / "b.json").write_text(json.dumps(two) + "\n" + json.dumps(one) + "\n")
    (tmp_path / "c.json").write_text("")
    assert rows(files.read_predictions(spark, str(tmp_path))) == [("a", "q", "x"), ("a", "q", "x"), ("b", "q", "x")]


def test_question_tree(spark, tmp_path, rows):
    assert files.read_qa_tree(spark, str(tmp_path)).count() == 0 and files.read_qa(spark, str(tmp_path / "none.json")).count() == 0
    for kind, split in (("grounding", "train"), ("understanding", "test-full")):
        os.makedirs(tmp_path / "qa" / kind, exist_ok=True)
        (tmp_path / "qa" / kind / f"{split}.json").write_text(json.dumps([{"sample_id": f"{split}_1", "gold_answer": [1, "C"]}]))
    assert rows(files.read_qa_tree(spark, str(tmp_path)).select("sample_id", "kind", "file_split")) == [("test-full_1", "understanding", "test-full"), ("train_1", "grounding", "train")]


def test_clips_of_several_roots(spark, tmp_path, rows):
    good = [(0.5, 0.99, 60, 80), (1.0, 1.49, 62, 80), (1.5, 1.99, 64, 80), (2.5, 2.99, 65, 80), (3.0, 4.5, 67, 80)]
    short = [(0.5, 0.55, 60, 80)] + good[1:]
    for root, sid, notes in (("a", "train_1", good), ("b", "train_2", short), ("b", "train_3", good)):
        clips = spark.createDataFrame([(sid, "train", notes)], "sample_id string, split string, notes " + midi.NOTES)
        midi.write_midi(clips, str(tmp_path / root)).count()
        if sid != "train_3":
            os.makedirs(tmp_path / root / "train" / "meta", exist_ok=True)
            (tmp_path / root / "train" / "meta" / f"{sid}.json").write_text(json.dumps({"basic_info": {"time_signature": "4/4", "tempo_bpm": 120, "music_start_sec": 0.5, "bar_duration_sec": 2.0}}))
    roots = [str(tmp_path / r) for r in ("a", "b", "missing")]
    assert rows(files.scan_clips(spark, roots).select("sample_id", "split", "meter", "bpm", "n")) == [("train_1", "train", "4/4", 120, 5)]
    assert {r.sample_id: r.usable for r in files.scan_clips(spark, roots, usable_only=False).collect()} == {"train_1": True, "train_2": False, "train_3": False}
    got = {r.sample_id: r.midi_path is not None for r in files.sample_listing(spark, str(tmp_path / "b" / "train")).collect()}
    assert got == {"train_2": True}
    os.remove(tmp_path / "b" / "train" / "midi" / "train_2.mid")
    assert {r.sample_id: r.midi_path for r in files.sample_listing(spark, str(tmp_path / "b" / "train")).collect()} == {"train_2": None}
    assert files.scan_clips(spark, [str(tmp_path / "missing")]).count() == 0
