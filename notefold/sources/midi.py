"""Standard MIDI files: parsing, writing, a batch data source and a sink."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESOLUTION = 220
TEMPO_MICROS = 500_000
NOTES = "array<struct<start:double,end:double,pitch:int,velocity:int>>"


def _varlen(data: bytes, pos: int) -> tuple[int, int]:
    value = 0
    while True:
        b = data[pos]
        pos += 1
        value = value << 7 | b & 127
        if b < 128:
            return value, pos


def _track(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Events of a track as (tick, status, first, second, meta data)."""
    pos = tick = status = 0
    while pos < len(data):
        delta, pos = _varlen(data, pos)
        tick += delta
        if data[pos] & 128:
            status = data[pos]
            pos += 1
        if status == 0xFF:
            kind = data[pos]
            n, pos = _varlen(data, pos + 1)
            yield tick, status, kind, 0, data[pos : pos + n]
            pos += n
        elif status in (0xF0, 0xF7):
            n, pos = _varlen(data, pos)
            pos += n
        elif status >> 4 in (0xC, 0xD):
            pos += 1
        else:
            yield tick, status, data[pos], data[pos + 1], b""
            pos += 2


def parse(data: bytes) -> list[tuple[float, float, int, int]]:
    """Notes (start, end, pitch, velocity) of a file, all tracks, by start and end; ValueError if it is none.

    A note ends with the first matching off; a new on for a sounding pitch ends the old note."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise ValueError("no header")
    division = int.from_bytes(data[12:14], "big")
    if division & 0x8000 or not division:
        raise ValueError("no ticks per beat")
    pos, tracks = 8 + int.from_bytes(data[4:8], "big"), []
    while pos + 8 <= len(data):
        size = int.from_bytes(data[pos + 4 : pos + 8], "big")
        if data[pos : pos + 4] == b"MTrk":
            tracks.append(list(_track(data[pos + 8 : pos + 8 + size])))
        pos += 8 + size
    tempi = sorted({(0, TEMPO_MICROS)} | {(t, int.from_bytes(m, "big")) for track in tracks for t, s, k, _, m in track if s == 0xFF and k == 0x51})
    marks, at, last = [], 0.0, (0, TEMPO_MICROS)
    for t, micros in tempi:
        at += (t - last[0]) * last[1] / 1e6 / division
        marks.append((t, at, micros))
        last = (t, micros)

    def seconds(tick: int) -> float:
        t, s, micros = next(m for m in reversed(marks) if m[0] <= tick)
        return s + (tick - t) * micros / 1e6 / division

    notes = []
    for track in tracks:
        sounding: dict = {}
        for tick, status, a, b, _ in track:
            key = (status & 15, a)
            if status >> 4 == 9 and b > 0 or status >> 4 in (8, 9):
                if key in sounding:
                    start, velocity = sounding.pop(key)
                    notes.append((seconds(start), seconds(tick), a, velocity))
                if status >> 4 == 9 and b > 0:
                    sounding[key] = (tick, b)
    return sorted(notes)


def issues_of(data: bytes) -> tuple[list[tuple], list[str]]:
    """Notes with the error codes of an inspection."""
    try:
        notes = parse(data)
    except (ValueError, IndexError, StopIteration) as x:
        return [], [f"midi:load_failed:{type(x).__name__}"]
    found = []
    if not notes:
        found += ["midi:no_instruments"] if b"\x90" not in data else []
        found.append("midi:no_notes")
    if any(e <= s for s, e, _, _ in notes):
        found.append("midi:non_positive_duration")
    if any(notes[i][1] > notes[i + 1][0] + 1e-4 for i in range(len(notes) - 1)):
        found.append("midi:polyphonic_overlap")
    return notes, found


def _number(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.insert(0, n & 127 | 128)
    return bytes(out)


def encode(notes: list) -> bytes:
    """Notes as a file of one track at 120 beats a minute and ``RESOLUTION`` ticks a beat."""
    ticks = lambda s: max(0, round(s * RESOLUTION * 1e6 / TEMPO_MICROS))
    events = [(ticks(s), 1, p, v) for s, e, p, v in notes] + [(max(ticks(e), ticks(s) + 1), 0, p, 0) for s, e, p, v in notes]
    body, now = bytearray(b"\x00\xff\x51\x03" + TEMPO_MICROS.to_bytes(3, "big")), 0
    for t, on, p, v in sorted(events):
        body += _number(t - now) + bytes([0x90 if on else 0x80, p & 127, v & 127])
        now = t
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + (6).to_bytes(4, "big") + b"\0\0\0\1" + RESOLUTION.to_bytes(2, "big") + b"MTrk" + len(body).to_bytes(4, "big") + bytes(body)


_KIND = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("pitch", pa.int32()), ("velocity", pa.int32())]))


def _rows(notes: list) -> list[dict]:
    return [{"start": s, "end": e, "pitch": p, "velocity": v} for s, e, p, v in notes]


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """``path, notes, issues`` of all ``.mid`` files below a path; broken files give issues, not errors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mid").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            got = [issues_of(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_rows(n) for n, _ in got], _KIND), pa.array([i for _, i in got], pa.list_(pa.string()))], ["path", "notes", "issues"])

    return files.mapInArrow(run, f"path string, notes {NOTES}, issues array<string>")


def write_midi(clips: DataFrame, folder: str) -> DataFrame:
    """One file per clip, ``<folder>/<split>/midi/<sample_id>.mid``, written by the tasks; gives what was written.

    The folder must be one that all executors share. A file is written beside its place and moved there, so a repeated
    task leaves the same file."""
    src = clips.select("sample_id", F.coalesce("split", F.lit("none")).alias("split"), "notes")

    def run(batches):
        for b in batches:
            paths = []
            for sid, split, notes in zip(*(b.column(i).to_pylist() for i in range(3))):
                place = os.path.join(folder, split, "midi")
                os.makedirs(place, exist_ok=True)
                path = os.path.join(place, f"{sid}.mid")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(encode([(n["start"], n["end"], n["pitch"], n["velocity"]) for n in notes or []]))
                os.replace(f"{path}.{os.getpid()}", path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths)], ["sample_id", "path"])

    return src.mapInArrow(run, "sample_id string, path string")


class _File(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class MidiSource(DataSource):
    """``spark.read.format("midi").load(folder)`` after ``spark.dataSource.register(MidiSource)``."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return f"path string, notes {NOTES}, issues array<string>"

    def reader(self, schema) -> DataSourceReader:
        return MidiReader(self.options)


class MidiReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.each = options["path"], int(options.get("filespersplit", "256"))

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(d, f) for d, _, files in os.walk(self.folder) for f in files if f.lower().endswith(".mid"))
        return [_File(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [_File([])]

    def read(self, partition):
        for path in partition.paths:
            with open(path, "rb") as f:
                notes, found = issues_of(f.read())
            yield path, notes, found


def through_midi(clips: DataFrame) -> DataFrame:
    """Clips with ``again``: their notes after being written as a file and read."""
    src = clips.select("sample_id", "notes")

    def run(batches):
        for b in batches:
            again = [_rows(parse(encode([(n["start"], n["end"], n["pitch"], n["velocity"]) for n in notes or []]))) for notes in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(again, _KIND)], ["sample_id", "notes", "again"])

    return src.mapInArrow(run, f"sample_id string, notes {NOTES}, again {NOTES}")
