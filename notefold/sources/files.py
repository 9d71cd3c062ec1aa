"""Readers and writers of the record files around clips: JSON, JSON lines, CSV, lists, WAV headers."""

from __future__ import annotations

import io
import struct
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION = "sample_id string, question string, prediction string"
METADATA = "audio_path string, midi_path string, json_path string, first_onset double, last_offset double, split string"
META = """sample_id string, split string, filename string, source_sample_id string,
  basic_info struct<num_bars:int,num_notes:int,time_signature:string,beats_per_bar:int,beat_unit:int,meter_class:string,tempo_bpm:int,tempo_class:string,bar_duration_sec:double,clip_duration_sec:double,leading_silence_sec:double,music_start_sec:double,music_end_sec:double,subdivision_type:string>,
  construction struct<kind:string,semitones:int,bar2_time_offset_sec:double,source_bar:int>, concepts array<string>"""
QA = """sample_id string, split string, audio_path string, question string, question_variants array<string>, answer_text string, answer_texts struct<`0`:string,`1`:string,`2`:string>, default_language_style int,
  answer_spans array<array<int>>, answer_spans_sec array<array<double>>, query_key string, query_id int, qa_category string, concept string, gold_answer variant, gold_answer_type string, evidence_note_indices array<int>"""


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file, with the file it came from; broken files give null records."""
    d = spark.read.schema(META + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return d.withColumn("file", F.input_file_name())


def frames(meta: DataFrame) -> DataFrame:
    """The timing frame of meta records."""
    b = F.col("basic_info")
    return meta.select("sample_id", b["time_signature"].alias("meter"), b["tempo_bpm"].alias("bpm"), b["music_start_sec"].alias("music_start"), b["bar_duration_sec"].alias("bar_dur"))


def opened(path: str):
    """A file by the path a scan gives, for reading with ``seek``; executors read it where it is."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + unquote(rest).lstrip("/") if rest else path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _paths(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The files at a path, without their content, which is not read for it."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", pattern).option("recursiveFileLookup", True) if pattern else r).load(path).select("path")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lists or JSON lines of predictions, each file by its own first character; other forms of file give an error when read.

    A file that is one object over several lines is neither. The driver sees the names of the files only."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            firsts = []
            for p in b.column(0).to_pylist():
                with opened(p) as f:
                    c = b" "
                    while c.isspace():
                        c = f.read(1)
                firsts.append(c == b"[")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(firsts, pa.bool_())], ["path", "whole"])

    forms = _paths(spark, path).mapInArrow(run, "path string, whole boolean").collect()
    out = spark.createDataFrame([], PREDICTION)
    for whole in (True, False):
        if names := [r.path for r in forms if r.whole == whole]:
            out = out.unionByName(spark.read.schema(PREDICTION).option("multiLine", whole).option("mode", "FAILFAST").json(names))
    return out


def read_qa(spark: SparkSession, *paths: str) -> DataFrame:
    """Question files, lists or lines, with gold answers of any JSON type kept as they are; files that are not there are skipped."""
    there = [p for p in paths if _exists(spark, p)]
    return spark.read.schema(QA).option("multiLine", True).json(there) if there else spark.createDataFrame([], QA)


def read_qa_tree(spark: SparkSession, root: str) -> DataFrame:
    """All question files ``<root>/qa/<kind>/<split>.json`` with their ``kind`` and ``file_split``; missing ones are skipped."""
    out = None
    for kind in ("grounding", "understanding"):
        for split in ("train", "val", "test", "test-full"):
            if _exists(spark, f"{root}/qa/{kind}/{split}.json"):
                part = read_qa(spark, f"{root}/qa/{kind}/{split}.json").select("*", F.lit(kind).alias("kind"), F.lit(split).alias("file_split"))
                out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], QA + ", kind string, file_split string") if out is None else out


def id_of_path() -> Column:
    """The name of a file without its ending."""
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")


def sample_listing(spark: SparkSession, split_folder: str) -> DataFrame:
    """``sample_id, meta_path, midi_path`` of ``<folder>/meta/*.json``; the MIDI path is null where there is no such file."""
    empty = spark.createDataFrame([], "path string")
    of = lambda kind, end: _paths(spark, f"{split_folder}/{kind}", f"*.{end}") if _exists(spark, f"{split_folder}/{kind}") else empty
    meta = of("meta", "json").select(id_of_path().alias("sample_id"), F.col("path").alias("meta_path"))
    notes = of("midi", "mid").select(id_of_path().alias("sample_id"), F.col("path").alias("midi_path"))
    return meta.join(notes, "sample_id", "left")


def scan_clips(spark: SparkSession, roots: list[str], splits: tuple = ("train", "val", "test"), usable_only: bool = True) -> DataFrame:
    """Analysed clips of several roots, each ``<root>/<split>/midi/<id>.mid`` with the frame of ``<root>/<split>/meta/<id>.json``.

    Roots and splits that are not there are skipped. Only usable clips are kept, unless told otherwise; a clip without its meta has no frame."""
    from notefold.operators.excerpt import excerpts
    from notefold.sources.midi import read_midi

    out = None
    for root in roots:
        for split in splits:
            if not _exists(spark, f"{root}/{split}/midi"):
                continue
            notes = read_midi(spark, f"{root}/{split}/midi").select(id_of_path().alias("sample_id"), "notes")
            meta = frames(read_meta(spark, f"{root}/{split}/meta").withColumn("sample_id", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")))
            part = notes.join(meta, "sample_id", "left").withColumn("split", F.lit(split))
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "sample_id string, notes array<struct<start:double,end:double,pitch:int,velocity:int>>, meter string, bpm int, music_start double, bar_dur double, split string")
    x = excerpts(out)
    return x.where("usable") if usable_only else x


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).option("header", True).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A list of ids, one per line; blank lines and repeats are left out."""
    return spark.read.text(path).select(F.trim("value").alias("sample_id")).where("sample_id <> ''").distinct()


def wav_header(data) -> tuple[int, int] | None:
    """Frames and rate of a RIFF file, given as bytes or as a file that can seek; null if it isn't one. Chunks of any length are stepped over."""
    f = io.BytesIO(data or b"") if isinstance(data, (bytes, type(None))) else data
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    pos, rate, align = 12, None, None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt " and len(body := f.read(16)) == 16:
            rate, align = struct.unpack_from("<I", body, 4)[0], struct.unpack_from("<H", body, 12)[0]
        if name == b"data":
            return (size // align, rate) if rate and align else None
        pos += 8 + size + size % 2
        f.seek(pos)
    return None


def read_wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, frames, rate`` of all WAV files below a path: tasks read the heads of the chunks and seek over the sound."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = []
            for p in b.column(0).to_pylist():
                with opened(p) as f:
                    got.append(wav_header(f) or (None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], ["path", "frames", "rate"])

    return _paths(spark, path, "*.wav").mapInArrow(run, "path string, frames long, rate long")


def quarantined(rows: DataFrame, ids: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows not on a list of ids, and a log row for each that is: nothing is moved or overwritten."""
    keep = rows.join(ids.select("sample_id").distinct(), "sample_id", "left_anti")
    log = rows.join(ids.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", F.lit(reason).alias("reason"))
    return keep, log


def modalities(ids: DataFrame) -> DataFrame:
    """The files that belong to each id: audio, notes and meta, in its split's folders."""
    split = F.split_part(F.col("sample_id"), F.lit("_"), F.lit(1))
    part = lambda kind, end: F.struct(F.lit(kind).alias("modality"), F.concat_ws("/", split, F.lit(kind), F.concat(F.col("sample_id"), F.lit(end))).alias("file"))
    return ids.select("sample_id", F.inline(F.array(part("wav", ".wav"), part("midi", ".mid"), part("meta", ".json"))))


def split_of_id(c: Column) -> Column:
    """The split an id begins with; an error for ids that begin with none."""
    s = F.split_part(c, F.lit("_"), F.lit(1))
    return F.when(s.isin("train", "val", "test"), s).otherwise(F.raise_error(F.concat(F.lit("no split in "), c)).cast("string"))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ids ``<split>_<number>`` in hash order within their split."""
    from notefold.operators.selection import hash_ranked

    return hash_ranked(rows, ["split"], keys, "ids", "_n").withColumn("sample_id", F.format_string("%s_%06d", "split", (F.col("_n") - 1).cast("long"))).drop("_n")


def write_json_lines(rows: DataFrame, path: str, by: str | None = "split") -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_json_list(rows: DataFrame, path: str) -> None:
    """Each task's rows as one JSON list in a text file, so no task holds all rows."""

    def run(batches):
        import pyarrow as pa

        lines = [x for b in batches for x in b.column(0).to_pylist()]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",\n".join(lines) + "]"])], ["value"])

    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def metadata_table(clips: DataFrame) -> DataFrame:
    """First onset and last offset of each clip, 0 for clips without notes, with its file paths."""
    file = lambda kind, end: F.concat_ws("/", "split", F.lit(kind), F.concat(F.col("sample_id"), F.lit(end)))
    return clips.select(file("wav", ".wav").alias("audio_path"), file("midi", ".mid").alias("midi_path"), file("meta", ".json").alias("json_path"), F.coalesce(F.array_min(F.transform("notes", lambda x: x["start"])), F.lit(0.0)).alias("first_onset"), F.coalesce(F.array_max(F.transform("notes", lambda x: x["end"])), F.lit(0.0)).alias("last_offset"), "split")


def content_digest(rows: DataFrame) -> DataFrame:
    """Order-free digest of a table: rows, sum and xor of the hashes of their JSON form."""
    h = F.xxhash64(F.to_json(F.struct("*")))
    return rows.select(h.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor"))


def write_id_lists(ids: dict[str, DataFrame], folder: str) -> None:
    """Lists of ids: of each name one folder with a text file (an id a line) and one with JSON lines (all columns), sorted by id over the files."""
    for name, rows in ids.items():
        r = rows.repartitionByRange("sample_id").sortWithinPartitions("sample_id")
        r.select("sample_id").write.mode("overwrite").text(f"{folder}/{name}.txt")
        r.write.mode("overwrite").json(f"{folder}/{name}.json")


def write_vocabulary(ids: DataFrame, path: str) -> None:
    """Names with their numbers as JSON lines, in order of the numbers."""
    ids.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def ordered_records(records: DataFrame, keys: tuple = ("sample_id", "query_key", "question")) -> DataFrame:
    """Records in their order of release: sorted over ranges, so no task sees all of them."""
    return records.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_clips(clips: DataFrame, folder: str) -> DataFrame:
    """Clips as one MIDI file each and their metadata as JSON lines per split, with a table of contents; gives what was written.

    ``<folder>/<split>/midi/<id>.mid``, ``<folder>/meta/split=<split>``, ``<folder>/metadata.csv``. The folder must be one that all executors share."""
    from notefold.sources.midi import write_midi

    done = write_midi(clips, folder)
    write_json_lines(clips.withColumn("n_notes", F.when(F.col("notes").isNotNull(), F.size("notes"))).drop("notes"), f"{folder}/meta")
    metadata_table(clips).write.mode("overwrite").option("header", True).csv(f"{folder}/metadata.csv")
    return done


def write_transposed(clips: DataFrame, folder: str) -> DataFrame:
    """Transposed clips as files with the manifest of where they come from: ``id, split, source, semitones, meter, tempo_bpm, n_notes``."""
    manifest = clips.select(F.concat_ws("_", "sample_id", F.col("semitones").cast("string")).alias("id"), "split", F.col("sample_id").alias("source"), "semitones", "meter", F.col("bpm").alias("tempo_bpm"), F.size("notes").alias("n_notes"))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    renamed = clips.withColumn("sample_id", F.concat_ws("_", "sample_id", F.col("semitones").cast("string")))
    return write_clips(renamed, folder)


def report_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """Small result tables as lines of one report, ``place, line``, each under its name; for sanity, gate and statistics reports.

    A table has as many lines as rows, in the order of its columns, so the report is as large as the tables are."""
    out = None
    for k, (name, t) in enumerate(tables.items()):
        cell = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none")))
        body = t.select(F.lit(k).alias("place"), F.lit(1).alias("level"), F.concat(F.lit("  "), F.concat_ws(", ", *[cell(c) for c in t.columns])).alias("line"))
        head = t.sparkSession.createDataFrame([(k, 0, f"[{name}]")], "place int, level int, line string")
        out = head.unionByName(body) if out is None else out.unionByName(head).unionByName(body)
    return out.orderBy("place", "level", "line").select("place", "line")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A report as one text file; its tables are summaries, not data."""
    report_lines(tables).coalesce(1).select("line").write.mode("overwrite").text(path)
