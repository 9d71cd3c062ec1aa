"""Clips as analysed excerpts: ordered notes with bar, grid, length, move and rank, and integrity flags.

Everything is worked out inside a row with array functions, so the analysis of any number of clips
needs no shuffle; a clip is bounded by its two bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions import music as M
from notefold.functions.ids import bound
from notefold.runtime import tables


ARTICULATION = 0.02


def ordered_notes() -> Column:
    """The notes of a clip by start and end, without those that lack a time or a pitch."""
    whole = F.filter(F.coalesce("notes", F.array().cast("array<struct<start:double,end:double,pitch:int,velocity:int>>")), lambda x: x["start"].isNotNull() & x["end"].isNotNull() & x["pitch"].isNotNull())
    return F.sort_array(F.transform(whole, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity"))))


def excerpts(clips: DataFrame) -> DataFrame:
    """Per clip: ``ev`` (notes by start, end), the frame and the flags on which questions depend.

    Input columns: ``sample_id, notes, meter, bpm, music_start, bar_dur``. Null notes are left out;
    an incomplete frame makes the frame flags false and grid values null; no notes give empty ``ev``."""
    d = clips.withColumn("s", ordered_notes()).withColumn("n", F.size("s"))
    d = d.withColumn("bpb", M.table(M.BEATS_PER_BAR, F.col("meter"))).withColumn("spb", F.try_divide(F.lit(60.0), F.col("bpm").cast("double")))
    d = d.withColumn("line", F.col("music_start") + F.col("bar_dur")).withColumn("piece_end", F.col("music_start") + 2 * F.col("bar_dur"))
    edge = F.col("music_start") + F.col("bar_dur") - M.FRAME_TOL
    bar = lambda x: F.when(x["start"] < edge, 1).otherwise(2)
    d = d.withColumn("start1", F.array_min(F.transform(F.filter("s", lambda x: bar(x) == 1), lambda x: x["start"])))
    d = d.withColumn("start2", F.array_min(F.transform(F.filter("s", lambda x: bar(x) == 2), lambda x: x["start"])))
    pitches = F.sort_array(F.array_distinct(F.transform("s", lambda x: x["pitch"])))
    facts = F.struct(F.col("s"), pitches.alias("pitches"), *[F.col(c) for c in ("start1", "start2", "spb", "piece_end")], edge.alias("edge"))

    def notes(k: Column) -> Column:
        def note(x: Column, i: Column) -> Column:
            here = F.when(x["start"] < k["edge"], 1).otherwise(2)
            pos = (x["start"] - F.when(x["start"] < k["edge"], k["start1"]).otherwise(k["start2"])) / k["spb"]
            ioi = F.coalesce(F.get(k["s"], i + 1)["start"], k["piece_end"]) - x["start"]
            low = F.array_position(k["pitches"], x["pitch"]).cast("int")
            return F.struct(
                i.alias("i"), x["start"].alias("start"), x["end"].alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity"), here.alias("bar"),
                pos.alias("pos"), (F.rint(pos * 2) / 2).alias("grid"), ioi.alias("ioi"), bound(ioi / k["spb"], M.nearest_value).alias("value"),
                (x["pitch"] - F.get(k["s"], i - 1)["pitch"]).alias("move"), F.pmod(x["pitch"], F.lit(12)).alias("pc"),
                low.alias("low_rank"), (F.size(k["pitches"]) + 1 - low).alias("high_rank"),
            )

        return F.transform(k["s"], note)

    # bound: a column named once inside a lambda would else be inlined there and worked out for every note
    d = d.withColumn("ev", bound(facts, notes))
    safe_last = F.when(F.col("n") > 0, F.try_element_at("ev", F.lit(-1))["end"])
    d = d.withColumn("ultra_short", F.exists("s", lambda x: x["end"] - x["start"] < M.SHORTEST_NOTE))
    d = d.withColumn("overlap", F.exists("ev", lambda x: x["end"] > F.get("s", x["i"] + 1)["start"] + 1e-4))
    d = d.withColumn("overlap", F.coalesce("overlap", F.lit(False)))
    d = d.withColumn("bar_ambiguous", F.coalesce(F.exists("s", lambda x: (x["start"] > F.col("line") - 0.16) & (x["start"] < F.col("line") - 0.04)), F.lit(False)))
    clear = (F.abs(F.col("start1") - F.col("music_start")) <= M.FRAME_TOL) & (F.abs(F.col("start2") - F.col("line")) <= M.FRAME_TOL) & ~F.col("bar_ambiguous")
    d = d.withColumn("frame_clear", F.coalesce(clear, F.lit(False)))
    d = d.withColumn("grid_ok", F.coalesce((F.col("n") > 0) & F.forall("ev", lambda x: F.abs(x["pos"] - x["grid"]) <= M.GRID_TOL), F.lit(False)))
    gaps = F.forall("ev", lambda x: F.coalesce(F.get("s", x["i"] + 1)["start"] - x["end"] <= M.REST_TOL, F.lit(True)))
    ends = F.coalesce(F.abs(F.col("piece_end") - safe_last) <= M.END_TOL, F.lit(False))
    d = d.withColumn("end_ok", ends).withColumn("rest_free", (F.col("n") > 1) & gaps & ends)
    d = d.withColumn("frame_full", F.col("frame_clear") & F.col("end_ok"))
    d = d.withColumn("values_ok", F.col("rest_free") & F.forall("ev", lambda x: x["value"].isNotNull()))
    d = d.withColumn("usable", ~F.col("ultra_short") & ~F.col("overlap") & F.col("start1").isNotNull() & F.col("start2").isNotNull())
    return d.drop("s", "notes")


def quantised(clips: DataFrame) -> DataFrame:
    """Clips laid on the half-beat grid of two exact bars from their first note on.

    Each note moves to its nearest half-beat (halves to even), notes beyond the two bars are left
    out, of notes at one place the lowest stays, and each lasts to just before the next onset or the end."""
    beats, half = M.table(M.BEATS_PER_BAR, F.col("meter")), F.try_divide(F.lit(60.0), F.col("bpm").cast("double")) / 2
    first = F.array_min(F.transform("notes", lambda x: x["start"]))
    d = clips.withColumn("k", F.struct(F.col("notes"), first.alias("ms"), half.alias("half"), beats.alias("bpb"), (beats * 2 * half).alias("bar_dur")))

    def laid(k: Column) -> Column:
        at = F.transform(k["notes"], lambda x: F.struct(F.rint((x["start"] - k["ms"]) / k["half"]).cast("int").alias("g"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity")))
        start = lambda g: k["ms"] + g * k["half"]
        one = lambda g: F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1)["g"] != x["g"]))
        end = lambda u, i: F.coalesce(start(F.get(u, i + 1)["g"]), k["ms"] + 2 * k["bar_dur"]) - ARTICULATION
        timed = lambda u: F.transform(u, lambda x, i: F.struct(start(x["g"]).alias("start"), end(u, i).alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity")))
        return bound(F.sort_array(F.filter(at, lambda x: (x["g"] >= 0) & (x["g"] < 4 * k["bpb"]))), lambda g: bound(one(g), timed))

    return d.withColumn("notes", bound(F.col("k"), laid)).withColumn("music_start", F.col("k.ms")).withColumn("bar_dur", F.col("k.bar_dur")).drop("k")


#: guards of operators that need bars on a beat grid
ON_GRID = "usable and frame_clear and grid_ok"


def indices(cond) -> Column:
    """Numbers of the notes that meet a condition, in order."""
    return F.transform(F.filter("ev", lambda x: cond(x)), lambda x: x["i"])


def answered(guard: str | Column, value: Column) -> Column:
    """A value only where it can be asked for: null is "not answerable", an empty list an answer."""
    return F.when(F.expr(guard) if isinstance(guard, str) else guard, value)


def in_bar(b) -> Column:
    return F.filter("ev", lambda x: x["bar"] == b)


# -- rhythm --------------------------------------------------------------------------------------
def bar_initial_notes() -> Column:
    return answered("usable and frame_clear", indices(lambda x: (x["i"] == 0) | ((x["bar"] == 2) & (F.get("ev", x["i"] - 1)["bar"] == 1))))


def notes_on_beat(k) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return answered(F.expr(ON_GRID) & (k >= 1) & (k <= F.col("bpb")), indices(lambda x: x["grid"] == k - 1))


def notes_at_bar_middle() -> Column:
    return answered(ON_GRID, indices(lambda x: x["grid"] == F.col("bpb") / 2))


def notes_in_second_half(b=None) -> Column:
    return answered(ON_GRID, indices(lambda x: (x["grid"] >= F.col("bpb") / 2) & (F.lit(True) if b is None else x["bar"] == b)))


def notes_with_value(v) -> Column:
    return answered(ON_GRID + " and values_ok", indices(lambda x: x["value"] == v))


def value_name(v: Column) -> Column:
    return F.when(F.col("meter") == "6/8", M.table(M.VALUE_NAMES_COMPOUND, v)).otherwise(M.table(M.VALUE_NAMES_SIMPLE, v))


def metric_weight(h: Column) -> Column:
    """Strength of a half-beat of the bar: first beat, middle of four, other beats, off-beats."""
    return F.when(h == 0, F.when(F.col("meter") == "4/4", 4).otherwise(3)).when((F.col("meter") == "4/4") & (h == 4), 3).when(h % 2 == 0, 2).otherwise(1)


def syncopated_notes() -> Column:
    """Notes that begin on a weaker half-beat and sound on through a stronger one; null for the whole
    clip if one is neither clearly held nor clearly over, and in compound meter."""
    wide = F.col("bpb") * 2

    def crossings(x):
        a = (x["bar"] - 1) * wide + F.rint(x["grid"] * 2).cast("int")
        q = a + 2 * x["ioi"] / F.col("spb")
        steps = F.sequence(a + 1, F.greatest(a + 1, F.ceil(q).cast("int") + 1))
        strong = F.filter(steps, lambda s: metric_weight(F.pmod(s, wide)) > metric_weight(F.rint(x["grid"] * 2).cast("int")))
        return F.transform(strong, lambda s: (q - s) / 2)

    each = F.transform("ev", lambda x: F.struct(x["i"].alias("i"), crossings(x).alias("c")))
    blurred = F.exists(each, lambda e: F.exists(e["c"], lambda c: (c > M.SYNC_LOW) & (c < M.SYNC_HIGH)))
    held = F.transform(F.filter(each, lambda e: F.exists(e["c"], lambda c: c >= M.SYNC_HIGH)), lambda e: e["i"])
    ok = F.expr(ON_GRID + " and values_ok and meter in ('2/4', '3/4', '4/4')")
    return F.when(ok, F.when(~blurred, held))


def longest_note_of_bar(b: int, ratio: float = 1.3) -> Column:
    """The note with the longest way to the next onset, if it leads the runner-up by the ratio."""
    order = F.reverse(F.sort_array(F.transform(in_bar(b), lambda x: F.struct(x["ioi"].alias("ioi"), (-x["i"]).alias("j")))))
    return answered(F.expr("usable and not bar_ambiguous and rest_free") & (F.size(order) >= 2), F.when(F.get(order, F.lit(0))["ioi"] >= ratio * F.get(order, F.lit(1))["ioi"], -F.get(order, F.lit(0))["j"]))


def shortest_notes_per_bar() -> Column:
    q = F.col("bpb") / F.array_min(F.transform("ev", lambda x: x["value"]))
    return answered(ON_GRID + " and values_ok", F.when(F.abs(q - F.rint(q)) < 1e-9, q.cast("int")))


def measured_tempo() -> Column:
    """Beats per minute from the least-squares slope of onsets over grid positions of both bars."""
    n = F.col("n").cast("double")
    xs = lambda x: (x["bar"] - 1) * F.col("bpb") + x["grid"]
    total = lambda f: F.aggregate("ev", F.lit(0.0), lambda a, x: a + f(x))
    mx, mt = total(xs) / n, total(lambda x: x["start"]) / n
    means = F.struct(mx.alias("x"), mt.alias("t"))
    slope = bound(means, lambda m: F.try_divide(total(lambda x: (xs(x) - m["x"]) * (x["start"] - m["t"])), total(lambda x: (xs(x) - m["x"]) * (xs(x) - m["x"]))))
    return answered(F.expr(ON_GRID) & (F.col("n") >= 4), F.when(slope > 0, F.try_divide(F.lit(60.0), slope)))


def tempo_consistent() -> Column:
    return F.coalesce(F.abs(measured_tempo() - F.col("bpm")) <= M.TEMPO_TOL, F.lit(False))


def beat_name(g: Column) -> Column:
    k = (F.floor(g) + 1).cast("string")
    return F.when(g % 1 == 0, F.concat(F.lit("beat "), k)).otherwise(F.concat(F.lit("the second half of beat "), k))


# -- tonality and intervals ------------------------------------------------------------------------
def scale(root: int | Column) -> Column:
    r = F.lit(root) if isinstance(root, int) else root
    return F.sort_array(F.transform(F.array(*[F.lit(s) for s in M.MAJOR_STEPS]), lambda s: F.pmod(r + s, F.lit(12))))


def played() -> Column:
    return F.sort_array(F.array_distinct(F.transform("ev", lambda x: x["pc"])))


def notes_outside_scale(root) -> Column:
    return indices(lambda x: ~F.array_contains(scale(root), x["pc"]))


def never_played(root) -> Column:
    return F.array_except(scale(root), played())


def notes_reached_by(lo: int, hi: int | None = None) -> Column:
    return indices(lambda x: (F.abs(x["move"]) >= lo) & (F.lit(True) if hi is None else F.abs(x["move"]) <= hi))


def notes_reached_by_named(semitones, way: str | None = None) -> Column:
    side = {None: lambda m: F.lit(True), "ascending": lambda m: m > 0, "descending": lambda m: m < 0}[way]
    return indices(lambda x: (F.abs(x["move"]) == semitones) & side(x["move"]))


def repeated_notes() -> Column:
    return indices(lambda x: x["move"] == 0)


def downward_notes() -> Column:
    return indices(lambda x: x["move"] < 0)


def largest_jump() -> Column:
    return F.array_max(F.transform("ev", lambda x: F.abs(x["move"])))


def count_moves_of(semitones) -> Column:
    return F.size(F.filter("ev", lambda x: F.abs(x["move"]) == semitones))


def pitch_rank_notes(rank, highest: bool = True) -> Column:
    return indices(lambda x: x["high_rank" if highest else "low_rank"] == rank)


# -- bars ------------------------------------------------------------------------------------------
def last_notes_of_bars() -> Column:
    return F.filter(F.array(F.array_max(F.transform(in_bar(1), lambda x: x["i"])), F.array_max(F.transform(in_bar(2), lambda x: x["i"]))), lambda i: i.isNotNull())


def bar_extreme(b: int, highest: bool = True) -> Column:
    f = F.array_max if highest else F.array_min
    return f(F.transform(in_bar(b), lambda x: x["pitch"]))


def triad_of_bar(b: int, cover: float = 0.9) -> Column:
    """The bar's only fitting triad as ``root, kind, pcs``; null if there is none."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: F.size(F.filter("ev", lambda x: (x["bar"] == b) & (x["pc"] == p))))
    return bound(counts, lambda c: M.triads_of(c, F.size(in_bar(b)), cover))


def notes_not_in_other_triad(b: int, triad: Column, other: Column) -> Column:
    return answered(triad.isNotNull() & other.isNotNull(), indices(lambda x: (x["bar"] == b) & ~F.array_contains(other["pcs"], x["pc"])))


def triad_member_notes(b: int, triad: Column, member: str) -> Column:
    at = {"root": 0, "third": 1, "fifth": 2}[member]
    return answered(triad.isNotNull(), indices(lambda x: (x["bar"] == b) & (x["pc"] == F.get(triad["pcs"], F.lit(at)))))


def bar_differences() -> Column:
    """Pitch of each note of bar 2 less that of the note at its place in bar 1; null unless both have as many."""
    a, b = in_bar(1), in_bar(2)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.zip_with(a, b, lambda x, y: y["pitch"] - x["pitch"]))


def bar_shift(d: Column) -> Column:
    return F.when(F.array_min(d) == F.array_max(d), F.get(d, F.lit(0)))


def bar2_notes_differing() -> Column:
    a, b = in_bar(1), in_bar(2)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.filter(F.zip_with(a, b, lambda x, y: F.when(x["pitch"] != y["pitch"], y["i"])), lambda i: i.isNotNull()))


def drop_back_notes(b: int) -> Column:
    low = bar_extreme(b, False)
    return F.when(F.size(in_bar(b)) < 2, F.array().cast("array<int>")).otherwise(indices(lambda x: (x["bar"] == b) & (x["pitch"] == low) & (x["move"] < 0) & (F.get("ev", x["i"] - 1)["bar"] == b)))


def arpeggio_kind(b: int) -> Column:
    """ascending (low mid high ...) or updown (low mid high mid ...) from the ranks of exactly three pitches; null else."""
    pit = F.sort_array(F.array_distinct(F.transform(in_bar(b), lambda x: x["pitch"])))
    ranks = F.transform(in_bar(b), lambda x: (F.array_position(pit, x["pitch"]) - 1).cast("int"))

    def shaped(r):
        like = lambda cycle: F.transform(r, lambda _, k: F.get(F.array(*[F.lit(c) for c in cycle]), k % len(cycle)))
        return F.when(r == like((0, 1, 2)), "ascending").when(r == like((0, 1, 2, 1)), "updown")

    return F.when((F.size(in_bar(b)) >= 4) & (F.size(pit) == 3), bound(ranks, shaped))


def arpeggio_first_cycle(b: int, kind: Column) -> Column:
    first = F.transform(in_bar(b), lambda x: x["i"])
    return F.when(kind == "ascending", F.slice(first, 1, 3)).when(kind == "updown", F.slice(first, 1, 4))


def spans(idx: Column) -> Column:
    """Start and end of the named notes, in order of their numbers."""
    return F.transform(F.sort_array(idx), lambda i: F.struct(F.get("ev", i)["start"].alias("s"), F.get("ev", i)["end"].alias("e")))


def frames_of(span_list: Column) -> Column:
    """Spans as frame numbers, at least one frame long; halves round to even."""
    f = lambda x: F.rint(F.round(x, 6) * M.FRAMES_PER_SECOND).cast("int")
    return F.transform(span_list, lambda s: F.array(f(s["s"]), F.greatest(f(s["e"]), f(s["s"]) + 1)))


# -- the project's clips ---------------------------------------------------------------------------
def clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_clips(tables(spark, sf_dir)("clips"))


def as_clips(c: DataFrame) -> DataFrame:
    """Rows of the clips table in the form :func:`excerpts` takes."""
    return c.select("sample_id", "split", "notes", F.col("basic_info.time_signature").alias("meter"), F.col("basic_info.tempo_bpm").alias("bpm"), F.col("basic_info.music_start_sec").alias("music_start"), F.col("basic_info.bar_duration_sec").alias("bar_dur"))


def clip_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excerpts(clip_rows(spark, sf_dir))


def grid_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excerpts(quantised(clip_rows(spark, sf_dir)))


def text(idx: Column) -> Column:
    """Note numbers as text, for results that are compared across engines."""
    return F.array_join(F.transform(idx, lambda i: i.cast("string")), ",")
