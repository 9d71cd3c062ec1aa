"""Fixed tables of the domain and expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
BEATS_PER_BAR = {"2/4": 2, "3/4": 3, "4/4": 4, "6/8": 6}
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_STEPS = [0, 2, 4, 5, 7, 9, 11]
TRIADS = {"major": [0, 4, 7], "minor": [0, 3, 7]}
NOTE_VALUES = [0.5, 1.0, 1.5, 2.0, 3.0]
VALUE_NAMES_SIMPLE = {0.5: "eighth note", 1.0: "quarter note", 1.5: "dotted quarter note", 2.0: "half note", 3.0: "dotted half note"}
VALUE_NAMES_COMPOUND = {0.5: "sixteenth note", 1.0: "eighth note", 1.5: "dotted eighth note", 2.0: "quarter note", 3.0: "dotted quarter note"}
LENGTH_NAMES = {0.5: "eighth", 1.0: "quarter", 1.5: "dotted_quarter", 2.0: "half"}
SCALES = {"major": [0, 2, 4, 5, 7, 9, 11], "natural_minor": [0, 2, 3, 5, 7, 8, 10], "chromatic": list(range(12))}
CHORD_DEGREES = {
    "major": {"I": [0, 2, 4], "IV": [3, 5, 0], "V": [4, 6, 1], "vi": [5, 0, 2]},
    "natural_minor": {"i": [0, 2, 4], "iv": [3, 5, 0], "v": [4, 6, 1], "VI": [5, 0, 2]},
}
FRAME_TOL = 0.10
SHORTEST_NOTE = 0.10
GRID_TOL = 0.18
REST_TOL = 0.06
END_TOL = 0.06
TEMPO_TOL = 3.0
SYNC_LOW, SYNC_HIGH = 0.10, 0.35
VELOCITY_MARGIN = 24
GAP_MARGIN = 0.15
INTERVAL_MARGIN = 2
FRAMES_PER_SECOND = 75


def table(values: dict, key: Column) -> Column:
    """The value of a small fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def note_name(pitch_class: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in NOTE_NAMES]), F.pmod(pitch_class, F.lit(12)))


def nearest_value(beats: Column) -> Column:
    """The note value nearest to a length, the smaller of two equally near; null if further off than ``GRID_TOL``."""
    best = F.array_min(F.transform(F.array(*[F.lit(v) for v in NOTE_VALUES]), lambda v: F.struct(F.abs(v - beats).alias("off"), v.alias("value"))))
    return F.when(best["off"] <= GRID_TOL, best["value"])


def interval_class(semitones: Column) -> Column:
    """Size class of a move: repeat, step (1-2), skip (3-5), leap."""
    a = F.abs(semitones)
    return F.when(a == 0, "repeat").when(a <= 2, "step").when(a <= 5, "skip").when(a > 5, "leap")


def duration_symbol(beats: Column) -> Column:
    """Name of a length in beats to the thousandth: a note value, else short, medium or long."""
    r = F.round(beats, 3)
    named = F.coalesce(*[F.when(F.abs(r - v) < 1e-9, name) for v, name in LENGTH_NAMES.items()])
    return F.coalesce(named, F.when(r < 1.0, "short").when(r < 2.0, "medium").when(r >= 2.0, "long"))


def scale_classes(mode: Column, tonic: Column) -> Column:
    """Sorted pitch classes of a scale; null for an unknown mode."""
    steps = F.coalesce(*[F.when(mode == m, F.array(*[F.lit(s) for s in v])) for m, v in SCALES.items()])
    return F.sort_array(F.transform(steps, lambda s: F.pmod(s + tonic, F.lit(12)).cast("int")))


def chord_classes(mode: Column, tonic: Column, chord: Column) -> Column:
    """Sorted pitch classes of a chord named by its degree; the tonic chord for a name the mode has not, all twelve for an unknown mode."""
    of = lambda m, degrees: F.array(*[F.lit(SCALES[m][d]) for d in degrees])
    by = F.coalesce(*[F.when(mode == m, F.coalesce(*[F.when(chord == c, of(m, d)) for c, d in chords.items()], of(m, next(iter(chords.values()))))) for m, chords in CHORD_DEGREES.items()], F.array(*[F.lit(k) for k in range(12)]))
    return F.sort_array(F.transform(by, lambda s: F.pmod(s + tonic, F.lit(12)).cast("int")))


def pitches_within(low: Column, high: Column, classes: Column) -> Column:
    """The pitches from low to high whose class is one of ``classes``."""
    return F.when(low <= high, F.filter(F.sequence(low, high), lambda p: F.array_contains(classes, F.pmod(p, F.lit(12)).cast("int")))).otherwise(F.array().cast("array<int>"))


def nearest_of_class(center: Column, cls: Column, low: Column, high: Column) -> Column:
    """The pitch of a class nearest to ``center`` in a range, the lower of two; null if there is none."""
    return F.array_min(F.transform(pitches_within(low, high, F.array(F.pmod(cls, F.lit(12)).cast("int"))), lambda p: F.struct(F.abs(p - center).alias("off"), p.alias("pitch"))))["pitch"]


def direction(semitones: Column) -> Column:
    return F.when(semitones > 0, "up").when(semitones < 0, "down").otherwise("same")


def triads_of(counts_by_class: Column, total: Column, cover: float) -> Column:
    """The (root, kind) of the only triad with all members played and at least ``cover`` of the notes.

    ``counts_by_class`` is an array of 12 counts. Null with fewer than 3 notes or with no or several triads."""
    all_of = F.array(*[F.struct(F.lit(r).alias("root"), F.lit(k).alias("kind"), F.array(*[F.lit((r + s) % 12) for s in steps]).alias("pcs")) for r in range(12) for k, steps in TRIADS.items()])
    inside = lambda t: F.aggregate(t["pcs"], F.lit(0), lambda a, p: a + F.get(counts_by_class, p))
    fits = F.filter(all_of, lambda t: F.forall(t["pcs"], lambda p: F.get(counts_by_class, p) > 0) & (inside(t) >= cover * total))
    return F.when((total >= 3) & (F.size(fits) == 1), F.get(fits, F.lit(0)))
