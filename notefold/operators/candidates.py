"""Question families: one clip in, typed candidate rows out.

A family is a function from an analysed clip to an array of candidates; the registries at the end
name them. All arrays of a clip are joined and exploded once, so candidates cost one pass over
the clips and no shuffle."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions import music as M
from notefold.functions.ids import bound
from notefold.operators import excerpt as E
from notefold.operators import short_clips as S
from notefold.operators.stability import MORE
from notefold.operators.stability import SCHEMA as STABLE
from notefold.operators.stability import stable_batches

COVER = 0.9
JITTER = 0.005  # seconds to either side
CAND = (
    "array<struct<fam:string,sub:string,params:string,kind:string,concept:string,cat:string,akey:string,stratum:string,"
    "idx:array<int>,gold:string,gtype:string,what:string,joined:boolean>>"
)
BARS = "usable and frame_full"  # families that name a bar: two equal bars from the first note to the last must be true
TEMPO = "tempo_ok"
BOOLEAN = ("B-U4", "H-U3", "T-U5")  # families of yes/no answers
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth"]  # fixed values
FIELDS = ["fam", "sub", "params", "kind", "concept", "cat", "akey", "stratum", "idx", "gold", "gtype", "what", "joined"]


_wanted: ContextVar[tuple] = ContextVar("wanted", default=tuple(FIELDS))  # the fields that are worked out; others are null


def _s(x) -> Column:
    return F.lit(x) if isinstance(x, (str, int, float, bool)) else x


def cand(fam: str, kind: str, concept: str, cat: str, sub, akey, idx, what, stratum="", gold=None, gtype=None, params="", joined=False) -> Column:
    """One candidate. ``params``: what the question names, as ``name=value;...``; ``joined``: its notes are one span."""
    none = F.lit(None).cast("string")
    gold, gtype = none if gold is None else gold.cast("string"), none if gtype is None else F.lit(gtype)
    values = [fam, _s(sub).cast("string"), _s(params).cast("string"), kind, concept, cat, _s(akey).cast("string"), _s(stratum).cast("string"), idx, gold, gtype, _s(what), _s(joined)]
    return F.struct(*[(_s(v) if name in _wanted.get() else F.lit(None)).alias(name) for name, v in zip(FIELDS, values)])


def _when(guard, items: Column) -> Column:
    """An array of candidates where the guard holds; those whose list of notes is null are not asked."""
    g = F.expr(guard) if isinstance(guard, str) else guard
    return F.when(F.coalesce(g, F.lit(False)), F.filter(items, lambda c: c["idx"].isNotNull())).otherwise(F.array().cast(CAND))


def _params(values, f) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in values]), f)


def _cat(*parts) -> Column:
    return F.concat(*[_s(p).cast("string") for p in parts])


def _empty(idx: Column, name) -> Column:
    return _cat(name, F.when(F.size(idx) == 0, "_empty").otherwise(""))


def _bucket(n: Column, top: int = 3) -> Column:
    return F.when(n >= top, f"{top}+").otherwise(n.cast("string"))


def _or_empty(idx: Column, top: int = 3) -> Column:
    return F.when(F.size(idx) == 0, "empty").otherwise(_bucket(F.size(idx), top))


def _yes(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def _bar_length() -> Column:
    return F.format_string("bar%.2f", "bar_dur")


def _of(b: int) -> Column:
    return E.indices(lambda x: x["bar"] == b)


def _all() -> Column:
    return F.transform("ev", lambda x: x["i"])


def rhythm_grounding() -> list[Column]:
    g = lambda fam, cat, *a, **k: cand(fam, "grounding", "rhythm", cat, *a, **k)
    longest = lambda b: F.when(E.longest_note_of_bar(b).isNotNull(), F.array(E.longest_note_of_bar(b)))
    name = E.value_name

    def on_beat(k):
        what = _cat("the notes on beat ", k)
        return bound(E.notes_on_beat(k), lambda i: g("R-G2", "ORD", _cat("beat=", k), _empty(i, _cat("k", k)), i, what, _cat("meter", F.col("meter"), "|k", k), params=_cat("k=", k)))

    def valued(v):
        sub = _cat("value=", F.replace(name(v), F.lit(" "), F.lit("_")))
        return bound(E.notes_with_value(v), lambda i: g("R-G4", "ABS", sub, _empty(i, name(v)), i, _cat("the ", name(v), "s"), _cat("meter", F.col("meter"), "|v", v), params=_cat("value_beats=", v)))

    sync = F.expr(TEMPO) & F.expr("meter in ('2/4', '3/4', '4/4')")
    return [
        _when(BARS, F.array(g("R-G1", "ORD", "bar_start", "bar_start", E.bar_initial_notes(), "the notes that open a bar"))),
        _when(TEMPO, _params(range(1, 7), on_beat)),
        _when(BARS, F.array(bound(E.notes_at_bar_middle(), lambda i: g("R-G3", "ORD", "bar_middle", _empty(i, "mid"), i, "the notes halfway through a bar")))),
        _when(TEMPO, _params((0.5, 1.0, 1.5, 2.0), valued)),
        _when(sync, F.array(bound(E.syncopated_notes(), lambda i: g("R-G5", "PAT", "syncopated", _empty(i, "sync"), i, "the syncopated notes")))),
        _when(BARS, F.array(*[g("R-G6", "ABS", f"longest_bar={b}", f"bar{b}", longest(b), f"the longest note of the {ORDINALS[b - 1]} bar", params="min_ratio=1.3") for b in (1, 2)])),
    ]


def _value_of(x: Column) -> Column:
    """R-U3: the value of one note, which the question names by its onset."""
    name, at = E.value_name(x["value"]), F.round(F.round(x["start"], 6), 2)
    stratum = _cat("meter", F.col("meter"), "|t", F.floor(at / 0.5).cast("int"))
    what = F.format_string("the value of the note that starts at %.2f seconds", at)
    return cand("R-U3", "understanding", "rhythm", "ABS", "note_value", name, F.array(x["i"]), what, stratum, name, "class_label", _cat("note_index=", x["i"]))


def rhythm_understanding() -> list[Column]:
    u = lambda fam, cat, *a, **k: cand(fam, "understanding", "rhythm", cat, *a, **k)
    ok = F.expr(TEMPO) & F.expr(E.ON_GRID)
    # five notes of a clip in hash order, none whose onset is near the border of two decimals
    clear = F.filter(F.col("ev"), lambda x: F.abs(F.pmod(F.round(x["start"], 6) * 100, F.lit(1.0)) - 0.5) >= 0.05)
    order = F.sort_array(F.transform(clear, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit("refs"), "sample_id", x["i"].cast("string"))).alias("h"), x["i"].alias("i"), x["start"].alias("start"), x["value"].alias("value"))))
    refs = F.slice(order, 1, 5)

    def extreme(b, name):
        rank = {"highest": lambda x: x["pitch"], "lowest": lambda x: -x["pitch"]}
        if name == "longest":
            one = F.when(E.longest_note_of_bar(b).isNotNull(), F.array(E.longest_note_of_bar(b)))
        else:
            top = F.array_max(F.transform(E.in_bar(b), rank[name]))
            notes = E.indices(lambda x: (x["bar"] == b) & (rank[name](x) == top))
            one = F.when(F.size(notes) == 1, notes)
        pos = F.get("ev", F.get(one, F.lit(0)))["grid"] + 1.0
        akey = F.when(pos % 1 == 0, pos.cast("int").cast("string")).otherwise(pos.cast("string"))
        what = f"the {name} note of the {ORDINALS[b - 1]} bar"
        what = f"the beat position, in half beats from 1 at the start of the bar, of {what}"
        return u("R-U4", "ORD", "beat_position", akey, one, what, _cat("meter", F.col("meter"), f"|{name}{b}"), pos, "number", f"bar={b};ref_kind={name}")

    half1 = E.notes_in_second_half(1)
    return [
        _when(ok & F.col("values_ok"), F.transform(refs, _value_of)),
        _when(ok & ~F.col("bar_ambiguous"), F.array(*[extreme(b, n) for b in (1, 2) for n in ("highest", "lowest", "longest")])),
        _when(BARS, F.array(bound(half1, lambda i: u("R-U6", "ORD", "second_half_bar1", F.size(i), i, "notes in the second half of the first bar", _bar_length(), F.size(i), "integer")))),
    ]


def tonality() -> list[Column]:
    c = lambda fam, kind, *a, **k: cand(fam, kind, "tonality", "ABS", *a, **k)
    u = "understanding"
    names = lambda pcs: F.transform(pcs, M.note_name)
    members = lambda r: F.array_join(names(E.scale(r)), ", ")
    named = lambda r: _cat("set=", members(r))
    told = lambda text, r: _cat(text, members(r))

    def of_root(r):
        out = lambda i: F.array(
            c("T-G1", "grounding", "outside_set", _bucket(F.size(i)), i, told("the notes outside the set ", r), params=named(r)),
            c("T-U1", u, "count_outside", _bucket(F.size(i), 4), i, told("notes outside the set ", r), "", F.size(i), "integer", named(r)),
            c("T-U5", u, "all_in_set", _yes(F.size(i) == 0), F.when(F.size(i) == 0, _all()).otherwise(i), told("whether all notes are in the set ", r), "", F.size(i) == 0, "boolean", named(r)),
            bound(E.never_played(r), lambda m: c("T-U2", u, "never_played", _bucket(F.size(m)), _all(), told("every name that is never played of the set ", r), "", F.to_json(names(m)), "sequence", named(r))),
        )
        return bound(E.notes_outside_scale(r), out)

    return [
        _when("usable", F.flatten(_params(range(12), of_root))),
        _when("usable", bound(E.played(), lambda p: F.array(
            c("T-U3", u, "distinct_names", F.size(p), _all(), "different note names", "", F.size(p), "integer"),
            c("T-U4", u, "list_names", F.size(p), _all(), "the note names from C upwards", "", F.to_json(names(p)), "sequence")))),
    ]


def _semitones(s: Column) -> Column:
    return F.when(s == 1, " semitone").otherwise(" semitones")


def intervals() -> list[Column]:
    c = lambda fam, kind, cat, *a, **k: cand(fam, kind, "interval", cat, *a, **k)
    g, u, two = "grounding", "understanding", "usable and n >= 2"

    def sized(fam, lo, hi, what):
        return bound(E.notes_reached_by(lo, hi), lambda i: c(fam, g, "REL", f"move={lo}-{hi or 'up'}", _or_empty(i), i, what, params=f"lo={lo}" + (f";hi={hi}" if hi else "")))

    def named(way):
        one = lambda s, i: c("I-G4", g, "REL", _cat(f"named={way}_", s), _empty(i, _cat("s", s)), i, _cat(f"the notes reached by {'an' if way == 'ascending' else 'a'} {way} move of ", s, _semitones(s)), params=_cat("semitones=", s, f";direction={way}"))
        return _params(range(1, 13), lambda s: bound(E.notes_reached_by_named(s, way), lambda i: one(s, i)))

    def ranked(r, which):
        what = f"the {'' if r == 1 else 'second '}{which} notes"
        return bound(E.pitch_rank_notes(r, which == "highest"), lambda i: c("I-G6", g, "ABS", f"pitch_rank={which}{r}", _empty(i, f"{which}{r}"), i, what, params=f"rank={r};which={which}"))

    def counted(s):
        return bound(E.notes_reached_by_named(s), lambda i: c("I-U1", u, "REL", "count_semitones", _bucket(F.size(i)), i, _cat("moves of ", s, _semitones(s)), _cat("N", s), F.size(i), "integer", _cat("semitones=", s)))

    ways = (("upward", E.indices(lambda x: x["move"] > 0)), ("downward", E.downward_notes()))
    jump = E.largest_jump()
    tied = bound(jump, lambda j: F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter("ev", lambda x: F.abs(x["move"]) == j), lambda x: F.array(x["i"] - 1, x["i"]))))))
    return [
        _when(two, F.array(sized("I-G1", 1, 2, "the notes reached by one or two semitones"), sized("I-G2", 3, 5, "the notes reached by three to five semitones"), sized("I-G3", 6, None, "the notes reached by six semitones or more"))),
        _when(two, named("ascending")), _when(two, named("descending")),
        _when(two, F.array(bound(E.repeated_notes(), lambda i: c("I-G5", g, "REL", "repeated", F.when(F.size(i) == 0, "empty").otherwise("rep"), i, "the notes that repeat the pitch before")))),
        _when(two, F.array(*[ranked(r, w) for r in (1, 2) for w in ("highest", "lowest")])),
        _when(two, F.array(*[bound(i, lambda v, d=d: c("I-G7", g, "REL", f"move={d}", _empty(v, d), v, f"the notes reached by a move {d}", params=f"direction={d}")) for d, i in ways])),
        _when(two, _params(range(1, 9), counted)),
        _when(two, F.array(c("I-U2", u, "REL", "largest_jump", jump, tied, "the size of the largest move in semitones", "", jump, "integer"))),
        _when(two, F.array(*[bound(i, lambda v, d=d: c("I-U3", u, "REL", f"count_{d}", _cat(d, "_", _bucket(F.size(v), 4)), v, f"{d} moves", d, F.size(v), "integer", f"direction={d}")) for d, i in ways])),
    ]


def bars() -> list[Column]:
    c = lambda fam, kind, cat, *a, **k: cand(fam, kind, "bar_comparison", cat, *a, **k)
    g, u = "grounding", "understanding"
    more = F.size(E.in_bar(2)) - F.size(E.in_bar(1))
    high = lambda h: E.bar_extreme(2, h) - E.bar_extreme(1, h)
    first = lambda h: F.array(*[F.get(E.indices(lambda x, b=b: (x["bar"] == b) & (x["pitch"] == E.bar_extreme(b, h))), F.lit(0)) for b in (1, 2)])
    return [
        _when(BARS, F.array(*[c("B-G1", g, "ORD", f"bar_span={b}", f"bar{b}", _of(b), f"the {ORDINALS[b - 1]} bar", joined=True) for b in (1, 2)])),
        _when(BARS, F.array(c("B-G2", g, "ORD", "last_note_of_bars", "last", E.last_notes_of_bars(), "the last note of each bar"))),
        _when(BARS, F.array(*[bound(_of(b), lambda i, b=b: c("B-U1", u, "ORD", f"notes_in_bar={b}", F.size(i), i, f"notes in the {ORDINALS[b - 1]} bar", _bar_length(), F.size(i), "integer")) for b in (1, 2)])),
        _when(BARS, F.array(c("B-U2", u, "ORD", "note_count_difference", more, _all(), "how many notes more the second bar has (negative if fewer)", "", more, "integer"))),
        _when(BARS, F.array(*[c("B-U3", u, "ABS", f"{n}_difference", high(h), first(h), f"the semitones from the {n} note of the first bar up to that of the second (negative if down)", "", high(h), "integer") for n, h in (("highest", True), ("lowest", False))])),
        _when(BARS, F.array(c("B-U4", u, "ORD", "second_bar_more_notes", _yes(more > 0), _all(), "whether the second bar has more notes", "", more > 0, "boolean"))),
    ]


TRIADS = BARS + " and triad1 is not null and triad2 is not null"  # harmony and its patterns are asked of clips with two clear triads


# what a question of a family has to say beside its parameters
CONTEXT = {
    **{f: ["meter", "unit", "tempo"] for f in ("R-G2", "R-G4", "R-U3", "R-U4")}, "R-G5": ["meter", "unit", "tempo", "metric"],
    **{f: ["frame"] for f in ("R-G1", "R-G3", "R-G6", "R-U6", "B-G1", "B-G2", "B-U1", "B-U2", "B-U3", "B-U4")},
    **{f: ["frame", "triads"] for f in ("H-G1", "H-G2", "H-U1", "H-U3", "A-G1", "A-G2", "A-U1", "A-U2")}, "H-U2": ["frame", "triads", "roots"],
    **{f: ["frame", "pairs"] for f in ("Rp-G1", "Rp-G2", "Rp-U1", "Rp-U2")},
}
COUNTED = ["R-U6", "T-U1", "T-U3", "I-U1", "I-U3", "B-U1", "A-U1", "Rp-U2"]  # families whose answer counts what is named
SINGULAR = ["R-G6", "B-G1", "B-G2", "A-G2", "O-NOTE", "R-VEL"]


def context_flags(fam: Column) -> Column:
    """Names of the context sentences of a family."""
    known = F.create_map(*[x for f, flags in CONTEXT.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in flags]))])
    return F.coalesce(F.try_element_at(known, fam), F.array().cast("array<string>"))


def harmony() -> list[Column]:
    c = lambda fam, kind, *a, **k: cand(fam, kind, "harmony", "REL", *a, **k)
    t1, t2, g, u = F.col("triad1"), F.col("triad2"), "grounding", "understanding"
    name = lambda t: F.concat_ws(" ", M.note_name(t["root"]), t["kind"])
    motion = F.pmod(t2["root"] - t1["root"], F.lit(12))
    same = (t1["root"] == t2["root"]) & (t1["kind"] == t2["kind"])
    members = [(b, t, m) for b, t in ((1, t1), (2, t2)) for m in ("root", "third", "fifth")]
    return [
        _when(TRIADS, F.array(bound(E.notes_not_in_other_triad(2, t2, t1), lambda i: c("H-G1", g, "bar2_not_in_bar1_triad", _or_empty(i), i, "the notes of bar 2 that are not in the triad of bar 1")))),
        _when(TRIADS, F.array(*[bound(E.triad_member_notes(b, t, m), lambda i, b=b, m=m: c("H-G2", g, f"triad_{m}_bar={b}", _empty(i, m), i, f"the {m}s of the {ORDINALS[b - 1]} bar's triad")) for b, t, m in members])),
        _when(TRIADS, F.array(*[c("H-U1", u, f"triad_of_bar={b}", name(t), _of(b), f"the triad of the {ORDINALS[b - 1]} bar", "", name(t), "class_label") for b, t in ((1, t1), (2, t2))])),
        _when(TRIADS, F.array(c("H-U2", u, "root_motion_up", motion, _all(), "the semitones upwards from the root of the first bar to that of the second", "", motion, "integer"))),
        _when(TRIADS, F.array(c("H-U3", u, "same_triad", _yes(same), _all(), "whether both bars have the same triad", "", same, "boolean"))),
    ]


def patterns() -> list[Column]:
    c = lambda fam, kind, *a, **k: cand(fam, kind, "harmonic_pattern", "PAT", *a, **k)
    g, u, meter = "grounding", "understanding", _cat("meter", F.col("meter"))
    out = []
    for b, k in ((1, F.col("kind1")), (2, F.col("kind2"))):
        bar = f"the {ORDINALS[b - 1]} bar"
        label = F.when(k == "updown", "up-and-down").otherwise(k)
        out += [
            _when(TRIADS, F.array(bound(E.drop_back_notes(b), lambda i, b=b, bar=bar: c("A-G1", g, f"drop_back_bar={b}", _or_empty(i), i, f"the notes of {bar} that drop back to its lowest", meter, params=f"bar={b}")))),
            _when(TRIADS, F.array(bound(E.drop_back_notes(b), lambda i, b=b, bar=bar: c("A-U1", u, f"drops_to_lowest_bar={b}", F.size(i), i, f"returns to the lowest note in {bar}", meter, F.size(i), "integer")))),
            _when(TRIADS, F.array(c("A-G2", g, f"first_cycle_bar={b}", k, E.arpeggio_first_cycle(b, k), f"the first cycle of {bar}'s arpeggio", params=f"bar={b}", joined=True))),
            _when(TRIADS, F.array(c("A-U2", u, f"pattern_bar={b}", k, F.when(k.isNotNull(), _of(b)), f"the shape of {bar}'s arpeggio", "", label, "class_label"))),
        ]
    return out


def repetition() -> list[Column]:
    c = lambda fam, kind, *a, **k: cand(fam, kind, "repetition", "PAT", *a, **k)
    g, u, d = "grounding", "understanding", F.col("bar_d")
    differ = E.bar2_notes_differing()
    same = F.when(d.isNotNull(), F.array_except(_of(2), differ))
    n, shift = F.size(F.filter(d, lambda v: v != 0)), E.bar_shift(d)
    return [
        _when(BARS, F.array(bound(differ, lambda i: c("Rp-G1", g, "bar2_pitch_differs", _or_empty(i), i, "the notes of bar 2 that differ from bar 1")))),
        _when(BARS, F.array(bound(same, lambda i: c("Rp-G2", g, "bar2_pitch_same", _or_empty(i), i, "the notes of bar 2 that are as in bar 1")))),
        _when(BARS, F.array(c("Rp-U1", u, "transposition", shift, F.when(shift.isNotNull(), _all()), "the semitones by which bar 2 is moved against bar 1 (negative if down)", "", shift, "integer"))),
        _when(BARS, F.array(c("Rp-U2", u, "n_pitch_differences", n, differ, "places at which the bars differ", "", n, "integer"))),
    ]


GENERATORS = {"rhythm_grounding": rhythm_grounding, "rhythm_understanding": rhythm_understanding, "tonality": tonality, "intervals": intervals, "bars": bars, "harmony": harmony, "patterns": patterns, "repetition": repetition}


def candidates(ex: DataFrame, generators: list[str] | None = None, cover: float = COVER, also: tuple = ()) -> DataFrame:
    """All candidates of analysed clips, ``sample_id, split, meter, bpm`` and the fields of ``CAND`` with the spans of their notes; ``also`` names more columns of the clip to keep."""
    d, every = listed(ex, generators, cover)
    out = d.select(*dict.fromkeys(["sample_id", "split", "meter", "bpm", "ev", *also]), F.explode(every).alias("c"))
    spans = E.spans(F.col("c.idx"))
    one = F.array(F.struct(F.get("ev", F.array_min("c.idx"))["start"].alias("s"), F.get("ev", F.array_max("c.idx"))["end"].alias("e")))
    return out.select("sample_id", "split", "meter", "bpm", *also, "c.*", F.when(F.col("c.joined"), one).otherwise(spans).alias("spans"))


def listed(ex: DataFrame, generators: list[str] | None, cover: float, fields: tuple = tuple(FIELDS)) -> tuple[DataFrame, Column]:
    """Analysed clips and the array of their candidates, which is exploded as an expression: filters inferred from a column of it would work it out again.

    Fields of a candidate that are not in ``fields`` are null, as Spark works out all of a struct in a lambda."""
    d = ex.withColumn("tempo_ok", E.tempo_consistent()).withColumn("triad1", E.triad_of_bar(1, cover)).withColumn("triad2", E.triad_of_bar(2, cover))
    d = d.withColumn("kind1", E.arpeggio_kind(1)).withColumn("kind2", E.arpeggio_kind(2)).withColumn("bar_d", E.bar_differences())
    token = _wanted.set(fields)
    try:
        every = [a.cast(CAND) for name in generators or GENERATORS for a in GENERATORS[name]()]
    finally:
        _wanted.reset(token)
    return d, F.flatten(F.array(*every))


# -- clips of one to three notes ---------------------------------------------------------------------
def short_candidates(ph: DataFrame) -> DataFrame:
    """Candidates of phrases (``sample_id, phrase, v``): nine families over pitches, order, loudness, pairs and patterns.

    Absent pitches and distances to ask for are taken in hash order of clip and value."""
    g = lambda fam, cat, concept, sub, akey, idx, what, params="": cand(fam, "grounding", concept, cat, sub, akey, idx, what, params=params)
    uid = F.concat_ws("|", F.lit("short"), F.col("sample_id"), F.col("phrase").cast("string"))
    have = F.sort_array(F.array_distinct(F.transform("v", lambda x: x["pitch"])))
    some = lambda u, values: F.transform(F.slice(F.sort_array(F.transform(values, lambda p: F.struct(F.md5(F.concat_ws("|", u, p.cast("string"))).alias("h"), p.alias("p")))), 1, 3), lambda s: s["p"])
    notes_at = lambda vals: S.numbers(lambda x, i: F.array_contains(vals, x["pitch"]))

    def sets(have, drawn, absent):
        only = lambda n, one: F.when(F.size(have) >= n, F.array(one)).otherwise(F.array().cast("array<array<int>>"))
        mixed = F.array(F.concat(F.slice(drawn, 1, 1), F.slice(absent, 1, 1)), F.slice(absent, 1, 2), F.concat(F.slice(drawn, 1, 2), F.slice(absent, 2, 1)))
        return F.concat(F.transform(have, lambda p: F.array(p)), only(2, F.slice(drawn, 1, 2)), only(3, have), F.transform(absent, lambda p: F.array(p)), mixed)

    listed = lambda vals, by: F.array_join(F.transform(F.sort_array(vals), lambda p: p.cast("string")), by)
    # bound: each draw sorts hashes of up to 88 pitches, and sets name it several times
    pools = lambda u, have: F.struct(have.alias("have"), some(u, have).alias("drawn"), some(u, F.array_except(F.sequence(F.lit(21), F.lit(108)), have)).alias("absent"))
    every = bound(uid, lambda u: bound(have, lambda h: bound(pools(u, h), lambda k: sets(k["have"], k["drawn"], k["absent"]))))
    pitch = F.transform(every, lambda vals: bound(notes_at(vals), lambda i: g("A-PITCH", "ABS", "pitch", "vals", _cat("k", F.size(vals), "_h", F.size(i)), i, _cat("the notes at ", listed(vals, " or ")), _cat("vals=", listed(vals, ",")))))
    order = F.array(*[bound(i, lambda v, n=n: g("O-NOTE", "ORD", "note", f"idx={n}", _empty(v, n), v, f"the {n} note")) for n, i in (("first", S.ordinal(1)), ("second", S.ordinal(2)), ("third", S.ordinal(3)), ("last", S.last()))])
    ranges = F.array(*[g("O-RANGE", "ORD", "note", n, n, F.when(F.size("v") >= 2, i), f"the {w} two notes") for n, w, i in (("prefix", "first", S.prefix(2)), ("suffix", "last", S.suffix(2)))])
    rel = F.array(*[bound(F.when(F.size("v") >= 2, S.pitch_rank(r, h)), lambda v, n=n: g("R-PITCH", "REL", "pitch", f"rank={n}", _empty(v, n), v, f"the {n} notes")) for n, r, h in (("highest", 1, True), ("lowest", 1, False), ("second_highest", 2, True), ("second_lowest", 2, False))])
    vel = F.array(*[g("R-VEL", "REL", "velocity", f"rank={n}", n, i, f"the {n} note") for n, i in (("loudest", S.extreme_velocity(True)), ("softest", S.extreme_velocity(False)), ("second_loudest", S.second_loudest()))])
    pair = F.array(g("P-PAIR", "PAT", "pair", "pitch_closest", "pitch_closest", S.closest_pitch_pair(), "the two notes closest in pitch"), g("P-PAIR", "PAT", "pair", "time_closest", "time_closest", S.closest_time_pair(), "the two notes closest in time"))
    wanted = lambda gaps: F.concat(F.filter(F.array_distinct(gaps), lambda x: x.between(1, 24) & (F.size(F.filter(gaps, lambda y: y == x)) == 1)), bound(uid, lambda u: some(u, F.array_except(F.sequence(F.lit(1), F.lit(24)), gaps))))
    apart = lambda pairs: F.transform(bound(F.transform(pairs, lambda p: p["d"]), wanted), lambda x: F.struct(x.alias("x"), F.sort_array(F.array_distinct(F.flatten(S.pairs_with_delta(x, pairs)))).alias("i")))
    diff = F.when(F.size("v") >= 2, F.transform(bound(S.pair_distances(), apart), lambda k: bound(k, lambda k: (lambda x, i: g("P-PDIFF", "PAT", "pitch_diff", "delta", F.concat(F.lit("d"), F.when(x <= 12, x.cast("string")).otherwise("13-24"), F.when(F.size(i) == 0, "_empty").otherwise("")), i, F.concat(F.lit("the two notes "), x.cast("string"), F.lit(" semitones apart")), _cat("delta=", x)))(k["x"], k["i"]))))
    whole, none = F.array(F.lit(0), F.lit(1), F.lit(2)), F.array().cast("array<int>")
    shape = lambda fam, concept, by, fact, names: F.when(fact.isNotNull(), F.array(*[bound(F.when(fact == n, whole).otherwise(none), lambda v, n=n: g(fam, "PAT", concept, f"{by}={n}", _empty(v, n), v, f"the part that goes {n}")) for n in names]))
    arrays = [pitch, order, ranges, rel, vel, pair, diff, shape("P-CONTOUR", "contour", "pitch", S.contour(), ("up-up", "up-down", "down-up", "down-down")), shape("P-INT", "int", "order", S.interval_trend(), ("widen", "narrow", "same"))]
    none_at_all = F.array().cast(CAND)
    d = ph.where(F.size("v") > 0).select("sample_id", "phrase", "v", F.explode(F.flatten(F.array(*[F.coalesce(a.cast(CAND), none_at_all) for a in arrays]))).alias("c"))
    return d.where("c.idx is not null").select("sample_id", "phrase", "v", "c.*")


def jittered(clips: DataFrame, draws: int = 10, width: float = JITTER) -> DataFrame:
    """Each clip ``draws`` times with every onset and end moved by up to ``width`` seconds, fixed by clip, draw and note.

    A note ends no later than the next begins, as jitter must not create overlaps, and lasts 50 ms at least."""
    whole = F.filter("notes", lambda x: x["start"].isNotNull() & x["end"].isNotNull() & x["pitch"].isNotNull())
    d = clips.withColumn("notes", F.sort_array(whole)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = lambda i, what: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(what), F.col("sample_id"), F.col("draw").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1) * width
    moved = F.transform("notes", lambda x, i: F.struct((x["start"] + u(i, "s")).alias("start"), (x["end"] + u(i, "e")).alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity")))
    end = lambda m, x, i: F.greatest(F.least(x["end"], F.get(m, i + 1)["start"]), x["start"] + 0.05)
    return d.withColumn("notes", bound(moved, lambda m: F.transform(m, lambda x, i: F.struct(x["start"].alias("start"), end(m, x, i).alias("end"), x["pitch"].alias("pitch"), x["velocity"].alias("velocity")))))


def stable(clips: DataFrame, generators: list[str] | None = None, draws: int = 10, cover: float = COVER, fields: tuple = tuple(k for k in STABLE if k != "notes")) -> DataFrame:
    """Candidates that every jittered copy of their clip gives too, with the same notes and answer: the ``fields`` of ``STABLE`` or ``MORE``.

    Equal rows of clips count once; rows of a clip that differ are versions of it, each compared with its own copies
    (as :func:`jittered` makes them). A clip is compared inside its row, so nothing but the clips is shuffled; they are small
    and take long, so they are spread over all partitions."""
    parts = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = clips.withColumn("version", F.xxhash64(*clips.columns)).repartition(parts, "version").dropDuplicates().select("sample_id", E.ordered_notes().alias("notes"), "meter", F.col("bpm").cast("double").alias("bpm"), *[F.col(c).cast("double").alias(c) for c in ("music_start", "bar_dur")], _bar_length().alias("bar_length"))
    return d.mapInArrow(lambda batches: stable_batches(batches, generators, draws, JITTER, cover, fields), ", ".join(f"{k} {(STABLE | MORE)[k]}" for k in fields))
