"""Questions and answers as text; choices among wordings are drawn from hashes of the record."""

from __future__ import annotations

import functools
import math
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STEMS = ["Show by start and end where {what} {is}.", "At what times {do} {what} sound?", "List the seconds covered by {what}.", "Point out {what} on the timeline.", "From when to when {is} {what} heard?", "State every stretch of time taken by {what}."]
COUNTS = ["Say how many {what} the clip has.", "What do you count for {what}?", "Give one number for {what}.", "How often {do} {what} come?", "Tell the total of {what}."]
VALUES = ["State {what}.", "Find {what} and name it.", "What do you get for {what}?", "Give {what} as a short answer.", "Tell {what} after listening to the clip."]
YESNO = ["Decide {what}: yes or no.", "Listen and tell {what}; say yes or no.", "Answer yes or no to this: {what}.", "Find out {what}, then say yes or no."]
TEMPOS = ["Take {x} beats per minute.", "Beats pass at {x} beats per minute.", "The pulse is {x} bpm.", "Count about {x} bpm."]
METERS = ["Two bars of {x} begin with the first note, which is the first beat{unit}.", "Read the clip as two bars in {x} whose first beat is the first note{unit}."]
FRAMES = ["Two equally long bars run from the start of the first note to the end of the last note.", "The clip is cut into two equally long bars, the first note opening one and the last note closing the other."]
WEIGHTS = ["In {x} the places of a bar weigh as follows, heaviest first: {order}.", "In {x} the weight of the places falls in this order: {order}."]
TRIADS = ["Each bar is the arpeggio of one major or minor triad."]
ROOTS = ["A root is meant as a pitch class, whatever octave it sounds in."]
PAIRS = ["Pair the notes of the two bars in order, the first with the first and so on."]
PLACES = {"2/4": "beat 1, beat 2, the halves between", "3/4": "beat 1, beats 2 and 3, the halves between", "4/4": "beat 1, beat 3, beats 2 and 4, the halves between"}
# fixed values: what scoring takes as saying that there is none
NOTHING = ["none", "There is no such note in this clip.", "No matching note was found in this clip."]


def pick(pool: list[str], *seed: Column) -> Column:
    """One wording of a pool, by hash."""
    return F.get(F.array(*[F.lit(p) for p in pool]), F.pmod(F.xxhash64(*seed), F.lit(len(pool))).cast("int"))


def several(pool: list[str], k: int, *seed: Column) -> Column:
    """``k`` different wordings of a pool, in hash order."""
    order = F.sort_array(F.array(*[F.struct(F.md5(F.concat_ws("|", *seed, F.lit(str(i)))).alias("h"), F.lit(p).alias("p")) for i, p in enumerate(pool)]))
    return F.transform(F.slice(order, 1, k), lambda x: x["p"])


def filled(text: Column, what: Column, plural: Column) -> Column:
    """A wording with its places filled; verbs agree in number."""
    t = F.replace(F.replace(text, F.lit("{do}"), F.when(plural, "do").otherwise("does")), F.lit("{is}"), F.when(plural, "are").otherwise("is"))
    return F.replace(t, F.lit("{what}"), what)


def question(kind: Column, what: Column, plural: Column, context: Column, *seed: Column) -> Column:
    """Three variants of a question, all with the context before (in three of five) or after. ``kind``: grounding, count, boolean or value."""
    pools = {"grounding": STEMS, "count": COUNTS, "boolean": YESNO}
    variants = F.coalesce(*[F.when(kind == k, several(pool, 3, *seed)) for k, pool in pools.items()], several(VALUES, 3, *seed))
    first = F.pmod(F.xxhash64(*seed, F.lit("place")), F.lit(5)) < 3
    one = lambda v: filled(v, what, plural)
    return F.transform(variants, lambda v: F.when(context == "", one(v)).when(first, F.concat_ws(" ", context, one(v))).otherwise(F.concat_ws(" ", one(v), context)))


def context_sentences(flags: Column, meter: Column, bpm: Column, *seed: Column) -> Column:
    """The sentences the flags ask for, in order: meter (with the unit of a beat if flagged), tempo, weights, frame, triads, roots, pairs; an empty text for none."""
    has = lambda name: F.array_contains(flags, name)
    unit = F.when(has("unit"), F.when(meter == "6/8", " (one beat is an eighth note)").otherwise(" (one beat is a quarter note)")).otherwise("")
    put = lambda pool, **k: functools.reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), k.items(), pick(pool, *seed, F.lit(pool[0])))
    order = F.coalesce(*[F.when(meter == m, places) for m, places in PLACES.items()], F.lit(""))
    return F.concat_ws(
        " ", F.when(has("meter"), put(METERS, x=meter, unit=unit)), F.when(has("tempo"), put(TEMPOS, x=bpm.cast("string"))), F.when(has("metric"), put(WEIGHTS, x=meter, order=order)),
        F.when(has("frame"), put(FRAMES)), F.when(has("triads"), put(TRIADS)), F.when(has("roots"), put(ROOTS)), F.when(has("pairs"), put(PAIRS)),
    )


def label_answers(text: Column) -> Column:
    """A label or a list of names alone, as a phrase and as a sentence; an empty text stands for none."""
    t = F.when(text == "", "none").otherwise(text)
    return F.array(t, F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)), F.lit(".")), F.concat(F.lit("The answer is "), t, F.lit(".")))


def yesno_answers(yes: Column) -> Column:
    word = F.when(yes, "yes").otherwise("no")
    return F.array(word, F.when(yes, "Yes.").otherwise("No."), F.when(yes, "Yes, that is so.").otherwise("No, that is not so."))


def two_places(x: float | None) -> str | None:
    """A number with two decimals, rounded from its exact binary value, halves to even."""
    if x is None or not math.isfinite(x):
        return None if x is None else str(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN))
    return f"{x:.2f}"  # Python formats the exact binary value too, and rounds halves to even


@F.arrow_udf(StringType())
def spans_text(spans: pa.Array) -> pa.Array:
    """Spans as ``start|end;...`` with exact two-decimal times; JVM formats round the decimal text instead."""
    starts, ends = (x.to_pylist() for x in spans.flatten().flatten())
    each, at, out = [f"{two_places(s)}|{two_places(e)}" for s, e in zip(starts, ends)], 0, []
    for n in spans.value_lengths().to_pylist():  # lists that are null have no spans in the flat ones
        out.append(None if n is None else ";".join(each[at : at + n]))
        at += n or 0
    return pa.array(out, pa.string())


def grounding_answers(text: Column, what: Column, plural: Column) -> Column:
    """Three styles of a span answer from the text of ``spans_text``; the three phrases for none if it is empty."""
    each = F.transform(F.split(text, ";"), lambda s: F.split(s, r"\|"))
    upper = F.concat(F.upper(F.substring(what, 1, 1)), F.substr(what, F.lit(2)))
    a = F.array_join(F.transform(each, lambda p: F.concat(F.lit("["), F.get(p, F.lit(0)), F.lit("s, "), F.get(p, F.lit(1)), F.lit("s]"))), "; ")
    named = lambda w: F.array_join(F.transform(each, lambda p: F.concat(F.lit(w), F.get(p, F.lit(0)), F.lit(" seconds to "), F.get(p, F.lit(1)), F.lit(" seconds"))), "; ")
    texts = F.array(a, F.concat(named("From "), F.lit(".")), F.concat(upper, F.when(plural, " are").otherwise(" is"), F.lit(" heard as follows: "), named("from "), F.lit(".")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(*[F.lit(n) for n in NOTHING])).otherwise(texts)


def numeric_answers(n: Column, unit: Column) -> Column:
    """Digits, a phrase and a sentence; the unit loses its s for one."""
    u = F.when((F.abs(n) == 1) & (unit != "bpm"), F.regexp_replace(unit, "s$", "")).otherwise(unit)
    phrase = F.trim(F.concat_ws(" ", n.cast("string"), F.nullif(u, F.lit(""))))
    return F.array(n.cast("string"), phrase, F.concat(F.lit("The answer is "), phrase, F.lit(".")))


def box_token(spans: Column) -> Column:
    """Frame spans as ``<box>a,b</box>`` tokens."""
    return F.array_join(F.transform(spans, lambda s: F.concat(F.lit("<box>"), F.get(s, F.lit(0)).cast("string"), F.lit(","), F.get(s, F.lit(1)).cast("string"), F.lit("</box>"))), "")
