"""Question records: candidates put into words, and what a question has to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions import wording as W
from notefold.operators import candidates as C
from notefold.operators import excerpt as E


def parameter(name: str, params: str | Column = "params") -> Column:
    """The value of a parameter of a candidate, null if it has none of that name."""
    found = F.regexp_extract(params, rf"(?:^|;){name}=([^;]*)", 1)
    return F.nullif(found, F.lit(""))


def rendered(cands: DataFrame, number: bool = True) -> DataFrame:
    """Candidates with ``context, question, variants, answers, box``: three variants of the question, three styles of the answer, spans as tokens.

    Grounding answers are spans; others are numbers, labels, lists or yes/no. Choices among wordings are drawn from hashes of clip, family,
    sub-question and parameters, so equal candidates read alike wherever they are rendered."""
    seed = [F.col("sample_id"), F.col("fam"), F.col("sub"), F.col("params")]
    d = cands.withColumn("context", C.context_flags(F.col("fam"))).withColumn("_t", W.spans_text("spans"))
    plural = ~F.col("fam").isin(C.SINGULAR)
    kind = F.when(F.col("kind") == "grounding", "grounding").when(F.col("gtype") == "boolean", "boolean").when(F.col("fam").isin(C.COUNTED), "count").otherwise("value")
    text = W.context_sentences(F.col("context"), F.col("meter"), F.col("bpm"), *seed) if number else F.lit("")
    listed = F.array_join(F.from_json("gold", "array<string>"), ", ")
    unit = F.when(F.col("fam").isin("I-U2", "B-U3", "H-U2", "Rp-U1"), "semitones").when(F.col("fam") == "I-U1", "moves").when(F.col("fam") == "A-U1", "times").when(F.col("fam") == "T-U3", "note names").otherwise("notes")
    answers = (
        F.when(F.col("kind") == "grounding", W.grounding_answers(F.col("_t"), F.col("what"), plural)).when(F.col("gtype") == "boolean", W.yesno_answers(F.col("gold") == "true"))
        .when(F.col("gtype") == "integer", W.numeric_answers(F.col("gold").cast("int"), unit)).when(F.col("gtype") == "sequence", W.label_answers(F.coalesce(listed, F.lit(""))))
        .otherwise(W.label_answers(F.regexp_replace("gold", r"\.0$", "")))
    )
    d = d.withColumn("variants", W.question(kind, F.col("what"), plural, text, *seed)).withColumn("answers", answers)
    return d.withColumn("question", F.get("variants", F.lit(0))).withColumn("box", W.box_token(E.frames_of(F.col("spans")))).drop("_t")


def broken_contract(clip: bool = True) -> Column:
    """Names of the rules a rendered record breaks: what its question must and must not say.

    With ``clip`` the record has its notes (``ev``) and flags, and references are checked against them."""
    q, fam, ctx, meter = F.col("question"), F.col("fam"), F.col("context"), F.col("meter")
    says = lambda c: F.contains(q, c)
    has = lambda name: F.array_contains(ctx, name)
    is_ = lambda *names: fam.isin(*names)
    p = parameter
    value_of = F.replace(F.element_at(F.split("sub", "="), -1), F.lit("_"), F.lit(" "))
    up, down = q.rlike(r"\b(ascending|above|rising)\b"), q.rlike(r"\b(descending|below|falling)\b")
    length = is_("R-G4", "R-G5", "R-G6", "R-U3") | (is_("R-U4") & (p("ref_kind") == "longest"))
    framed = has("frame")
    rules = [
        (has("meter") & ~says(meter), "meter_missing"), (has("tempo") & ~says(F.col("bpm").cast("string")), "tempo_missing"), (~has("tempo") & q.rlike(r"\b[0-9]+\s*(bpm|beats per minute)"), "tempo_not_flagged"),
        (p("set").isNotNull() & ~says(p("set")), "set_missing"), (is_("R-G2") & ~says(F.concat(F.lit("beat "), p("k"))), "beat_missing"),
        (is_("I-U1", "I-G4") & ~says(F.concat(p("semitones"), F.lit(" semitone"))), "semitones_missing"), (is_("I-G4") & ((up == down) | (up != (p("direction") == "ascending"))), "direction_wrong"),
        (is_("I-G7", "I-U3") & ~says(p("direction")) & ~q.rlike("higher|lower"), "direction_missing"), (is_("R-G4") & ~says(value_of), "value_missing"), (is_("R-U3", "R-U4") & ~says(F.lit("note")), "note_missing"),
        (is_("R-U4") & ~says(F.concat(F.lit("the "), p("ref_kind"), F.lit(" note of the "), F.when(p("bar") == "1", "first").otherwise("second"), F.lit(" bar"))), "reference_missing"),
        (framed & ~says(F.lit("equally long")), "frame_missing"), (framed & q.rlike(r"[0-9]+\.[0-9][0-9] s"), "time_in_bar_question"), (is_("H-U2") & ~says(F.lit("pitch class")), "pitch_class_missing"),
        (is_("R-G5") & (~meter.isin("2/4", "3/4", "4/4") | ~has("metric") | ~says(F.concat(F.lit("In "), meter, F.lit(" the ")))), "weights_missing"), (has("meter") & ~q.rlike("beat 1 of|first beat"), "first_beat_missing"),
        (is_("R-G2", "R-U4") & ~has("tempo"), "tempo_needed"), ((meter == "6/8") & has("unit") & ~says(F.lit("eighth note)")), "unit_wrong"), ((meter != "6/8") & has("unit") & ~says(F.lit("quarter note)")), "unit_wrong"),
        (q.rlike(r"start of the (next|following) note|next note's start|last note of the clip"), "note_length_defined"),
    ]
    if clip:
        one = F.get("ev", p("note_index").cast("int"))
        onset = F.format_string("%.2f", F.round(F.round(one["start"], 6), 2))
        crowd = F.size(F.filter("ev", lambda x: F.abs(x["start"] - one["start"]) < 0.05)) > 1
        rules += [
            (length & ~F.col("rest_free"), "length_with_rests"), (framed & ~F.col("frame_full"), "frame_not_true"), (is_("R-U3") & ~says(onset), "time_wrong"), (is_("R-U3") & crowd, "time_ambiguous"),
            (is_("R-U4") & (F.size("idx") != 1), "reference_ambiguous"),
        ]
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))


def broken_short() -> Column:
    """The rules for clips of one to three notes."""
    q, fam = F.col("question"), F.col("fam")
    pitches = F.forall(F.split(F.coalesce(parameter("vals"), F.lit("")), ","), lambda v: F.contains(q, v))
    rules = [
        ((fam == "A-PITCH") & ~pitches, "pitch_missing"), ((fam == "P-PDIFF") & ~F.contains(q, F.concat(parameter("delta"), F.lit(" semitone"))), "delta_missing"), ((fam == "R-VEL") & ~q.rlike("loud|soft|quiet"), "dynamics_missing"),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))


def contract_counts(records: DataFrame, broken: Column) -> DataFrame:
    """``fam, n, broken`` of rendered records."""
    return records.withColumn("_b", F.size(broken) > 0).groupBy("fam").agg(F.count("*").alias("n"), F.count_if("_b").alias("broken"))
