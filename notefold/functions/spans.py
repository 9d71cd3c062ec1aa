"""Time spans: parsing, overlap, merging, matching, as column expressions over arrays of structs s, e."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notefold.functions.ids import bound

# fixed values: the form of a span in an answer, and what says that there is none
SPAN = r"(?i)([0-9]*\.?[0-9]+)\s*second[s]?\s*to\s*([0-9]*\.?[0-9]+)\s*second[s]?"
ABSTENTIONS = ["none", "there is no such note in this clip", "no matching note was found in this clip", "no time span"]
NO_SPANS = "array<struct<s:double,e:double>>"


def parse_spans(text: Column) -> Column:
    """Every span a text names; an end before its start counts as the start. Null text has none."""
    t = F.coalesce(text, F.lit(""))
    return F.zip_with(F.regexp_extract_all(t, F.lit(SPAN), F.lit(1)), F.regexp_extract_all(t, F.lit(SPAN), F.lit(2)), lambda a, b: F.struct(a.cast("double").alias("s"), F.greatest(a.cast("double"), b.cast("double")).alias("e")))


def is_abstention(text: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.trim(F.regexp_replace(t, r"\.+$", "")).isin(ABSTENTIONS)


def from_pairs(pairs: Column) -> Column:
    """Spans from arrays of two numbers."""
    return F.coalesce(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("s"), F.get(p, F.lit(1)).alias("e"))), F.array().cast(NO_SPANS))


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]))


def iou(a: Column, b: Column) -> Column:
    """Length in common over length together; 0 where that is 0."""
    return bound(overlap(a, b), lambda o: bound(F.greatest(F.lit(0.0), (a["e"] - a["s"]) + (b["e"] - b["s"]) - o), lambda u: F.when(u > 0, o / u).otherwise(0.0)))


def merged(spans: Column) -> Column:
    """Spans joined where they overlap or touch."""

    def put(acc, x):
        top = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["s"].alias("s"), F.greatest(top["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= top["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(NO_SPANS), put)


def length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda a, x: a + (x["e"] - x["s"]))


def merged_iou(p: Column, g: Column) -> Column:
    """Overlap of two merged span sets over their union; 0 if both are empty."""
    both = F.struct(merged(p).alias("p"), merged(g).alias("g"))

    def of(m):
        inter = F.aggregate(m["p"], F.lit(0.0), lambda a, x: a + F.aggregate(m["g"], F.lit(0.0), lambda c, y: c + overlap(x, y)))
        return bound(inter, lambda i: bound(length(m["p"]) + length(m["g"]) - i, lambda u: F.when(u > 0, i / u).otherwise(0.0)))

    return bound(both, of)


def greedy_match(p: Column, g: Column, least: float) -> Column:
    """Pairs taken one by one, the highest overlap ratio first, ties by the lower numbers, each span once,
    down to ``least``: structs pi, gi, iou, onset and offset error."""
    pairs = F.flatten(F.transform(p, lambda a, i: F.transform(g, lambda b, j: F.struct((-iou(a, b)).alias("v"), i.alias("pi"), j.alias("gi"), F.abs(a["s"] - b["s"]).alias("onset"), F.abs(a["e"] - b["e"]).alias("offset")))))
    order = F.array_sort(F.filter(pairs, lambda x: -x["v"] >= least))
    none = F.array().cast("array<struct<v:double,pi:int,gi:int,onset:double,offset:double>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["pi"] == x["pi"]) | (y["gi"] == x["gi"]))
    return F.aggregate(order, none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
