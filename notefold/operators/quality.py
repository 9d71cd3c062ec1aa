"""Integrity flags, statistics and quality gates over clips and question records."""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions import music as M
from notefold.functions import spans as S
from notefold.functions.ids import bound
from notefold.runtime import cut

def _list(*flags: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for c, name in flags]))


def derived_attributes(ev: str = "ev") -> list[Column]:
    """Counts per bar, range, means, interval classes, turns and whether a cell of move and length comes back, of one clip.

    A length is from onset to end in beats; lengths are equal if they round to the same thousandth. Means of no notes are 0."""
    moves = F.filter(F.transform(ev, lambda x: x["move"]), lambda m: m.isNotNull())
    mean = lambda f: F.coalesce(F.try_divide(F.aggregate(ev, F.lit(0.0), lambda a, x: a + f(x)), F.size(ev)), F.lit(0.0))
    ways = F.filter(F.transform(moves, lambda m: F.signum(m).cast("int")), lambda m: m != 0)
    turns = F.size(F.filter(F.transform(ways, lambda m, i: m != F.get(ways, i - 1)), lambda v: v))
    cls = lambda name: F.size(F.filter(moves, lambda m: M.interval_class(m) == name)).alias(name + "s")
    p = F.transform(ev, lambda x: x["pitch"])
    beats = F.struct(F.col(ev).alias("ev"), F.col("spb"))
    cells = bound(beats, lambda k: F.transform(F.slice(k["ev"], F.lit(2), F.greatest(F.size(k["ev"]) - 1, F.lit(0))), lambda x, i: F.struct(x["move"], F.floor((F.get(k["ev"], i)["end"] - F.get(k["ev"], i)["start"]) / k["spb"] * 1000 + 0.5).alias("length"))))
    motif = (F.size(ev) >= 4) & bound(cells, lambda c: F.size(F.array_distinct(c)) < F.size(c))
    return [
        F.size(ev).alias("notes"), F.size(F.filter(ev, lambda x: x["bar"] == 1)).alias("notes1"), F.size(F.filter(ev, lambda x: x["bar"] == 2)).alias("notes2"),
        F.coalesce(F.array_min(p), F.lit(0)).alias("low"), F.coalesce(F.array_max(p), F.lit(0)).alias("high"), F.coalesce(F.array_max(p) - F.array_min(p), F.lit(0)).alias("span"),
        F.size(F.array_distinct(p)).alias("different"), (F.size(F.array_distinct(p)) < F.size(p)).alias("repeated_pitch"), mean(lambda x: (x["end"] - x["start"]) / F.col("spb")).alias("mean_beats"),
        mean(lambda x: x["velocity"]).alias("mean_velocity"), cls("step"), cls("skip"), cls("leap"), turns.alias("turns"), motif.alias("motif"),
    ]


def motifs(clips: DataFrame) -> DataFrame:
    """Moves that come back after the same length of the note before: ``sample_id, move, value, n``.

    Counted inside the row of a clip, as its notes are there; lengths that are no note value are left out."""
    cells = bound(F.col("ev"), lambda ev: F.transform(ev, lambda x, i: F.struct(x["move"].alias("move"), F.get(ev, i - 1)["value"].alias("value"))))
    whole = F.filter(cells, lambda c: c["move"].isNotNull() & c["value"].isNotNull())
    counted = bound(whole, lambda w: F.transform(F.array_distinct(w), lambda c: F.struct(c["move"].alias("move"), c["value"].alias("value"), F.size(F.filter(w, lambda y: y == c)).cast("long").alias("n"))))
    return clips.select("sample_id", F.inline(F.filter(counted, lambda c: c["n"] > 1)))


def reason_tally(rows: DataFrame, reasons: str, top: int = 30) -> DataFrame:
    """The most frequent reasons; ties by name."""
    n = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "reason").limit(top)


def value_shares(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value, n, share`` of every value of the fields, in long form."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    n = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("field")))


def dominant_values(rows: DataFrame, fields: list[str], limit: float = 0.65) -> DataFrame:
    return value_shares(rows, fields).where(F.col("share") > limit)


def numeric_summary(rows: DataFrame, fields: list[str]) -> DataFrame:
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])))
    return long.groupBy("field").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"))


def length_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Least, mean, median, 95th percentile and most, with interpolated exact percentiles."""
    return rows.groupBy(group).agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("most"))


def pitch_coverage(notes: DataFrame) -> DataFrame:
    """How often each of the 88 keys is played, those never played with 0."""
    keys = notes.sparkSession.range(21, 109).select(F.col("id").cast("int").alias("pitch"))
    n = notes.groupBy("pitch").agg(F.count("*").alias("n"))
    return keys.join(n, "pitch", "left").select("pitch", F.coalesce("n", F.lit(0)).alias("n"))


# -- gates -----------------------------------------------------------------------------------------
def majority_share(rows: DataFrame, group: list[str], cls: str, yesno: Column, exempt: Column | None = None, least: int = 200) -> DataFrame:
    """The share of the most frequent class per group against its limit.

    The limit is 0.55 where all classes are yes/no, else 1.5 over the number of classes that have two rows and a hundredth of the group,
    and at least 0.35; a hundredth above it passes, and so do groups below ``least`` rows and exempt ones."""
    n = rows.groupBy(*group, cls).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(yesno, F.lit(False))).alias("_yesno"))
    n = n.withColumn("_total", F.sum("n").over(Window.partitionBy(*group)))
    g = n.groupBy(*group).agg(F.sum("n").alias("rows"), F.max("n").alias("top"), F.count("*").alias("classes"), F.count_if(F.col("n") >= F.greatest(F.lit(2.0), 0.01 * F.col("_total"))).alias("k"), F.bool_and("_yesno").alias("_yesno"))
    limit = F.when(F.col("_yesno"), 0.55).otherwise(F.greatest(F.lit(0.35), 1.5 / F.greatest(F.col("k"), F.lit(1))))
    share = F.col("top") / F.col("rows")
    passed = (share <= limit + 0.01) | (F.col("rows") < least) | (F.lit(False) if exempt is None else exempt)
    return g.select(*group, "rows", "classes", share.alias("share"), limit.alias("limit"), passed.alias("passed"))


def share_of(rows: DataFrame, group: list[str], flag: Column, limit: float) -> DataFrame:
    g = rows.groupBy(*group).agg(F.count("*").alias("rows"), F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias("share"))
    return g.withColumn("passed", F.col("share") <= limit)


def median_span_hits(train: DataFrame, test: DataFrame, group: str, spans: str, limit: float = 0.40) -> DataFrame:
    """How often one span per group, from the median start to the median end of all its spans in ``train``, hits a span of a ``test`` row by half.

    Rows without a span are never hit. A group without test rows has no share and does not pass."""
    each = train.select(group, F.explode(spans).alias("x"))
    mid = each.groupBy(group).agg(F.percentile(F.col("x.s"), 0.5).alias("ms"), F.percentile(F.col("x.e"), 0.5).alias("me"))
    hit = F.exists(spans, lambda x: S.iou(F.struct(F.col("ms").alias("s"), F.col("me").alias("e")), x) >= 0.5)
    scored = test.join(mid, group).groupBy(group).agg(F.count("*").alias("rows"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("hits"))
    g = mid.select(group).join(scored, group, "left")
    return g.select(group, F.coalesce("rows", F.lit(0)).alias("rows"), "hits", F.coalesce(F.col("hits") <= limit, F.lit(False)).alias("passed"))


def masks(contexts: list[str]) -> list[tuple[str, str]]:
    """What a skeleton hides: context sentences (patterns), note names, numbers, words of place and direction, runs of blanks."""
    words = "first|second|third|fourth|fifth|sixth|highest|lowest|upward|downward|ascending|descending"
    return [*[(c, " ") for c in contexts], (r"\b(C#|D#|F#|G#|A#|[A-G])\b", "N"), (r"[0-9]+(\.[0-9]+)?", "#"), (rf"\b({words})\b", "W"), (r"\s+", " ")]


def skeleton(text: Column, contexts: list[str]) -> Column:
    """A question with everything that varies within one wording masked."""
    for pattern, mask in masks(contexts):
        text = F.regexp_replace(text, pattern, mask)
    return F.trim(text)


def text_contract(q: Column, answer: Column) -> Column:
    """What a question and its answer break: form rules that hold for every record."""
    return _list(
        (F.trim(q) == "", "blank_question"), (~q.rlike(r"[?.]$"), "no_end_mark"), (q.rlike(r"\{|\}"), "open_placeholder"), (q.rlike(r"\s\s"), "double_space"), (F.trim(answer) == "", "blank_answer"),
        (answer.rlike(r"\b1 (notes|seconds|beats|semitones)\b"), "plural"), (q.rlike(r"(?i)\b(a) [aeiou]"), "article"),
    )


def rederived(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two derivations of the same answers compared: ``status`` equal, different, only_a or only_b, with counts."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ina"))
    y = b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_inb"))
    status = F.when(F.col("_inb").isNull(), "only_a").when(F.col("_ina").isNull(), "only_b").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("different")
    return x.join(y, keys, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


FIT_ROWS = 4_000
FIT_TERMS = 1 << 12
MODEL_MB = 32


def hashed_terms(text: str, size: int = FIT_TERMS) -> list[int]:
    """Places of a text's words, word pairs and runs of two to five characters within blank-edged words, by hash."""
    t = " ".join(re.findall(r"\w+", text.lower()))
    words = t.split(" ")
    found = [f"w{w}" for w in words] + [f"p{a} {b}" for a, b in zip(words, words[1:])]
    found += [f"c{w[i : i + n]}" for w in (f" {x} " for x in words) for n in range(2, 6) for i in range(max(1, len(w) - n + 1))]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % size for f in found]


def _weighted(texts: list[str], idf=None, counts=None):
    """Rows of unit length of term frequency times inverse document frequency, as (row, place, weight), and the frequencies used.

    ``counts``: how many documents each text stands for, one if not given."""
    rows, places, found = [], [], []
    for k, t in enumerate(texts):
        at, n = np.unique(hashed_terms(t), return_counts=True)
        rows.append(np.full(len(at), k))
        places.append(at)
        found.append(n)
    r, p, c = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, places, found))
    if idf is None:
        many = np.ones(len(texts)) if counts is None else np.asarray(counts, float)
        idf = np.log((1 + many.sum()) / (1 + np.bincount(p, many[r], minlength=FIT_TERMS))) + 1
    w = c * idf[p]
    norm = np.sqrt(np.bincount(r, w * w, minlength=len(texts)))
    return (r, p, w / norm[r]) if len(r) else (r, p, w), idf


def _blocks(x, n: int, size: int = 256):
    """Sparse rows as dense blocks of at most ``size`` rows, with the number of the first."""
    r, p, w = x
    for at in range(0, n, size):
        lo, hi = np.searchsorted(r, (at, at + size))
        block = np.zeros((min(size, n - at), FIT_TERMS))
        block[r[lo:hi] - at, p[lo:hi]] = w[lo:hi]
        yield at, block


def _scores(x, n: int, weights, bias):
    """Row by row the class scores of n sparse rows; no more than some 16 MB of weights are taken at a time."""
    r, p, w = x
    ends, step = np.searchsorted(r, np.arange(n + 1)), max(1, 2_000_000 // len(bias))
    for lo, hi in zip(ends[:-1], ends[1:]):
        s = bias.astype(np.float64)
        for k in range(lo, hi, step):
            s += w[k : min(k + step, hi)] @ weights[p[k : min(k + step, hi)]].astype(np.float64)
        yield s


def fit_text(texts: list[str], labels: list[str], counts: list[int], rounds: int = 60, rate: float = 8.0, shrink: float = 1e-4, direct: int = FIT_ROWS):
    """Multinomial logistic regression of labels on hashed terms by gradient descent with momentum: (classes, frequencies, rows, coefficients, bias).

    ``counts``: how often each pair of text and label occurs. Gradients are sums over rows, so the weights always are the rows times coefficients
    of a row and a class. These are worked out from the products of rows among each other, and equal texts are one row: arrays are texts by
    texts or texts by classes, never terms by classes. Of more than ``direct`` texts these would be larger than the weights; there the weights themselves are moved."""
    classes, known = sorted(set(labels)), list(dict.fromkeys(texts))
    place, number = {t: k for k, t in enumerate(known)}, {c: k for k, c in enumerate(classes)}
    u, y, c = np.array([place[t] for t in texts]), np.array([number[v] for v in labels]), np.array(counts, float)
    many, total = np.bincount(u, c, minlength=len(known)), c.sum()
    if len(known) > direct:
        return classes, *_fit_weights(known, many, u, y, c, len(classes), rounds, rate, shrink)
    x, idf = _weighted(known, counts=many)
    gram = np.empty((len(known), len(known)))
    for i, a in _blocks(x, len(known)):
        for j, b in _blocks(x, len(known)):
            gram[i : i + len(a), j : j + len(b)] = a @ b.T
    coef, bias = np.zeros((len(known), len(classes))), np.zeros(len(classes))
    speed, speed_b, s = np.zeros_like(coef), np.zeros_like(bias), np.empty_like(coef)
    for _ in range(rounds):
        np.matmul(gram, coef, out=s)
        s += bias
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s *= (many / s.sum(1))[:, None]
        np.subtract.at(s, (u, y), c)
        s /= total
        step_b = s.sum(0)
        for k in range(len(known)):  # in place, as these are the largest arrays
            speed[k] = 0.8 * speed[k] - rate * (s[k] + shrink * coef[k])
        coef += speed
        speed_b = 0.8 * speed_b - rate * step_b
        bias = bias + speed_b
    return classes, idf.astype(np.float32), x, coef.astype(np.float32), bias.astype(np.float32)


def _fit_weights(known: list[str], many, u, y, c, classes: int, rounds: int, rate: float, shrink: float, size: int = 256, part: int = 512):
    """As :func:`fit_text` on the weights of terms and classes: all texts in blocks of ``size`` and ``part`` classes at a time, so that besides the weights,
    their speeds and six bytes a term of a text only a block is held. The rows of what it gives are the terms themselves."""
    found = [(p.astype(np.uint16), n.astype(np.uint32)) for p, n in (np.unique(hashed_terms(t), return_counts=True) for t in known)]
    ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])])
    places, often = np.concatenate([p for p, _ in found]), np.concatenate([n for _, n in found])
    del found
    have = np.zeros(FIT_TERMS)
    for at in range(0, len(known), size):
        n = np.diff(ends[at : at + size + 1])
        have += np.bincount(places[ends[at] : ends[at] + n.sum()], np.repeat(many[at : at + size], n), minlength=FIT_TERMS)
    idf = np.log((1 + many.sum()) / (1 + have)) + 1

    def blocks():
        for at in range(0, len(known), size):
            n = np.diff(ends[at : at + size + 1])
            r, p, w = np.repeat(np.arange(len(n)), n), places[ends[at] : ends[at] + n.sum()], often[ends[at] : ends[at] + n.sum()]
            w = w * idf[p]
            block = np.zeros((len(n), FIT_TERMS), np.float32)
            block[r, p] = w / np.sqrt(np.bincount(r, w * w, minlength=len(n)))[r]
            yield at, block

    weights, bias, total = np.zeros((FIT_TERMS, classes), np.float32), np.zeros(classes), many.sum()
    speed, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    order = np.lexsort((u, y // part))  # pairs by part of the classes and text
    u, y, c = u[order], y[order], c[order]
    for _ in range(rounds):
        norm = np.concatenate([_log_sum(a, weights, bias, part) for _, a in blocks()])
        for k in range(0, classes, part):
            own = slice(k, min(k + part, classes))
            step, step_b, (lo, hi) = np.zeros((FIT_TERMS, own.stop - k), np.float32), np.zeros(own.stop - k), np.searchsorted(y // part, (k // part, k // part + 1))
            for at, a in blocks():
                s = np.exp(a @ weights[:, own] + bias[own] - norm[at : at + len(a), None]) * many[at : at + len(a), None]
                i, j = lo + np.searchsorted(u[lo:hi], (at, at + len(a)))
                np.subtract.at(s, (u[i:j] - at, y[i:j] - k), c[i:j])
                s /= total
                step += a.T @ s.astype(np.float32)
                step_b += s.sum(0)
            speed[:, own] = 0.8 * speed[:, own] - rate * (step + shrink * weights[:, own])
            speed_b[own] = 0.8 * speed_b[own] - rate * step_b
            weights[:, own] += speed[:, own]
            bias[own] += speed_b[own]
    terms = np.arange(FIT_TERMS)
    return idf.astype(np.float32), (terms, terms, np.ones(FIT_TERMS)), weights, bias.astype(np.float32)


def _log_sum(a, weights, bias, part: int):
    """Of each row the logarithm of the sum of the exponentials of all its class scores."""
    out = np.full(len(a), -np.inf)
    for k in range(0, len(bias), part):
        s = a @ weights[:, k : k + part] + bias[k : k + part]
        top = s.max(1)
        out = np.logaddexp(out, top + np.log(np.exp(s - top[:, None]).sum(1)))
    return out


def _weights(x, coef):
    """Weights of terms and classes, some classes at a time."""
    out = np.zeros((FIT_TERMS, coef.shape[1]), np.float32)
    for k in range(0, coef.shape[1], 512):
        out[:, k : k + 512] = sum(b.T @ coef[i : i + len(b), k : k + 512].astype(np.float64) for i, b in _blocks(x, len(coef)))
    return out


def text_baseline(rows: DataFrame, group: str, text: str, label: str, train: Column, least: int = 30, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per group how well the question text alone tells the answer: ``rows, accuracy, majority, z, passed``.

    A classifier per group is fitted in one task on all its train rows, equal ones as one with their number. ``fit_rows`` is the number of different texts above
    which it works in blocks of texts, so that its memory does not grow with their square; all test rows are scored, in as many tasks as there are, equal texts once in a task. A group passes unless it is more than three points above its
    most frequent answer and that is significant (z of 1.65). Groups with one answer in train or fewer than ``least`` test rows are left out."""
    d = rows.select(F.col(group).alias("grp"), F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("string").alias("y"), train.alias("is_train")).where("grp is not null and y is not null")
    d = cut(d.where("is_train is not null").groupBy("grp", "text", "y", "is_train").agg(F.count("*").alias("n")))

    def fit(key, table):
        texts, labels, counts = (table[c].to_pylist() for c in ("text", "y", "n"))
        body = pickle.dumps(fit_text(texts, labels, counts, direct=fit_rows)) if len(set(labels)) > 1 else None
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "model": pa.array([body], pa.binary())})

    models = cut(d.where("is_train").select("grp", "text", "y", "n").groupBy("grp").applyInArrow(fit, "grp string, model binary").where("model is not null"))
    parts, size = [[]], 0
    for r in models.select("grp", F.octet_length("model").alias("n")).orderBy("grp").collect():  # a row per group
        if parts[-1] and size + r.n > MODEL_MB * 1e6:
            parts.append([])
            size = 0
        parts[-1].append(r.grp)
        size += r.n
    scored = None
    for names in parts:  # as many passes as the models ask for, each with at most MODEL_MB of them at the workers
        shared = rows.sparkSession.sparkContext.broadcast({r.grp: r.model for r in models.where(F.col("grp").isin(names)).collect()})
        part = d.where(~F.col("is_train") & F.col("grp").isin(names)).select("grp", "text", "y", "n").sortWithinPartitions("grp", "text").mapInArrow(_scorer(shared), "grp string, y string, n long, hit boolean")
        scored = part if scored is None else scored.unionByName(part)
    per = scored.groupBy("grp", "y").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("hits")).groupBy("grp").agg(F.sum("n").alias("rows"), F.sum("hits").alias("hits"), F.max("n").alias("top"))
    per = per.join(models.select("grp"), "grp").where(F.col("rows") >= least)
    acc, maj = F.col("hits") / F.col("rows"), F.col("top") / F.col("rows")
    z = (acc - maj) / F.greatest(F.sqrt(maj * (1 - maj) / F.col("rows")), F.lit(1e-9))
    return per.select(F.col("grp").alias(group), "rows", acc.alias("accuracy"), maj.alias("majority"), z.alias("z"), ((acc <= maj + 0.03) | (z < 1.65)).alias("passed"))


def _scorer(shared):
    def score(batches):
        name = said = guess = model = None  # rows come by group and text, so one of each is kept
        for b in batches:
            hit = []
            for g, t, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                if g != name:
                    classes, idf, x, coef, bias = pickle.loads(shared.value[g])
                    name, said, model = g, None, (_weights(x, coef), bias)
                if t != said:
                    at, _ = _weighted([t], idf)
                    said, guess = t, classes[next(_scores(at, 1, *model)).argmax()]
                hit.append(guess == y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(hit, pa.bool_())], ["grp", "y", "n", "hit"])

    return score


TICK = 0.05  # seconds: onsets and lengths of a rhythm are compared in these steps


def _joined(ev: str, *parts) -> Column:
    """Parts of every note in one text; a part is a function of the note and of the first note."""
    one = lambda x, first: F.concat_ws(":", *[p(x, first).cast("string") for p in parts])
    return bound(F.col(ev), lambda v: bound(F.get(v, F.lit(0)), lambda first: F.array_join(F.transform(v, lambda x: one(x, first)), "-")))


def _pitch(x: Column, first: Column) -> Column:
    return x["pitch"]


def _velocity(x: Column, first: Column) -> Column:
    return x["velocity"]


def _onset(x: Column, first: Column) -> Column:
    """In ticks from the onset of the first note."""
    return F.rint((x["start"] - first["start"]) / TICK).cast("long")


def _length(x: Column, first: Column) -> Column:
    return F.rint((x["end"] - x["start"]) / TICK).cast("long")


def _hundredths(end: str):
    return lambda x, first: F.rint(x[end] * 100).cast("long")


def signatures(clips: DataFrame) -> DataFrame:
    """Signatures of clips: ``tune`` (pitches in order), ``rhythm`` (pitch, onset and length in ticks of 50 ms), ``whole`` (pitch,
    velocity, onset and end in hundredths of a second). Halves round to even."""
    whole = (_pitch, _velocity, _hundredths("start"), _hundredths("end"))
    return clips.select("sample_id", "split", _joined("ev", _pitch).alias("tune"), _joined("ev", _pitch, _onset, _length).alias("rhythm"), _joined("ev", *whole).alias("whole"))


def short_signatures(ph: DataFrame) -> DataFrame:
    """Of clips of one to three notes (``v``): ``pitches``, whatever their order, and ``all`` (pitch, velocity, onset and length in ticks)."""
    sorted_ = F.array_join(F.array_sort(F.transform("v", lambda x: x["pitch"])), "-")
    return ph.withColumn("pitches", sorted_).withColumn("all", _joined("v", _pitch, _velocity, _onset, _length))


def twins(sig: DataFrame, keys: list[str], names: list[str], ids: tuple = ("sample_id",)) -> DataFrame:
    """Evaluation clips with whether their signatures occur in train: a join per signature with the distinct ones of train.

    Signatures are worked out once and written, as every join needs them."""
    sig = cut(sig.select(*ids, "split", *keys))
    e, train = sig.where("split in ('val', 'test')"), sig.where("split = 'train'")
    for key in keys:
        e = e.join(train.select(key).distinct().withColumn(f"_in_{key}", F.lit(True)), key, "left")
    return e.select(*ids, *[F.coalesce(f"_in_{k}", F.lit(False)).alias(n) for k, n in zip(keys, names)])


def shared_signatures(sig: DataFrame, key: str = "whole") -> DataFrame:
    """``pair, clips``: how many different clips two splits have in common, for each pair of splits.

    One aggregate over the signatures, so a clip that is in all splits however often is one row; clips without notes are none."""
    have = sig.where(F.col(key) != "").groupBy(key).agg(*[F.bool_or(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    both = lambda a, b: F.struct(F.lit(f"{a}-{b}").alias("pair"), F.coalesce(F.col(a) & F.col(b), F.lit(False)).alias("both"))
    return have.select(F.inline(F.array(both("train", "val"), both("train", "test"), both("val", "test")))).groupBy("pair").agg(F.count_if("both").alias("clips"))


def stale_values(clips: DataFrame) -> DataFrame:
    """Stored facts of clips that their notes no longer bear out: ``sample_id, field``."""
    b, notes = F.col("basic_info"), F.col("notes")
    beats = M.table(M.BEATS_PER_BAR, b["time_signature"])
    stale = _list((b["num_notes"] != F.size(notes), "num_notes"), (b["beats_per_bar"] != beats, "beats_per_bar"), (F.abs(b["music_end_sec"] - F.array_max(F.transform(notes, lambda x: x["end"]))) > 0.05, "music_end_sec"), (F.abs(b["music_start_sec"] - F.array_min(F.transform(notes, lambda x: x["start"]))) > 0.05, "music_start_sec"))
    return clips.select("sample_id", F.explode(stale).alias("field"))


def note_deviation(a: Column, b: Column) -> Column:
    """Largest difference in time between two note arrays of the same length and pitches; null if they differ otherwise."""
    same = (F.size(a) == F.size(b)) & (F.transform(a, lambda x: x["pitch"]) == F.transform(b, lambda x: x["pitch"]))
    off = F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x["start"] - y["start"]), F.abs(x["end"] - y["end"])))
    return F.when(same, F.coalesce(F.array_max(off), F.lit(0.0)))


def gate_report(gates: dict[str, DataFrame]) -> DataFrame:
    """One row per gate: rows checked, rows failed, and whether it passed. Each gate has a column ``passed``."""
    out = None
    for name, g in gates.items():
        row = g.agg(F.count("*").alias("checked"), F.count_if(~F.col("passed")).alias("failed")).select(F.lit(name).alias("gate"), "checked", "failed", (F.col("failed") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out
