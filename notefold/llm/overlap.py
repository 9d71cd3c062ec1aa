"""Same or near-same records across splits: a weighted cosine join on interval n-grams, checked exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.ids import bound, clip_id, split_name, sql_clip_id, sql_split_name
from notefold.runtime import cut, tables

EDITS = 2
SHORT = 6
HOT_POSTINGS = 2_000
TRAIN = "train"


def gram_size(length):
    """n-gram size for melodies of ``length`` notes, the longest for which two edits still leave a
    provable overlap: q < (length - 2) / 3, at most 8."""
    return F.greatest(F.lit(1), F.least(F.lit(8), F.floor((length - 3) / 3).cast("int")))


def melodies(clips: DataFrame) -> DataFrame:
    """``source, seq_id, n, tune``: every distinct version of a clip as its pitches in order of time, less the first.

    Melodies that differ by a shift of all pitches have one ``seq_id`` and are handled once. Clips without notes or with a null pitch have no melody."""
    ordered = F.array_sort(F.filter(F.transform("notes", lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["pitch"].alias("pitch"))), lambda x: x["pitch"].isNotNull()))
    c = clips.select(clip_id(F.col("sample_id")).alias("source"), F.size("notes").alias("had"), ordered.alias("o")).where("source is not null and size(o) > 0 and size(o) = had")
    tune = bound(F.col("o")[0]["pitch"], lambda first: F.transform("o", lambda x: x["pitch"] - first))
    return c.select("source", F.size("o").alias("n"), tune.alias("tune")).withColumn("seq_id", F.sha2(F.array_join("tune", ","), 256)).distinct()


def gram_rows(seqs: DataFrame) -> DataFrame:
    """``seq_id, n, q, gram``: the distinct runs of q intervals.

    A melody is cut for the sizes of its own length and of those up to ``EDITS`` shorter, so two
    melodies at most ``EDITS`` edits apart always share the size that belongs to the shorter one."""
    steps = F.transform(F.slice("tune", F.lit(2), F.col("n") - 1), lambda x, i: x - F.get("tune", i))
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(EDITS)), lambda k: gram_size(F.greatest(F.col("n") - k, F.lit(SHORT)))))
    m = seqs.where(F.col("n") >= SHORT).select("seq_id", "n", steps.alias("steps"), F.explode(sizes).alias("q"))
    grams = F.transform(F.sequence(F.lit(1), F.size("steps") - F.col("q") + 1), lambda i: F.array_join(F.slice("steps", i, F.col("q")), ","))
    return m.where(F.size("steps") >= F.col("q")).select("seq_id", "n", "q", F.explode(F.array_distinct(grams)).alias("gram"))


def weighted_vectors(grams: DataFrame) -> DataFrame:
    """``seq_id, n, q, terms, norm2, least``: a melody's grams with their squared weights, the heaviest first.

    A gram in df of N melodies weighs ln(1 + N/df). One edit destroys at most q+1 grams, so with k = EDITS*(q+1) the dot
    product with any melody within ``EDITS`` edits is at least ``least``, the squared norm less its k largest squared weights."""
    df = grams.groupBy("q", "gram").agg(F.count("*").alias("df"))
    total = grams.groupBy("q").agg(F.count_distinct("seq_id").alias("total"))
    w2 = F.pow(F.ln(1 + F.col("total") / F.col("df")), 2)
    w = grams.join(df, ["q", "gram"]).join(F.broadcast(total), "q")  # a row per size: at most 8
    term = F.struct((-w2).alias("neg"), F.col("gram"), F.col("df"))
    v = w.groupBy("seq_id", "n", "q").agg(F.sort_array(F.collect_list(term)).alias("terms"))  # as many as the melody has notes
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a - x["neg"])
    return v.withColumn("norm2", squares("terms")).withColumn("least", F.col("norm2") - squares(F.slice("terms", F.lit(1), EDITS * (F.col("q") + 1))))


def cosine_candidates(v: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs ``x, y`` of melodies, x on the train and y on the evaluation side, whose weighted cosine
    reaches what two edits cannot undercut.

    Inverted lists hold a melody's k+1 heaviest grams only (k as in :func:`weighted_vectors`): behind them the residual
    norm is below ``least``, so a pair that shares only later ones cannot reach it. Where two entries meet, the residual norm
    of either from there on bounds what the pair can still reach; at the first gram in common that is its whole dot product, so
    pairs are kept where it reaches both bounds (weights being those of the term, the maximum weight of a list
    is its own). What is left gets its exact dot product from all terms. A list is split by salt on its train side by
    its own length, so no task holds all of a list's pairs."""
    k = EDITS * (F.col("q") + 1) + 1
    before = lambda i: F.aggregate(F.slice("terms", F.lit(1), i), F.lit(0.0), lambda a, t: a - t["neg"])
    listed = F.transform(F.slice("terms", F.lit(1), k), lambda t, i: F.struct(t["gram"].alias("gram"), (F.col("norm2") - before(i)).alias("rest"), F.ceil(t["df"] / HOT_POSTINGS).cast("int").alias("salts")))
    e = v.join(sides, "seq_id").select("q", "seq_id", "n", "least", "in_train", "in_eval", F.inline(listed))
    x = e.where("in_train").select("q", "gram", F.pmod(F.xxhash64("seq_id"), F.col("salts")).cast("int").alias("salt"), F.col("seq_id").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx"), F.col("least").alias("lx"))
    y = e.where("in_eval").select("q", "gram", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("seq_id").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("ry"), F.col("least").alias("ly"))
    near = (F.abs(F.col("nx") - F.col("ny")) <= EDITS) & (F.col("x") != F.col("y")) & (F.col("q") == gram_size(F.greatest(F.least("nx", "ny"), F.lit(SHORT))))
    reach = F.least("rx", "ry") >= F.greatest("lx", "ly") - 1e-9
    pairs = x.join(y, ["q", "gram", "salt"]).where(near & reach).select("q", "x", "y").distinct()
    terms = F.transform("terms", lambda t: F.concat_ws("=", t["gram"], t["neg"].cast("string")))
    of = v.select("q", "seq_id", "least", terms.alias("terms"))
    vx, vy = (of.toDF("q", c, f"l{c}", f"t{c}") for c in "xy")
    dot = F.aggregate(F.array_intersect("tx", "ty"), F.lit(0.0), lambda a, t: a - F.split_part(t, F.lit("="), F.lit(2)).cast("double"))
    return pairs.join(vx, ["q", "x"]).join(vy, ["q", "y"]).where(dot >= F.greatest("lx", "ly") - 1e-6).select("x", "y")


def short_candidates(seqs: DataFrame) -> DataFrame:
    """Pairs with a melody of fewer than ``SHORT`` notes, for which n-grams prove nothing: melodies
    that are at most ``EDITS`` notes apart have a common rest after leaving out up to ``EDITS`` notes each."""
    m = seqs.where(F.col("n") < SHORT + EDITS)
    at = F.sequence(F.lit(0), F.col("n") - 1)
    left = F.transform(F.sequence(F.lit(-1), F.col("n") - 1), lambda i: F.transform(F.sequence(i, F.col("n") - 1), lambda j: F.filter(at, lambda k: (k != i) & (k != j))))
    m = m.select("seq_id", "n", "in_train", "in_eval", "tune", F.explode(F.array_distinct(F.flatten(left))).alias("keep"))
    rest = F.transform("keep", lambda k: F.get("tune", k) - F.get("tune", F.get("keep", F.lit(0))))
    m = m.select("seq_id", "n", "in_train", "in_eval", F.array_join(rest, ",").alias("rest")).distinct()
    x = m.where("in_train").select("rest", F.col("seq_id").alias("x"), F.col("n").alias("nx"))
    y = m.where("in_eval").select("rest", F.col("seq_id").alias("y"), F.col("n").alias("ny"))
    return x.join(y, "rest").where((F.least("nx", "ny") < SHORT) & (F.col("x") != F.col("y"))).select("x", "y")


def near_melodies(seqs: DataFrame) -> DataFrame:
    """Pairs of different melodies within ``EDITS`` changed, missing or added notes after a shift.

    ``seqs``: ``seq_id, n, tune, in_train, in_eval``, a row per melody. Candidates come from the cosine join; each is checked
    exactly. If at most two notes differ, one of the first three notes of x is kept and has moved by at most two places, so it is
    enough to lay each of these on each of the first five of y and take the edit distance of the whole melodies."""
    vectors = cut(weighted_vectors(gram_rows(seqs)))
    pairs = cosine_candidates(vectors, seqs.select("seq_id", "in_train", "in_eval")).union(short_candidates(seqs)).distinct()
    letter = lambda v: F.decode(F.unhex(F.lpad(F.hex(v.cast("long")), 4, "0")), "UTF-16BE")
    laid = lambda count: F.transform(F.sequence(F.lit(0), F.least(F.lit(count), F.col("n")) - 1), lambda i: F.array_join(F.transform("tune", lambda v: letter(v - F.get("tune", i) + 1024)), ""))
    tx = seqs.where("in_train").select(F.col("seq_id").alias("x"), laid(EDITS + 1).alias("tx"), F.col("n").alias("nx"))
    ty = seqs.where("in_eval").select(F.col("seq_id").alias("y"), laid(2 * EDITS + 1).alias("ty"), F.col("n").alias("ny"))
    both = pairs.join(tx, "x").join(ty, "y")
    close = F.exists("tx", lambda a: F.exists("ty", lambda b: F.levenshtein(a, b, EDITS) >= 0)) | (F.greatest("nx", "ny") <= EDITS)
    return both.where(close).select("x", "y")


def recordings(entries: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources in classes: ``source, cls`` of every source of ``entries``, and ``cx, cy``: the classes of train and evaluation
    that are the same recording.

    Sources whose clips have the same set of melodies are one class, known by count, sum and xor of hashes, so however many
    sources or versions there are, they are linked once; a source without a melody is a class of its own. Classes are linked if
    a melody of one is near one of the other; a class is linked with itself."""
    used = entries.groupBy("source").agg(F.bool_or(F.col("split") == TRAIN).alias("in_train"), F.bool_or(F.col("split") != TRAIN).alias("in_eval"))
    mel = cut(melodies(clips).join(used, "source"))
    seqs = cut(mel.groupBy("seq_id").agg(F.first("n").alias("n"), F.first("tune").alias("tune"), F.bool_or("in_train").alias("in_train"), F.bool_or("in_eval").alias("in_eval")))
    h = F.xxhash64("seq_id")
    name = F.concat_ws("|", F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string"))
    named = mel.groupBy("source").agg(name.alias("cls"))
    of = cut(used.join(named, "source", "left").select("source", F.coalesce("cls", F.concat(F.lit("="), F.col("source"))).alias("cls")))
    tunes = mel.join(of, "source").groupBy("cls", "seq_id").agg(F.bool_or("in_train").alias("in_train"), F.bool_or("in_eval").alias("in_eval"))
    cx = tunes.where("in_train").select(F.col("seq_id").alias("x"), F.col("cls").alias("cx"))
    cy = tunes.where("in_eval").select(F.col("seq_id").alias("y"), F.col("cls").alias("cy"))
    same = seqs.where("in_train and in_eval").select(F.col("seq_id").alias("x"), F.col("seq_id").alias("y"))
    links = near_melodies(seqs).union(same).join(cx, "x").join(cy, "y").select("cx", "cy")
    return of, cut(links.union(of.select("cls", "cls")).distinct())


def _valid(entries: DataFrame) -> DataFrame:
    return cut(entries.select("id", "split", "source", "semitones").where("id is not null and source is not null and semitones is not null and split is not null").distinct())


def split_overlaps(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """Pairs ``train_id, other_id`` with their source and split: semitones equal or one apart, same recording.

    ``entries`` has ``id, split, source, semitones``. Recordings are compared, not entries (see :func:`recordings`). A class with
    very many train entries is salted on that side by its own count. Blank sources and null semitones match nothing; repeated
    entries count once, and a pair comes once for each pair of sources its ids are listed with."""
    e = _valid(entries)
    of, links = recordings(e, clips)
    e = e.join(of, "source")
    x = e.where(F.col("split") == TRAIN).select(F.col("cls").alias("cx"), F.col("id").alias("train_id"), F.explode(F.array(F.col("semitones") - 1, F.col("semitones"), F.col("semitones") + 1)).alias("semitones"))
    y = e.where(F.col("split") != TRAIN).select(F.col("cls").alias("cy"), F.col("id").alias("other_id"), "semitones", F.col("split").alias("other_split"), F.col("source").alias("other_source"))
    n = x.groupBy("cx", "semitones").agg(F.ceil(F.count("*") / HOT_POSTINGS).cast("int").alias("salts"))
    linked = y.join(links, "cy").join(n, ["cx", "semitones"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    x = x.join(n, ["cx", "semitones"]).withColumn("salt", F.pmod(F.xxhash64("train_id"), F.col("salts")).cast("int"))
    return x.join(linked, ["cx", "semitones", "salt"]).select("train_id", "other_id", "other_split", "other_source")


def overlap_counts(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """``split, source, entries, pairs`` of the evaluation side, without any pair of entries being written out: train entries are
    counted per class and semitones, and each evaluation entry sums the counts of the classes it is linked with."""
    e = _valid(entries)
    of, links = recordings(e, clips)
    e = e.join(of, "source")
    x = e.where(F.col("split") == TRAIN).groupBy("cls", "semitones").agg(F.count("*").alias("n"))
    x = x.select(F.col("cls").alias("cx"), F.inline(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.struct((F.col("semitones") + d).alias("semitones"), F.col("n").alias("n")))))
    n = links.join(x.groupBy("cx", "semitones").agg(F.sum("n").alias("n")), "cx").groupBy("cy", "semitones").agg(F.sum("n").alias("n"))
    y = e.where(F.col("split") != TRAIN).groupBy("split", "source", F.col("cls").alias("cy"), "semitones").agg(F.count("*").alias("k"))
    return y.join(n, ["cy", "semitones"]).groupBy("split", "source").agg(F.sum("k").alias("entries"), F.sum(F.col("k") * F.col("n")).alias("pairs"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tables(spark, sf_dir)
    m = t("manifest").select("id", split_name(F.col("split"), F.col("id")).alias("split"), clip_id(F.col("source")).alias("source"), "semitones")
    return m.where(F.col("split").isin("train", "val", "test")), t("clips")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlaps(*_inputs(spark, sf_dir)).select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the evaluation side: entries with an overlap and pairs of listings."""
    return overlap_counts(*_inputs(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
# one byte per note, as levenshtein counts bytes there; distances of 127 semitones do not occur
_PITCH = "list_transform({p}, lambda q: chr(cast((q - {p}[{i}] + 254) % 127 + 1 as integer)))"
_ALIKE = f"""with m as (
  select distinct id, {sql_split_name('split', 'id')} as sp, {sql_clip_id('source')} as source, semitones from manifest where source is not null),
mm as (select * from m where source is not null and semitones is not null and sp in ('train', 'val', 'test')),
cl as (
  select distinct {sql_clip_id('sample_id')} as source, list_transform(list_sort(notes), lambda n: n.pitch) as p from clips where len(notes) > 0),
ca as (select distinct source, p from cl join mm using (source) where sp = 'train'),
cb as (select distinct source, p from cl join mm using (source) where sp <> 'train'),
cand as (
  select a.source as sa, b.source as sb, a.p as pa, b.p as pb, i, j from ca a join cb b on abs(len(a.p) - len(b.p)) <= {EDITS}
  cross join range(1, {EDITS + 2}) r1(i) cross join range(1, {2 * EDITS + 2}) r2(j) where i <= len(a.p) and j <= len(b.p)),
alike as (
  select distinct sa, sb from cand where greatest(len(pa), len(pb)) <= {EDITS} or levenshtein(
    array_to_string({_PITCH.format(p='pa', i='i')}, ''), array_to_string({_PITCH.format(p='pb', i='j')}, '')) <= {EDITS}
  union select source, source from mm)
"""
_PAIRS = "from mm a join alike on a.source = sa join mm b on b.source = sb and b.sp <> 'train' and abs(a.semitones - b.semitones) <= 1 where a.sp = 'train'"
ORACLE = {
    "p5_found": _ALIKE + f"select distinct least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b {_PAIRS}",
    "p5_report": _ALIKE + f"select b.sp as split, b.source, count(distinct (b.id, b.semitones)) as entries, count(*) as pairs {_PAIRS} group by all",
}
