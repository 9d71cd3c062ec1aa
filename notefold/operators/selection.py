"""Balanced selection: shares, caps, quotas, exact subsamples, splits and dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.runtime import alone, cut, discard

# fixed values
EMPTY_CAP = 0.20
YESNO_CAP = 0.10
TINY_SHARE = 0.05
SLOTS = {"H-G2": 3, "H-U1": 2, "A-G1": 2, "A-G2": 2, "A-U1": 2, "A-U2": 2}
BLOCK = 20_000


def hash_order(seed, *keys) -> Column:
    """The order in which rows are drawn: md5 of seed and keys, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) if isinstance(k, str) else k for k in keys]))


def hash_ranked(df: DataFrame, group: list[str], keys: list[str], seed, out: str = "rank") -> DataFrame:
    """Rows with their 1-based place in the hash order of their group.

    A group is split into the 4,096 buckets of the first digits of the hash: the place is the
    number of rows in lower buckets, from pre-aggregated counts, plus the place in the bucket. So a group
    with a third of all rows is ranked by many tasks. Rows that repeat all keys get different places."""
    g = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(group)] or [F.lit("").alias("_g0")]
    names = [f"_g{i}" for i in range(len(g))]
    d = df.select("*", *g, hash_order(seed, *keys).alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    n = d.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
    low = n.withColumn("_low", F.coalesce(F.sum("_n").over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    here = Window.partitionBy(*names, "_b").orderBy("_h", *keys)
    return d.withColumn("_r", F.row_number().over(here)).join(low, [*names, "_b"]).withColumn(out, F.col("_low") + F.col("_r")).drop(*names, "_b", "_h", "_r", "_low")


def share_limit(classes: Column, boolean: Column, stratum: Column) -> Column:
    """Largest share a class may have among ``classes``: yes/no 0.55; in a stratum of three and more 1.1/k; else 1.5/k, at least 0.35."""
    k = F.greatest(classes, F.lit(1)).cast("double")
    return F.when(boolean, 0.55).when(stratum & (classes >= 3), 1.1 / k).otherwise(F.greatest(F.lit(0.35), 1.5 / k))


def waterfill_cap(counts: DataFrame, group: list[str], n: str = "n", share: str = "share") -> DataFrame:
    """``cap`` per group: the largest c with c <= share * sum(min(n, c)) over its classes, at least 1.

    Between two neighbouring counts the sum grows evenly, so the best c of each stretch is known
    from a prefix sum; no candidate values are listed, however large the counts."""
    w = Window.partitionBy(*group).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
    tie = Window.partitionBy(*group)
    d = counts.select(*group, n, share, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("p"), F.coalesce(F.max(n).over(w), F.lit(0)).alias("lo"), (F.count("*").over(tie) - F.row_number().over(Window.partitionBy(*group).orderBy(n)) + 1).alias("above"))
    slope = 1.0 - F.col(share) * F.col("above")
    top = F.when(slope <= 1e-12, F.col(n)).otherwise(F.least(F.col(n), F.floor((F.col(share) * F.col("p") + 1e-9) / slope)))
    return d.withColumn("c", F.when(top > F.col("lo"), top)).groupBy(*group).agg(F.greatest(F.lit(1), F.coalesce(F.max("c"), F.lit(1))).cast("long").alias("cap"))


def waterfill_alloc(caps: DataFrame, group: list[str], key: str, cap: str = "cap", total: str = "total") -> DataFrame:
    """``alloc``: ``total`` spread over the keys of a group as evenly as their caps allow, in whole numbers.

    All get the highest level that fits; what is left goes one each to the keys with most room,
    ties by key. Caps below 1 get nothing."""
    d = caps.where(F.col(cap) > 0)
    order = Window.partitionBy(*group).orderBy(cap, key)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("p", F.coalesce(F.sum(cap).over(upto), F.lit(0))).withColumn("above", F.count("*").over(Window.partitionBy(*group)) - F.row_number().over(order) + 1)
    fits = F.least(F.col(cap), F.floor((F.col(total) - F.col("p")) / F.col("above")))
    d = d.withColumn("level", F.max(F.greatest(F.lit(0), fits)).over(Window.partitionBy(*group)))
    d = d.withColumn("base", F.least(cap, "level"))
    rest = F.col(total) - F.sum("base").over(Window.partitionBy(*group))
    room = Window.partitionBy(*group).orderBy((F.col(cap) - F.col("base")).desc(), key)
    extra = F.when((F.col(cap) > F.col("base")) & (F.row_number().over(room) <= F.least(rest, F.count_if(F.col(cap) > F.col("base")).over(Window.partitionBy(*group)))), 1).otherwise(0)
    return d.withColumn("alloc", (F.col("base") + extra).cast("long")).drop("p", "above", "level", "base")


def largest_remainder(cells: DataFrame, group: list[str], cell: list[str], n: str = "n", target: str = "target") -> DataFrame:
    """``quota`` per cell: its proportional share of ``target`` rounded so that a group's quotas sum up exactly."""
    over = Window.partitionBy(*group)
    total = F.sum(n).over(over)
    d = cells.withColumn("aim", F.least(F.col(target), total)).withColumn("base", F.expr(f"({n} * aim) div {'sum(' + n + ') over (partition by ' + ', '.join(group) + ')'}"))
    frac = F.pmod(F.col(n) * F.col("aim"), total)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("frac").desc(), *cell))
    d = d.withColumn("frac", frac).withColumn("place", place)
    left = F.col("aim") - F.sum("base").over(over)
    return d.withColumn("quota", (F.col("base") + F.when(F.col("place") <= left, 1).otherwise(0)).cast("long")).drop("aim", "base", "frac", "place")


def proportional_subsample(rows: DataFrame, group: list[str], cell: list[str], keys: list[str], target: int, seed) -> DataFrame:
    """Exactly ``target`` rows of each group (or all), each cell by its share, drawn in hash order."""
    return thinned(rows, group, cell, keys, rows.select(*group).distinct().withColumn("target", F.lit(target).cast("long")), seed)


def thinned(rows: DataFrame, group: list[str], cell: list[str], keys: list[str], targets: DataFrame, seed) -> DataFrame:
    """As :func:`proportional_subsample`, with the ``target`` of each group from a table; groups it does not name are left out."""
    t = targets.withColumnsRenamed({c: f"_{c}" for c in group})
    same = lambda names: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    cells = rows.groupBy(*group, *cell).agg(F.count("*").alias("n")).join(t, same(group)).drop(*[f"_{c}" for c in group])
    quota = largest_remainder(cells, group, cell).select(*group, *cell, "quota")
    q = quota.withColumnsRenamed({c: f"_{c}" for c in [*group, *cell]})
    ranked = hash_ranked(rows, [*group, *cell], keys, seed, "_rank")
    return ranked.join(q, same([*group, *cell])).where(F.col("_rank") <= F.col("quota")).drop("_rank", "quota", *[f"_{c}" for c in [*group, *cell]])


def capped(rows: DataFrame, group: list[str], keys: list[str], caps: DataFrame, seed) -> DataFrame:
    """At most ``cap`` rows per group, in hash order; ``caps`` has the groups of a prefix of ``group``."""
    by = [c for c in group if c in caps.columns]
    return hash_ranked(rows, group, keys, seed, "_rank").join(caps, by).where(F.col("_rank") <= F.col("cap")).drop("_rank", "cap")


def strata_trim(rows: DataFrame, keys: list[str], seed) -> DataFrame:
    """Understanding rows (``family, stratum, akey, boolean``) within the share rule of their stratum: tiny
    classes and strata with a single class go, the others are capped."""
    n = rows.groupBy("family", "stratum", "akey", "boolean").agg(F.count("*").alias("n"))
    s = Window.partitionBy("family", "stratum")
    n = n.withColumn("least", F.greatest(F.lit(2.0), TINY_SHARE * F.sum("n").over(s))).where(F.col("n") >= F.col("least"))
    n = n.withColumn("k", F.count("*").over(s)).where("k >= 2").withColumn("share", share_limit(F.col("k"), F.col("boolean"), F.lit(True)))
    caps = waterfill_cap(n, ["family", "stratum"])
    kept = n.select("family", "stratum", "akey").join(caps, ["family", "stratum"])
    return capped(rows, ["family", "stratum", "akey"], keys, kept, seed)


def yesno_trim(rows: DataFrame, keys: list[str], seed, share: float = YESNO_CAP) -> DataFrame:
    """Yes/no rows (``boolean``, answer ``yes``) within ``share`` of what their concept then has; the other rows stay.

    Where there are more, half of the limit goes to each answer, and what one answer cannot use to the other."""
    yes = F.coalesce("yes", F.lit(False))
    n = rows.groupBy("concept").agg(F.count_if(~F.col("boolean")).alias("others"), F.count_if(F.col("boolean") & yes).alias("t"), F.count_if(F.col("boolean") & ~yes).alias("f"))
    n = n.withColumn("lim", F.floor(F.col("others") * share / (1 - share)).cast("long"))
    n = n.withColumn("nf", F.least("f", F.col("lim") - F.least("t", F.floor(F.col("lim") / 2)))).withColumn("nt", F.least("t", F.col("lim") - F.col("nf")))
    n = n.select(F.col("concept").alias("_concept"), (F.col("t") + F.col("f") <= F.col("lim")).alias("_all"), "nt", "nf")
    asked = hash_ranked(rows.where("boolean").withColumn("yes", yes), ["concept", "yes"], keys, seed, "_rank")
    kept = asked.join(n, F.col("concept").eqNullSafe(F.col("_concept"))).where(F.col("_all") | (F.col("_rank") <= F.when(F.col("yes"), F.col("nt")).otherwise(F.col("nf"))))
    return rows.where("not boolean").withColumn("yes", yes).unionByName(kept.drop("_rank", "_concept", "_all", "nt", "nf"))


def concept_quota(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``understanding, concept, family, yesno, cap, target, alloc``: how many rows of each family stay.

    ``rows`` have ``understanding, concept, family, yesno`` (true for families of yes/no answers only). A concept can give its other
    rows and, if it is of understanding, at most a ninth as many yes/no rows. Every concept of a kind gets what the scarcest can give, or with
    ``most`` up to that; a tenth of it at most goes to the yes/no families; families share by :func:`waterfill_alloc`."""
    n = rows.groupBy("understanding", "concept", "family", "yesno").agg(F.count("*").alias("cap"))
    c = n.groupBy("understanding", "concept").agg(F.coalesce(F.sum(F.when(~F.col("yesno"), F.col("cap"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("yesno"), F.col("cap"))), F.lit(0)).alias("b"))
    c = c.withColumn("room", F.when(F.col("understanding"), F.col("n") + F.least("b", F.floor(F.col("n") / 9))).otherwise(F.col("n")))
    target = F.least("room", F.lit(most)) if most is not None else F.min("room").over(Window.partitionBy("understanding"))
    c = c.withColumn("target", target.cast("long")).withColumn("_b", F.least("b", F.floor(F.col("target") * YESNO_CAP).cast("long")))
    n = n.join(c, ["understanding", "concept"]).withColumn("total", F.when(F.col("yesno"), F.col("_b")).otherwise(F.col("target") - F.col("_b")))
    return waterfill_alloc(n, ["understanding", "concept", "yesno"], "family")


def family_trim(rows: DataFrame, keys: list[str], seed, rounds: int = 8, apart: bool = False) -> DataFrame:
    """Rows of families within the share rules of their strata and of the whole family.

    ``rows``: ``family, understanding, stratum, akey, boolean, empty``; boolean and understanding are those of the family, and the
    stratum is empty where the family has none. Inside a stratum of an understanding family tiny classes go, one that is left with a single class goes, and the others are
    capped; strata of grounding families only have their empty rows cut. Then the family is capped as a whole. The two trims take rows away
    unevenly, so for understanding families they alternate until nothing changes, at most ``rounds`` times; each round is written, which keeps the plan short.
    With ``apart`` each trim is written by itself and what it shuffled is freed."""
    def written(d):
        return alone(lambda: cut(d)) if apart else d

    def caps(d, group, limit):
        n = d.groupBy(*group, "akey").agg(F.count("*").alias("n"), F.first("boolean").alias("boolean"), F.first("understanding").alias("understanding"))
        g = Window.partitionBy(*group)
        return n.withColumn("big", F.col("n") >= F.greatest(F.lit(2.0), limit * F.sum("n").over(g))).withColumn("k", F.count_if(F.col("big")).over(g))

    def cut_to(d, n, group, stratum):
        c = waterfill_cap(n.withColumn("share", share_limit(F.col("k"), F.col("boolean"), stratum)), group)
        return capped(d, [*group, "akey"], keys, n.select(*group, "akey").join(c, group), seed)

    def strata(d):
        inside = F.col("stratum") != ""
        n = caps(d.where(F.col("understanding") | ~inside), ["family", "stratum"], TINY_SHARE)
        strict = F.col("understanding") & inside
        n = n.where(~strict | (F.col("big") & (F.col("k") >= 2)))
        return d.where(~F.col("understanding") & inside).unionByName(cut_to(d.where(F.col("understanding") | ~inside), n, ["family", "stratum"], inside))

    def whole(d):
        return cut_to(d, caps(d, ["family"], 0.01), ["family"], F.lit(False))

    d = written(strata(rows))
    inside = ~F.col("understanding") & (F.col("stratum") != "")
    d = d.where(~inside).unionByName(empties_capped(d.where(inside), ["family", "stratum"], keys, seed))
    done = written(whole(written(d))) if apart else cut(whole(d))
    out, going = done.where("not understanding"), done.where("understanding")
    n = going.count()
    for _ in range(rounds):
        last, going = going, alone(lambda: cut(whole(written(strata(going))))) if apart else cut(whole(strata(going)))
        before, n = n, going.count()
        if apart:
            discard(last)
        if n == before:
            break
    return out.unionByName(going)


def empties_capped(rows: DataFrame, group: list[str], keys: list[str], seed, share: float = EMPTY_CAP) -> DataFrame:
    """Rows without an answer cut to ``share`` of their group."""
    full = rows.where("not empty").groupBy(*group).agg(F.floor(F.count("*") * share / (1 - share) + 1e-9).alias("cap"))
    ranked = hash_ranked(rows.where("empty"), group, keys, seed, "_rank").join(full, group).where(F.col("_rank") <= F.col("cap")).drop("_rank", "cap")
    return rows.where("not empty").unionByName(ranked)


def slots(rows: DataFrame, keys: list[str], seed) -> DataFrame:
    """Up to as many rows of a family per clip as its slots allow (one, where not listed)."""
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv]), F.col("family")), F.lit(1))
    return hash_ranked(rows, ["family", "clip"], keys, seed, "slot").where(F.col("slot") <= many)


def exact_split(rows: DataFrame, keys: list[str], shares: dict[str, float], seed) -> DataFrame:
    """Rows with ``new_split`` in exact sizes: places in the hash order up to the rounded-down running shares, the last takes the rest."""
    n = rows.count()
    bounds, upto = [], 0.0
    for name, share in shares.items():
        upto += share
        bounds.append((name, int(n * upto + 1e-9)))
    pick = None
    for name, b in bounds[:-1]:
        pick = F.when(F.col("_rank") <= b, name) if pick is None else pick.when(F.col("_rank") <= b, name)
    return hash_ranked(rows, [], keys, seed, "_rank").withColumn("new_split", pick.otherwise(bounds[-1][0])).drop("_rank")


def dense_ids(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Distinct keys numbered from 0 in sorted order, without sorting them in one task: ranges of keys are
    numbered apart and moved by the sizes of the ranges before them."""
    k = cut(df.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = k.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return k.withColumn("_r", place).join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_r") - 1).cast("long").alias(out))  # a row per partition


def evenly(values: Column, k: int) -> Column:
    """``k`` entries of an array at even distances, first and last among them; all if there are no more."""
    n = F.size(values)
    return F.when(n <= k, values).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(values, F.floor(i * (n - 1) / max(k - 1, 1)).cast("int"))))


def _in_blocks(rows: DataFrame, group: list[str], seed, block: int) -> DataFrame:
    """Rows with ``_block``: about ``block`` rows of a group, the clips dealt out by hash, none cut in two."""
    n = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    return rows.join(n, group).withColumn("_block", _block(seed, F.ceil(F.col("_n") / block))).drop("_n")


def _block(seed, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("clip", F.lit(str(seed))), blocks)


def _one_per_clip(table, order: list[str], better):
    """Row numbers of a block, one per clip: clips in the order of ``_h``, of each the row ``better`` likes least in a tuple to be smallest."""
    cols = {c: table[c].to_pylist() for c in table.column_names}
    rows = sorted(range(table.num_rows), key=lambda i: tuple(cols[c][i] if cols[c][i] is not None else "" for c in ["_h", "clip", "_c", "cand_id"]))
    keep, at = [], 0
    while at < len(rows):
        end = at
        while end < len(rows) and (cols["_h"][rows[end]], cols["clip"][rows[end]]) == (cols["_h"][rows[at]], cols["clip"][rows[at]]):
            end += 1
        keep.append(better(cols, rows[at:end]))
        at = end
    return keep


def greedy_balanced_pick(rows: DataFrame, seed, block: int = BLOCK, extra: tuple = (), blocks: dict | None = None) -> DataFrame:
    """One candidate per clip and family so that classes come out even.

    ``rows``: ``family, clip, akey, stratum, empty, cand_id``. Clips come in hash order; each takes
    the candidate whose class is rarest so far, empty ones only while they are below their cap. The
    order matters, so a task does it in one pass, over blocks of about ``block`` rows of a family: a
    large family is balanced in several blocks, each even in itself. A clip is never cut in two.
    ``extra`` columns come along; ``blocks`` says how many blocks each family has, where ``rows`` are only some of them."""
    columns = ["family", "clip", "akey", "stratum", "empty", "cand_id"]
    schema = rows.select(*columns, *extra).schema
    # of a clip's candidates of one class only the first in hash order can be taken: a clip with very many rows becomes a few
    first = F.struct(hash_order(seed, "family", "clip", "cand_id"), F.col("cand_id"))
    rows = rows.groupBy("family", "clip", "akey", "stratum", "empty").agg(F.min_by(F.struct("cand_id", *extra), first).alias("_p")).select(*columns[:5], "_p.*")
    many = blocks and F.create_map(*[F.lit(x).cast(t) for kv in blocks.items() for x, t in zip(kv, ("string", "long"))])[F.col("family")]
    d = (rows.withColumn("_block", _block(seed, many)) if blocks else _in_blocks(rows, ["family"], seed, block)).withColumn("_h", hash_order(seed, "family", "clip")).withColumn("_c", hash_order(seed, "family", "clip", "cand_id"))

    def pick(key, table):
        counts: dict = {}
        empty = taken = 0

        def better(cols, some):
            nonlocal empty, taken
            full = empty >= EMPTY_CAP * (taken + 1)
            best = min(some, key=lambda i: (cols["empty"][i] and full, counts.get((cols["stratum"][i], cols["akey"][i]), 0), cols["_c"][i]))
            at = (cols["stratum"][best], cols["akey"][best])
            counts[at] = counts.get(at, 0) + 1
            empty += bool(cols["empty"][best])
            taken += 1
            return best

        return table.take(_one_per_clip(table, columns, better)).select([*columns, *extra])

    return d.groupBy("family", "_block").applyInArrow(pick, schema)


def slot_picks(rows: DataFrame, seed) -> DataFrame:
    """``slot`` and the fields of :func:`greedy_balanced_pick`: a family may take several candidates of a clip, as many as its slots allow.

    Each slot picks from what the slots before left; a written table between them keeps the plan short. There are at most as many rounds as the largest
    number of slots."""
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv]), F.col("family")), F.lit(1))
    left, out = rows.select("family", "clip", "akey", "stratum", "empty", "cand_id").withColumn("_many", many), None
    for k in range(max(SLOTS.values())):
        part = cut(greedy_balanced_pick(left.where(F.col("_many") > k), f"{seed}|slot{k}"))
        out = part.withColumn("slot", F.lit(k)) if out is None else out.unionByName(part.withColumn("slot", F.lit(k)))
        left = left.where(F.col("_many") > k + 1).join(part.select("cand_id"), "cand_id", "left_anti")
    return out


def _shares(sizes: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int, int]]]:
    """Families (name, rows, blocks) in shares of about ``most`` rows: (name, first block, the one behind the last)."""
    out, room = [[]], most
    for name, n, blocks in sizes:
        at, each = 0, max(1, n // blocks)
        while at < blocks:
            if room < each and out[-1]:
                out.append([])
                room = most
            upto = min(blocks, at + max(1, room // each))
            out[-1].append((name, at, upto))
            room -= each * (upto - at)
            at = upto
    return out


def slot_picks_in_passes(rows: DataFrame, seed, most: int, extra: tuple = (), block: int = BLOCK) -> list[tuple[set, DataFrame]]:
    """The picks of :func:`slot_picks`, written a pass at a time: (families, table).

    A pass takes blocks of families with about ``most`` rows, which bounds what is shuffled at once; blocks are balanced apart, so the passes pick
    what one would. ``rows`` are read in each, so they should be written; ``fresh`` is true for the first row of a clip, family, class, stratum and ``empty``."""
    columns = ["family", "clip", "akey", "stratum", "empty", "cand_id", *extra]
    left, out = rows, []
    for k in range(max(SLOTS.values())):
        own = f"{seed}|slot{k}"
        if k:
            some = [f for f, many in SLOTS.items() if many > k]
            taken = [t.where(F.col("family").isin(some)).select("family", "cand_id") for families, t in out if families & set(some)]
            if not taken:
                break
            left = alone(lambda: cut(rows.where(F.col("family").isin(some)).join(reduce(DataFrame.unionByName, taken), ["family", "cand_id"], "left_anti").select(*columns)))
            distinct = left.select(*columns[:5]).distinct().groupBy("family").agg(F.count("*").alias("d"))
            sizes = left.groupBy("family").agg(F.count("*").alias("n")).join(distinct, "family")
        else:
            sizes = left.groupBy("family").agg(F.count("*").alias("n"), F.count_if("fresh").alias("d"))
        sizes = [(r.family, r.n, -(-r.d // block)) for r in sizes.orderBy("family").collect()]  # a row per family
        for share in _shares(sizes, most):
            if not share:
                continue
            blocks = {f: n for f, _, n in sizes if f in {x for x, _, _ in share}}
            mine = reduce(lambda a, b: a | b, [(F.col("family") == f) & (_block(own, F.lit(blocks[f]).cast("long")).between(lo, hi - 1) if hi - lo < blocks[f] else F.lit(True)) for f, lo, hi in share])
            picked = alone(lambda: cut(greedy_balanced_pick(left.where(mine).select(*columns), own, block, extra, blocks).withColumn("slot", F.lit(k)), codec="zstd"))  # noqa: B023
            out.append((set(blocks), picked))
        if k:
            discard(left)
    return out


def evaluation_subset(rows: DataFrame, seed, block: int = BLOCK, yesno: float = 0.08) -> DataFrame:
    """One record per clip and kind: clips in hash order, each takes the record whose concept is rarest so far, then whose family, then whose class.

    ``rows``: ``kind, clip, concept, family, akey, boolean, cand_id``. Yes/no records come last while they are ``yesno`` of their concept. Balanced per block, as
    :func:`greedy_balanced_pick`."""
    columns = ["kind", "clip", "concept", "family", "akey", "boolean", "cand_id"]
    d = _in_blocks(rows.select(*columns), ["kind"], seed, block).withColumn("_h", hash_order(seed, "kind", "clip")).withColumn("_c", hash_order(seed, "kind", "clip", "cand_id"))

    def pick(key, table):
        n: dict = {}
        count = lambda *k: n.get(k, 0)

        def better(cols, some):
            def rank(i):
                concept, family, akey = cols["concept"][i], cols["family"][i], cols["akey"][i]
                full = cols["boolean"][i] and count("yesno", concept) >= yesno * (count("concept", concept) + 1)
                return full, count("concept", concept), count("family", family), count("class", family, akey), cols["_c"][i]

            i = min(some, key=rank)
            for k in (("concept", cols["concept"][i]), ("family", cols["family"][i]), ("class", cols["family"][i], cols["akey"][i])):
                n[k] = n.get(k, 0) + 1
            n["yesno", cols["concept"][i]] = count("yesno", cols["concept"][i]) + bool(cols["boolean"][i])
            return i

        return table.take(_one_per_clip(table, columns, better)).select(columns)

    return d.groupBy("kind", "_block").applyInArrow(pick, rows.select(*columns).schema)


def build(rows: DataFrame, keys: list[str], seed, family_cap: int | None = None, concept_cap: int | None = None, most: int | None = None) -> DataFrame:
    """The whole selection: picks per slot, share rules of strata and families, size and empty caps, equal concepts, yes/no limit.

    ``rows``: candidates ``family, concept, understanding, clip, akey, stratum, empty, boolean, yes, cand_id``; ``keys`` identify them. ``family_cap`` bounds
    a family, ``concept_cap`` a concept (else all get what the scarcest can give). Steps between which rows are needed twice are written.
    With ``most`` all up to the equal concepts is done for about so many rows at a time (:func:`slot_picks_in_passes`), with the same result; the ``cand_id`` must differ."""
    if most is not None:
        return _evened(_kept_in_passes(rows, keys, seed, family_cap, most), keys, seed, concept_cap)
    facts = rows.select(*keys, "concept", "understanding", "boolean", "yes")
    picks = slot_picks(rows, seed).join(facts, keys)
    return _evened(_kept(picks, keys, seed, family_cap), keys, seed, concept_cap)


def _kept(picks: DataFrame, keys: list[str], seed, family_cap: int | None, apart: bool = False) -> DataFrame:
    """Of whole families the picks within the share rules, the size and the share of empties, written."""
    of = picks.groupBy("family").agg(F.bool_and("boolean").alias("yesno"))
    picks = cut(picks.drop("boolean").join(F.broadcast(of) if apart else of, "family").withColumn("boolean", F.col("yesno")).withColumn("stratum", F.coalesce("stratum", F.lit(""))))
    kept = family_trim(picks, keys, seed, apart=apart)
    if family_cap is not None:
        kept = proportional_subsample(kept, ["family"], ["stratum", "akey"], keys, family_cap, seed)
    return cut(empties_capped(kept, ["family"], keys, seed))


def _kept_in_passes(rows: DataFrame, keys: list[str], seed, family_cap: int | None, most: int) -> DataFrame:
    """The rows of :func:`_kept`, whole families with about half of ``most`` picks at a time, as a trim shuffles wider rows; the picks go when all are done."""
    parts = slot_picks_in_passes(rows, seed, most, ("concept", "understanding", "boolean", "yes"))
    if not parts:
        return _kept(slot_picks(rows, seed).join(rows.select(*keys, "concept", "understanding", "boolean", "yes"), keys), keys, seed, family_cap)
    sizes = [(r.family, r["count"], 1) for r in reduce(DataFrame.unionByName, [t for _, t in parts]).groupBy("family").count().orderBy("family").collect()]
    out = []
    for share in _shares(sizes, most // 2):
        names = {f for f, _, _ in share}
        own = reduce(DataFrame.unionByName, [t for families, t in parts if families & names]).where(F.col("family").isin(sorted(names)))
        out.append(alone(lambda: _kept(own, keys, seed, family_cap, apart=True)))  # noqa: B023
    for _, t in parts:
        discard(t)
    return reduce(DataFrame.unionByName, out)


def _evened(kept: DataFrame, keys: list[str], seed, concept_cap: int | None) -> DataFrame:
    """Kept picks with their concepts equal and their yes/no rows limited."""
    quota = concept_quota(kept, concept_cap).groupBy("understanding", "concept", "family").agg(F.sum("alloc").alias("target"))
    thin = cut(thinned(kept, ["understanding", "concept", "family"], ["stratum", "akey"], keys, quota, seed))
    return thin.where("not understanding").unionByName(yesno_trim(thin.where("understanding"), keys, seed))


