"""Filling containers of fixed capacity with texts: bin completion with best-fit incumbents."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.runtime import cut, tables

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published splitting pattern of this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_ITEMS = 512
NODES = 400
FILLINGS = 6
STEPS = 120
FULL = 0.99
MOST_CONTAINERS = 1000

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, read once in a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """``doc_id, tokens`` of whole texts; null and empty texts have 0. The vocabulary at the driver's path ``tokenizer`` is sent to the workers."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers per bin; ``sizes`` in falling order."""
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[list[int]] = []
    for i, s in enumerate(sizes):
        k = bisect_left(rooms, (s, -1))
        if k == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - s, len(bins) - 1))
        else:
            room, b = rooms.pop(k)
            bins[b].append(i)
            insort(rooms, (room - s, b))
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A number of bins below which no packing can go; ``sizes`` in falling order.

    For each threshold k up to half the capacity: items above capacity - k are alone, those above half have a bin each,
    and the items from k to half that do not fit into the room these leave need bins of their own. Items below k only help, so the
    highest of these counts holds; k = 0 gives the total over the capacity."""
    n = len(sizes)
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    rising = [-s for s in sizes]
    big = bisect_left(rising, -(capacity // 2))  # items above half
    best = -(-total[n] // capacity)
    for k in dict.fromkeys(sizes[big:]):
        alone = bisect_left(rising, k - capacity)  # items above capacity - k
        upto = bisect_right(rising, -k)
        room = (big - alone) * capacity - (total[big] - total[alone])
        best = max(best, big + max(0, -(-(total[upto] - total[big] - room) // capacity)))
    return best


def _dominated(chosen: list[int], slack: int, others: list[int]) -> bool:
    """True if one of ``others`` (sizes left out) may stand for some of the ``chosen`` sizes, or beside them, to advantage.

    It may if it is at least their sum and at most ``slack`` more: whatever held it can hold them instead. One equal item is no
    advantage. Sums are bits of one number."""
    many, single = 1, 0  # sums of no or of several items, sums of one item
    every = 1
    for s in chosen:
        many |= (every ^ 1) << s
        single |= 1 << s
        every |= every << s
    for x in others:
        low = max(0, x - slack)
        window = ((1 << (x - low + 1)) - 1) << low
        if many & window or single & window & ~(1 << x):
            return True
    return False


def fillings(sizes: list[int], left: list[int], room: int, most: int | None = None, steps: int | None = None) -> list[list[int]]:
    """The undominated sets of the items ``left`` that go into ``room``, fullest first.

    A set is dominated if another one holds a larger item in the place of some of its items or one item more (Martello and Toth);
    some best packing uses undominated sets only. Sets are built from the largest size down; a branch ends when what
    follows cannot fill the room up to the smallest size left out. Without ``most`` and ``steps`` all are found. With them the
    search ends after so many sets or steps, or at a set that leaves no room; the first set built is always among those given."""
    groups: list[tuple[int, list[int]]] = []
    for i in left:
        if sizes[i] <= room:
            if groups and groups[-1][0] == sizes[i]:
                groups[-1][1].append(i)
            else:
                groups.append((sizes[i], [i]))
    if groups and groups[0][0] == room:
        return [[groups[0][1][0]]]  # one item that fills the room stands for any other set
    rest = [0]
    for s, items in reversed(groups):
        rest.append(rest[-1] + s * len(items))
    rest.reverse()
    found: list[tuple[int, list[int]]] = []
    first: list | None = None
    count = 0

    def search(at: int, room: int, chosen: list[int], out: int) -> bool:
        """``out``: the smallest size that fits and is left out. True: enough is found."""
        nonlocal first, count
        count += 1
        while at < len(groups) and groups[at][0] > room:
            at += 1
        if at == len(groups):
            if room < out:
                if first is None:
                    first = [(room, chosen)]
                taken = set(chosen)
                others = [s for s, items in groups if any(i not in taken for i in items)]
                if not _dominated([sizes[i] for i in chosen], room, others):
                    found.append((room, chosen))
            return (most is not None and (room == 0 and bool(found) or len(found) >= most)) or (steps is not None and count > steps)
        for g in range(at, len(groups)):
            s, items = groups[g]
            if room - rest[g] >= out:
                break
            for k in range(min(len(items), room // s), 0, -1):
                if search(g + 1, room - k * s, [*chosen, *items[:k]], out if k == len(items) else min(out, s)):
                    return True
            out = min(out, s)
        return steps is not None and count > steps

    search(0, room, [], room + 1)
    found.sort(key=lambda x: x[0])
    return [c for _, c in found or first or [(room, [])]]


def bin_completion(sizes: list[int], capacity: int, nodes: int | None = NODES, most: int = FILLINGS, steps: int = STEPS) -> list[list[int]]:
    """Items packed into as few bins as the search finds; ``sizes`` in falling order, none above ``capacity``.

    The incumbent is best-fit decreasing. Each node completes a bin around the largest item left with undominated
    fillings, fullest first; a branch ends when the bins so far and :func:`least_bins` of the rest cannot beat the
    incumbent, and the search when that bound is met. With ``nodes=None`` every undominated filling is tried and the packing is
    the best possible; the time may then grow exponentially. Else the search ends after ``nodes`` nodes, each with at
    most ``most`` fillings found in ``steps`` steps, with the best packing so far. Items of size 0 go along free."""
    best = best_fit(sizes, capacity)
    items = [i for i, s in enumerate(sizes) if s > 0]
    zero = [i for i, s in enumerate(sizes) if s == 0]
    bound = least_bins([sizes[i] for i in items], capacity)
    if len(best) <= max(bound, 1):
        return best
    seen = 0
    todo: list = [(items, [])]
    while todo and (nodes is None or seen < nodes) and len(best) > bound:
        left, bins = todo.pop()
        seen += 1
        if not left:
            if len(bins) < len(best):
                best = [list(b) for b in bins]
                best[0].extend(zero)
            continue
        if len(bins) + least_bins([sizes[i] for i in left], capacity) >= len(best):
            continue
        first, others = left[0], left[1:]
        sets = fillings(sizes, others, capacity - sizes[first]) if nodes is None else fillings(sizes, others, capacity - sizes[first], most, steps)
        for chosen in reversed(sets):  # the fullest is tried first
            gone = set(chosen)
            todo.append(([i for i in others if i not in gone], [*bins, [first, *chosen]]))
    return best


def _pack(key, table):
    """One block of items of one container, packed."""
    container, block, capacity = table["container_id"][0].as_py(), table["block"][0].as_py(), table["capacity"][0].as_py()
    docs, piece, sizes = table["doc_id"].to_pylist(), table["piece"].to_pylist(), table["tokens"].to_pylist()
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], docs[i], piece[i]))
    bins = bin_completion([sizes[i] for i in order], capacity)
    rows = [(container, f"{block}-{n}", sum(sizes[order[i]] for i in b), docs[order[i]], piece[order[i]], sizes[order[i]]) for n, b in enumerate(bins) for i in b]
    cols = list(zip(*rows))
    kinds = [table.schema.field("container_id").type, pa.string(), pa.int64(), table.schema.field("doc_id").type, pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["container_id", "bin_id", "filled", "doc_id", "piece", "tokens"])


def _round(items: DataFrame, name: str) -> DataFrame:
    """Items into blocks of about ``BLOCK_ITEMS`` at random, and each block packed."""
    n = items.groupBy("container_id").agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias("blocks"))
    block = F.concat(F.lit(name), F.pmod(F.xxhash64("doc_id", "piece", F.lit(name)), F.col("blocks")).cast("string"))
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    out = f"container_id {types['container_id']}, bin_id string, filled long, doc_id {types['doc_id']}, piece long, tokens long"
    return items.join(F.broadcast(n), "container_id").withColumn("block", block).drop("blocks").groupBy("container_id", "block").applyInArrow(_pack, out)


def pack(counts: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_id, bin_id, filled, doc_id, piece, first_token, tokens``: each text in bins of each container.

    Only a text longer than the capacity is cut: into full containers and one rest, which is an
    item like any other. Items go to blocks by hash, each block is packed by bin completion, and the
    bins filled to less than ``FULL`` are opened once more: their items form a few blocks of a second
    round, so that only the last bins there stay loose. Work and memory of a task are bounded by
    ``BLOCK_ITEMS`` whatever the data. There may be up to ``MOST_CONTAINERS`` containers; without rows, or with a capacity that is
    null or not positive, nothing is packed. Texts of no tokens take no room but have a place. Repeated ids are
    different texts only if their token counts differ."""
    c = containers.where("capacity_tokens > 0 and container_id is not null").groupBy("container_id").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    boxes = c.limit(MOST_CONTAINERS + 1).collect()
    if len(boxes) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} containers")
    kind = c.schema["container_id"].dataType
    each = F.array(*[F.struct(F.lit(r[0]).cast(kind).alias("container_id"), F.lit(r[1]).cast("long").alias("capacity")) for r in boxes]) if boxes else F.array().cast(f"array<struct<container_id:{kind.simpleString()},capacity:bigint>>")
    many = counts.where("doc_id is not null").select("doc_id", "tokens").distinct().select("doc_id", "tokens", F.inline(each))
    full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0).cast("long")
    sized = cut(many.withColumn("full", full))
    whole = sized.where("full > 0").select("container_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("container_id", F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"), F.col("capacity").alias("filled"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    rest = sized.select("container_id", "capacity", "doc_id", F.col("full").alias("piece"), (F.col("tokens") - F.col("full") * F.col("capacity")).alias("tokens"), "full").where("full = 0 or tokens > 0").drop("full")
    one = cut(_round(rest, "a").join(F.broadcast(c), "container_id"))
    loose = F.col("filled") < F.col("capacity") * FULL
    two = _round(one.where(loose).select("container_id", "capacity", "doc_id", "piece", "tokens"), "b")
    packed = whole.unionByName(one.where(~loose).drop("capacity")).unionByName(two)
    return packed.join(F.broadcast(c), "container_id").select("container_id", "bin_id", "filled", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), "tokens")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return pack(token_counts(t("documents"), "doc_id", "text", TOKENIZER), t("containers"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, their least possible number and the share of room used, per container."""
    p = _packed(spark, sf_dir)
    c = tables(spark, sf_dir)("containers").select("container_id", "capacity_tokens")
    n = p.groupBy("container_id").agg(F.count_distinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("texts"))
    return n.join(c, "container_id").select("container_id", "bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), "texts", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))


QUERIES = {"p7_packing": p7_packing, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
