"""Frequency of every distinct term, by burst tries on the workers and merged subtrees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.llm.terms import SQL_TERMS, distinct_items, item_terms
from notefold.runtime import cut, tables

BURST = 1024
DEEPEST = 64
TRIE_TERMS = 500_000
ROUTE_TERMS = 50_000
MOST_ROUTES = 4096
RARE_ITEMS = 2
COMMON_SHARE = "0.06"


class BurstTrie:
    """Terms with two counters. A container holds up to ``burst`` suffixes; one that grows beyond
    bursts into a node with a container per next character, so prefixes lengthen only where terms crowd."""

    __slots__ = ("burst", "root", "deepest", "size")

    def __init__(self, burst: int = BURST, deepest: int = DEEPEST):
        self.burst, self.deepest, self.root, self.size = burst, deepest, [{}, None], 0  # [container, children or None]

    def add(self, term: str, times: int, items: int) -> None:
        node, depth = self.root, 0
        while node[1] is not None and depth < len(term):
            child = node[1].get(term[depth])
            if child is None:
                child = node[1][term[depth]] = [{}, None]
            node, depth = child, depth + 1
        box, rest = node[0], term[depth:]
        old = box.get(rest)
        if old is not None:
            old[0] += times
            old[1] += items
            return
        box[rest] = [times, items]
        self.size += 1
        if node[1] is None and len(box) > self.burst and depth < self.deepest:
            node[1] = {}
            node[0] = {"": box.pop("")} if "" in box else {}
            for suffix, counts in box.items():
                child = node[1].setdefault(suffix[0], [{}, None])
                child[0][suffix[1:]] = counts

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """Every container that holds terms, with its prefix."""
        stack = [("", self.root)]
        while stack:
            prefix, (box, children) = stack.pop()
            if box:
                yield prefix, box
            if children:
                stack.extend((prefix + c, n) for c, n in children.items())


def pack(box: dict) -> bytes:
    """A container as compact bytes: sorted suffixes, front-coded, with their counters as varints."""
    out, before = bytearray(), b""
    for suffix in sorted(box):
        s = suffix.encode("utf-8", "surrogatepass")
        same = 0
        while same < min(len(s), len(before)) and s[same] == before[same]:
            same += 1
        for n in (same, len(s) - same, *box[suffix]):
            while n > 127:
                out.append(n & 127 | 128)
                n >>= 7
            out.append(n)
        out += s[same:]
        before = s
    return bytes(out)


def unpack(data: bytes) -> Iterator[tuple[str, int, int]]:
    pos, before = 0, b""
    while pos < len(data):
        numbers = []
        for _ in range(4):
            n = shift = 0
            while True:
                b = data[pos]
                pos += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            numbers.append(n)
        same, more, times, items = numbers
        before = before[:same] + data[pos : pos + more]
        pos += more
        yield before.decode("utf-8", "surrogatepass"), times, items


def _tries(batches):
    """One trie per field from the batches of a task; emits its containers and, as part -1, the items with a term.

    A trie with ``TRIE_TERMS`` terms is emitted and begun anew, so its size does not grow with the task."""
    tries: dict[str, BurstTrie] = {}
    holders: dict[str, int] = {}
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["field_name", "term"]).aggregate([("times", "sum"), ("times", "count"), ("first", "sum")])
        for f, term, times, items, first in zip(*(t[c].to_pylist() for c in ("field_name", "term", "times_sum", "times_count", "first_sum"))):
            holders[f] = holders.get(f, 0) + first
            if f not in tries:
                tries[f] = BurstTrie()
            tries[f].add(term, times, items)
            if tries[f].size >= TRIE_TERMS:
                yield from _emitted(f, tries.pop(f))
    for f, trie in tries.items():
        yield from _emitted(f, trie)
    if holders:
        yield _batch([(f, "", -1, n, b"") for f, n in holders.items()])


def _emitted(field: str, trie: BurstTrie):
    rows = []
    for prefix, box in trie.leaves():
        rows.append((field, prefix, 0, len(box), pack(box)))
        if len(rows) >= 512:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


_PART = "field_name string, prefix string, part int, n long, body binary"


def _batch(rows):
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["field_name", "prefix", "part", "n", "body"])


def _route(heavy: dict, parts: int):
    """Containers cut along the routes: a term goes to its shortest prefix that isn't heavy, and there to one of ``parts`` by its hash.

    Terms that are a heavy prefix themselves stay at it; where even the longest prefix looked at is heavy, it has as many parts as its terms ask for."""

    def run(batches):
        for b in batches:
            rows = []
            for f, prefix, body in zip(*(b.column(c).to_pylist() for c in ("field_name", "prefix", "body"))):
                boxes: dict[tuple[str, int], dict] = {}
                whole = next((prefix[:k] for k in range(min(len(prefix), DEEPEST) + 1) if (f, prefix[:k]) not in heavy), None)
                for suffix, times, items in unpack(body):
                    term, route, among = prefix + suffix, whole, parts
                    if route is None:
                        last = min(len(term), DEEPEST)
                        route = next((term[:k] for k in range(min(len(prefix), DEEPEST), last + 1) if (f, term[:k]) not in heavy), None)
                        if route is None:
                            route, among = term[:last], -(-heavy[f, term[:last]] // ROUTE_TERMS)
                    part = zlib.crc32(term.encode("utf-8", "surrogatepass")) % among if among > 1 else 0
                    boxes.setdefault((route, part), {})[term[len(route) :]] = (times, items)
                rows += [(f, route, part, len(box), pack(box)) for (route, part), box in boxes.items()]
            if rows:
                yield _batch(rows)

    return run


def _merge(key, table):
    """All subtrees of one part of a route joined into one."""
    field, route = key[0].as_py(), key[1].as_py()
    box: dict[str, list] = {}
    for body in table["body"]:
        for suffix, times, items in unpack(body.as_py()):
            old = box.get(suffix)
            if old is None:
                box[suffix] = [times, items]
            else:
                old[0] += times
                old[1] += items
    cols = [[field] * len(box), [route + s for s in box], [c[0] for c in box.values()], [c[1] for c in box.values()]]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["field_name", "term", "times", "items"])


def term_counts(terms: DataFrame, routes: int | None = None) -> DataFrame:
    """``field_name, term, times, items, holders`` of ``field_name, first, term, times`` rows.

    ``times`` counts occurrences, ``items`` the rows (one per item), ``holders`` the items with any
    term of the field. Each task counts its rows in burst tries per field, which is the combine
    before the shuffle: a term in a third of all rows is one entry per trie. The containers are
    written once. Prefixes with more than 1/``routes`` of all entries below them are heavy; there
    are at most ``routes`` of them per length up to ``DEEPEST``, a bound that does not grow with the
    data. Terms are routed by their shortest prefix that is not heavy, and by hash into so many parts of it that
    each has about ``ROUTE_TERMS`` entries; the subtrees of a part are merged in one task. Terms that have their first ``DEEPEST`` characters
    in common are parted in the same way. Null terms must have been left out; an empty table gives no rows."""
    spark = terms.sparkSession
    written = cut(terms.mapInArrow(_tries, _PART))
    leaves = written.where("part = 0")
    routes = routes or min(MOST_ROUTES, max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    total = leaves.agg(F.sum("n")).first()[0] or 0
    least = max(total // routes, BURST)
    lengths = F.explode(F.sequence(F.lit(0), F.least(F.char_length("prefix"), F.lit(DEEPEST))))
    heavy = (
        leaves.select("field_name", "prefix", "n", lengths.alias("k")).groupBy("field_name", F.substring(F.col("prefix"), F.lit(1), F.col("k")).alias("prefix"))
        .agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(least))
    )
    known = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in heavy.select("field_name", "prefix", "n").collect()})
    parts = -(-least // ROUTE_TERMS)
    cuts = leaves.mapInArrow(lambda batches: _route(known.value, parts)(batches), _PART)
    merged = cuts.groupBy("field_name", "prefix", "part").applyInArrow(_merge, "field_name string, term string, times long, items long")
    holders = written.where("part = -1").groupBy("field_name").agg(F.sum("n").alias("holders"))
    return merged.join(F.broadcast(holders), "field_name")  # a row per field


def marked(counts: DataFrame, rare: int = RARE_ITEMS, common: str = COMMON_SHARE) -> DataFrame:
    """``mark``: rare with at most ``rare`` items, common with more than the share ``common`` of the holders, else null."""
    share = F.col("items").cast("decimal(20,0)") > F.col("holders").cast("decimal(20,0)") * F.lit(common).cast("decimal(10,6)")
    return counts.withColumn("mark", F.when(F.col("items") <= rare, "rare").when(share, "common"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(term_counts(item_terms(distinct_items(tables(spark, sf_dir)("qa_items"), "gold_answer", "concept", "query_key"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("field_name", "term", "times", "items", "mark")


_SQL = f"""with {SQL_TERMS},
cnt as (select field_name, term, count(*) as times, count(distinct item_id) as items from term group by all),
hold as (select field_name, count(distinct item_id) as holders from term group by all),
m as (select c.*, case when items <= {RARE_ITEMS} then 'rare' when items > holders * {COMMON_SHARE} then 'common' end as mark from cnt c join hold using (field_name))
"""
QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
ORACLE = {"p4_found": _SQL + "select field_name, term, mark from m where mark is not null", "p4_counts": _SQL + "select field_name, term, times, items, mark from m"}
