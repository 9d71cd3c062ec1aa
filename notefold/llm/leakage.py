"""Evaluation texts in training text: one Aho-Corasick automaton over all windows of the passages."""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.runtime import tables

WORDS = 10
MOST_PASSAGE_MB = 32
MOST_WORDS = 1_000_000
REPEATS = 8

# fixed values: characters that are dropped before words are read
DROPPED = "\u200b\u200c\u200d\ufeff\u00ad"
_DROP = {ord(c): None for c in DROPPED}
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text: runs of letters and digits of its NFKC lower-case form without dropped characters."""
    if not text:
        return []
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(_DROP)).lower())


def word_offsets(text: str) -> list[tuple[str, int, int]]:
    """As :func:`words`, each with the range of the original text it comes from.

    White space ends every word and no normalisation reaches across it, so each run between white
    space is normalised alone; where its length changes, its words share the whole run's range."""
    out = []
    for run in re.finditer(r"\S+", text):
        kept = [i for i in range(run.start(), run.end()) if ord(text[i]) not in _DROP]
        form = unicodedata.normalize("NFKC", "".join(text[i] for i in kept)).lower()
        exact = len(form) == len(kept)
        for w in _WORD.finditer(form):
            out.append((w[0], kept[w.start()], kept[w.end() - 1] + 1) if exact else (w[0], run.start(), run.end()))
    return out


class Windows:
    """The automaton over the passages; built once in a worker process.

    Each different word of the passages is one character of the automaton's alphabet, any other
    word the separator, so a text is scanned by words. Any run of ``size`` words holds one of the blocks of
    (size + 1) // 2 words that a passage is cut into, so the blocks are the patterns, about one node a word of the passages, and a
    block that is met is extended to both sides. A passage that repeats itself, for which the same block stands at many
    places, gives its different windows of ``size`` words instead."""

    _last: tuple | None = None

    def __init__(self, passages: list[tuple[int, str]], size: int):
        import ahocorasick

        self.size, self.block, self.letter = size, (size + 1) // 2, {}
        ids: dict[str, set] = {}
        for pid, text in passages:
            w = words(text)
            if len(w) >= size:
                code = "".join([self.letter.setdefault(x, self._char(len(self.letter))) for x in w])
                ids.setdefault(code, set()).add(pid)
        if len(self.letter) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} different words in one block of passages")
        self.codes = list(ids)
        self.ids = [tuple(v) for v in ids.values()]
        patterns: dict[str, list] = {}
        for k, code in enumerate(self.codes):
            blocks: dict[str, list] = {}
            for at in range(0, len(code) - self.block + 1, self.block):
                blocks.setdefault(code[at : at + self.block], []).append((k, at))
            if all(len(v) <= REPEATS for v in blocks.values()):
                for x, places in blocks.items():
                    patterns.setdefault(x, []).extend(places)
            else:
                for x in {code[i : i + size] for i in range(len(code) - size + 1)}:
                    patterns.setdefault(x, []).append((k, -1))
        self.any = bool(patterns)
        self.automaton = ahocorasick.Automaton()
        for x, places in patterns.items():
            self.automaton.add_word(x, (len(x), places))
        if patterns:
            self.automaton.make_automaton()

    @staticmethod
    def _char(i: int) -> str:
        """The i-th character after the separator, without the surrogates."""
        return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)

    @classmethod
    def once(cls, shared, size: int) -> Windows:
        if cls._last is None or cls._last[0] is not shared or cls._last[1] != size:
            cls._last = (shared, size, cls(shared.value, size))
        return cls._last[2]

    def hits(self, text: str | None) -> dict[int, list[tuple[int, int]]]:
        """Passage id -> first and last word number of each shared run, overlapping ones joined."""
        w = words(text) if self.any else []
        if len(w) < self.size:
            return {}
        letter = self.letter.get
        s = "".join([letter(x, "\0") for x in w])
        starts: dict[int, list[tuple[int, int]]] = {}  # passage -> first and last start of shared windows
        reached: dict[tuple[int, int], int] = {}  # (passage, shift) -> end of what is compared
        for last, (n, places) in self.automaton.iter(s):
            first = last - n + 1
            for k, at in places:
                if at < 0:
                    starts.setdefault(k, []).append((first, first))
                    continue
                if reached.get((k, first - at), 0) > first:
                    continue
                code, a, z, i, j = self.codes[k], first, last + 1, at, at + n
                while a > 0 and i > 0 and s[a - 1] == code[i - 1]:
                    a, i = a - 1, i - 1
                while z < len(s) and j < len(code) and s[z] == code[j]:
                    z, j = z + 1, j + 1
                reached[k, first - at] = z
                if z - a >= self.size:
                    starts.setdefault(k, []).append((a, z - self.size))
        runs: dict[int, list[tuple[int, int]]] = {}
        for k, ranges in starts.items():
            mine: list[list[int]] = []
            for a, z in sorted(ranges):
                if mine and a <= mine[-1][1] + 1:
                    mine[-1][1] = max(mine[-1][1], z)
                else:
                    mine.append([a, z])
            for pid in self.ids[k]:
                runs[pid] = [(a, z + self.size - 1) for a, z in mine]
        return runs


def leaked(docs: DataFrame, doc_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, size: int = WORDS) -> DataFrame:
    """``doc_id, eval_id, first_char, last_char, n_words``: each run of at least ``size`` words that a
    document shares with a passage, with its place in the original text.

    The passages are the held-out side, which does not grow with the corpus: their size is checked before they are
    broadcast. Up to ``MOST_PASSAGE_MB`` (some 200 MB of automaton in a worker) each text is normalised and scanned once, in one
    pass, without a shuffle; only a larger set is scanned in as many blocks as its size asks for, with the same rows. A block may have up to
    ``MOST_WORDS`` different words, the size of the alphabet. Offsets are worked out only for texts with a hit. Null and empty texts or passages, and passages shorter
    than ``size`` words, have no runs. Equal passages under several ids are all reported."""
    spark = docs.sparkSession
    p = passages.select(F.col(passage_id).alias("pid"), F.col(passage).alias("passage")).where("pid is not null and passage is not null").distinct()
    mb = (p.agg(F.sum(F.octet_length("passage"))).first()[0] or 0) / 1e6
    blocks = max(1, math.ceil(mb / MOST_PASSAGE_MB))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    types = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, eval_id {p.schema['pid'].dataType.simpleString()}, first_char int, last_char int, n_words int"
    out = None
    for k in range(blocks):
        part = p if blocks == 1 else p.where(F.pmod(F.xxhash64("pid"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
        found = src.mapInArrow(_scan(shared, size), types)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(shared, size: int):
    def run(batches):
        windows = Windows.once(shared, size)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = windows.hits(text)
                if hits:
                    places = word_offsets(text)
                    for pid, runs in hits.items():
                        rows += [(doc, pid, places[a][1], places[z][2], z - a + 1) for a, z in runs]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "eval_id", "first_char", "last_char", "n_words"])

    return run


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return leaked(t("documents"), "doc_id", "text", t("eval_items"), "eval_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("doc_id", "eval_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    items = tables(spark, sf_dir)("eval_items").select("eval_id", "split").distinct()
    return p8_found(spark, sf_dir).groupBy("eval_id").agg(F.count("*").alias("documents")).join(items, "eval_id").select("eval_id", "split", "documents")


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_report": p8_report}
ORACLE: dict[str, str] = {}
