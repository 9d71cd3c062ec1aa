import random
from collections import Counter

from pyspark.sql import functions as F

from notefold.llm import frequency as L
from notefold.llm import terms as T


def test_trie_counts_and_bursts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé\U0001f3b5") for _ in range(rng.randrange(0, 9))) for _ in range(3000)] + ["x" * 500]
    t = L.BurstTrie(burst=8)
    for w in words:
        t.add(w, 1, 1)
    leaves = list(t.leaves())
    got = {p + s: c[0] for p, box in leaves for s, c in box.items()}
    assert got == Counter(words) and max(len(b) for _, b in leaves) <= 9 and len(leaves) > 50
    for _, box in leaves:
        assert {s: (a, b) for s, a, b in L.unpack(L.pack(box))} == {s: tuple(c) for s, c in box.items()}


def test_counts_against_counter(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "BURST", 4)
    rng = random.Random(4)
    data = []
    for i in range(3000):
        field = rng.choice(["a", "b"])
        term = "hot" if rng.random() < 0.4 else f"q/{rng.randrange(300):04}" + "y" * rng.randrange(3)
        data.append((field, 1, term, rng.randrange(1, 4)))
    df = spark.createDataFrame(data, "field_name string, first long, term string, times long").repartition(6)
    got = rows(L.term_counts(df, routes=16))
    occ, rec, hold = Counter(), Counter(), Counter()
    for f, first, t, n in data:
        occ[f, t] += n
        rec[f, t] += 1
        hold[f] += first
    assert got == sorted(((f, t, occ[f, t], rec[f, t], hold[f]) for f, t in occ), key=repr)
    assert rows(L.term_counts(df.where("false"))) == []


def test_terms_of_gold_answers(spark):
    cases = {'"Major "': ["major"], "2.0": ["2"], '"0.50"': ["0.5"], "true": ["true"], '"TRUE"': ["true"], "null": [], None: [], " ": [], '""': [], '["C", "c ", null, 3.0]': ["c", "c", "3"], "[]": [], "plain text": ["plain text"], '[["a"]]': ['["a"]'], '{"a": 1}': ['{"a":1}'], " 7 ": ["7"]}
    d = spark.createDataFrame([(k,) for k in cases], "g string")
    got = {r.g: (r.t, r.c) for r in d.select("g", T.gold_terms(F.col("g")).alias("t"), T.gold_category(F.col("g")).alias("c")).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got['["C", "c ", null, 3.0]'][1] is None and got["2.0"][1] == "2" and got["null"][1] is None


def test_marks_and_redelivery(spark, rows):
    from datetime import datetime

    t = [datetime(2025, 1, 1), datetime(2025, 2, 1)]
    data = [(i, "x", f"k{i % 50}", '["a", "a"]' if i else None, t[0]) for i in range(200)] + [(1, "x", "k1", '["a", "a"]', t[1]), (500, " ", None, "null", t[0]), (None, "x", "x", "1", t[0])]
    qa = spark.createDataFrame([(*d, 1) for d in data], "item_id long, concept string, query_key string, gold_answer string, loaded_at timestamp_ntz, first int")
    c = {(r.field_name, r.term): (r.times, r["items"], r.mark) for r in L.marked(L.term_counts(T.item_terms(T.distinct_items(qa, "gold_answer", "concept", "query_key")))).collect()}
    assert c["concept", "x"] == (200, 200, "common") and c["gold_answer", "a"] == (398, 199, "common") and c["query_key", "k1"] == (4, 4, None)
    assert len(c) == 52


def test_long_common_beginnings_are_parted(spark, rows, monkeypatch):
    """Terms that share far more characters than prefixes are looked at, tries that are emitted early, and small parts."""
    for name, value in (("BURST", 4), ("DEEPEST", 6), ("TRIE_TERMS", 50), ("ROUTE_TERMS", 8)):
        monkeypatch.setattr(L, name, value)
    monkeypatch.setattr(L.BurstTrie.__init__, "__defaults__", (4, 6))
    rng = random.Random(5)
    words = ["x" * 200 + str(i) for i in range(300)] + ["x" * k for k in range(1, 20)] + [str(i) for i in range(200)] + ["", "\0", "x\0", "é" * 300]
    data = [("a", 1, rng.choice(words), 1) for _ in range(4000)]
    df = spark.createDataFrame(data, "field_name string, first long, term string, times long").repartition(5)
    got = rows(L.term_counts(df, routes=16).select("field_name", "term", "times", "items"))
    n = Counter(t for _, _, t, _ in data)
    assert got == sorted((("a", t, c, c) for t, c in n.items()), key=repr)


def test_parts_of_a_route(monkeypatch):
    """A heavy longest prefix is cut into parts of about the same size; equal terms of two containers meet."""
    monkeypatch.setattr(L, "DEEPEST", 3)
    monkeypatch.setattr(L, "ROUTE_TERMS", 100)
    heavy = {("f", ""): 1000, ("f", "x"): 1000, ("f", "xx"): 1000, ("f", "xxx"): 1000}
    box = L.pack({f"xxxx{i}": (1, 1) for i in range(1000)} | {"": (1, 1), "x": (2, 1), "a": (1, 1)})
    batch = L._batch([("f", "", 0, 1003, box)] * 2)
    out = [r for b in L._route(heavy, 1)([batch]) for r in b.to_pylist()]
    sizes = Counter()
    for r in out:
        sizes[r["prefix"], r["part"]] += r["n"]
    deep = [n for (p, _), n in sizes.items() if p == "xxx"]
    assert len(deep) == 10 and max(deep) < 2 * 150 and sum(sizes.values()) == 2 * 1003
    assert sizes["", 0] == 2 or sizes["", 0] + sum(n for (p, k), n in sizes.items() if p == "" and k) == 2
    place = {}
    for r in out:
        for s, _, _ in L.unpack(r["body"]):
            assert place.setdefault(r["prefix"] + s, (r["prefix"], r["part"])) == (r["prefix"], r["part"])
