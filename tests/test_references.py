import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from notefold.functions.ids import clip_id, path_key, plain_number, split_name
from notefold.operators import references as R

T0 = datetime(2025, 1, 1)


def test_ids(spark, rows):
    d = spark.createDataFrame([(" Train\\midi\\Train_01.MID ",), ("a/b/x_1.json",), ("  ",), (None,), ("./x",), ("x.wav",)], "v string")
    assert [r[0] for r in d.select(clip_id(F.col("v"))).collect()] == ["train_01", "x_1", None, None, "x", "x"]
    p = spark.createDataFrame([("/A//b\\c.WAV ",), ("./a/b/c.wav",), ("a/b/c.wav",), ("",), (None,), ("/./a/b/c.wav",)], "v string")
    assert [r[0] for r in p.select(path_key(F.col("v"))).collect()] == ["a/b/c.wav"] * 3 + [None, None, "a/b/c.wav"]
    s = spark.createDataFrame([(" VAL", "train_1"), (None, "test_9"), (" ", "test_9")], "s string, i string")
    assert [r[0] for r in s.select(split_name(F.col("s"), F.col("i"))).collect()] == ["val", "test", "test"]


def test_numbers(spark):
    cases = {"8": "8", "8.0": "8", "0.50": "0.5", ".5": "0.5", "-0": "0", "+3": "3", "007": "7", "0": "0", "0.0": "0", "-1.20": "-1.2", "5.": "5", "1/2": "1/2", "c4": "c4", "-": "-", ".": ".", "100": "100", "1" * 50 + ".0": "1" * 50}
    d = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r[0]: r[1] for r in d.select("v", plain_number(F.col("v"))).collect()} == cases


def _parents(spark, data):
    # clashing names of the operator's own columns are in the input on purpose
    d = spark.createDataFrame([(k, a, r, 1, "x", 2) for k, a, r in data], "key string, t timestamp_ntz, d timestamp_ntz, tag int, parent string, open int")
    return R.parent_keys(d, "p", F.col("key"), F.col("t"), F.col("d"))


def _children(spark, data):
    d = spark.createDataFrame([(i, k, t, "z") for i, k, t in data], "ref_key string, key string, t timestamp_ntz, salt string")
    return R.child_keys(d, "c", "f", "p", F.col("key"), F.col("ref_key"), F.col("t"))


def test_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "SALT_ROWS", 5)  # hot days are salted
    rng = random.Random(1)
    at = lambda: T0 + timedelta(hours=rng.randrange(0, 24 * 6))
    keys = ["hot"] * 6 + ["b", "c", None]
    parents = [(rng.choice(keys), at() if rng.random() > 0.1 else None, at() if rng.random() > 0.4 else None) for _ in range(40)]
    parents += parents[:5]
    children = [(str(i), rng.choice([*keys, "never"]), at() if rng.random() > 0.05 else None) for i in range(300)]
    children += children[:20]
    got = rows(R.flagged_references([_parents(spark, parents)], [_children(spark, children)]).select("ref_key", "t", "orphan"))
    want = set()
    for i, k, t in children:
        if k is not None and t is not None:
            want.add((i, t, not any(pk == k and a is not None and a <= t and (r is None or t < r) for pk, a, r in parents)))
    assert got == sorted(want, key=repr)


def test_edges(spark, rows):
    t = T0
    found = rows(R.flagged_references([_parents(spark, [("a", t, t + timedelta(1)), ("z", t, t)])], [_children(spark, [("1", "a", t), ("2", "a", t + timedelta(1)), ("3", "z", t)])]).select("ref_key", "orphan"))
    assert found == [("1", False), ("2", True), ("3", True)]


def test_empty(spark, rows):
    none = spark.createDataFrame([], "key string, t timestamp_ntz, d timestamp_ntz")
    p = R.parent_keys(none, "p", F.col("key"), F.col("t"), F.col("d"))
    assert rows(R.flagged_references([p], [_children(spark, [("1", "a", T0)])]).select("orphan")) == [(True,)]
    c = R.child_keys(none, "c", "f", "p", F.col("key"), F.col("key"), F.col("t"))
    assert rows(R.flagged_references([p], [c])) == []


def test_more_tied_hot_days_than_can_be_salted(spark, rows, monkeypatch):
    """1,100 keys of equal weight tie for 1,024 places: some are salted, some are not, and every reference is judged right."""
    monkeypatch.setattr(R, "SALT_ROWS", 5)
    parents = [(f"k{i}", T0, T0 + timedelta(hours=12) if i % 3 == 0 else None) for i in range(1100) if i % 2 == 0]
    children = [(f"{i}-{h}", f"k{i}", T0 + timedelta(hours=h)) for i in range(1100) for h in (1, 5, 11, 12, 13, 20)]
    got = rows(R.flagged_references([_parents(spark, parents)], [_children(spark, children).repartition(5)]).select("ref_key", "orphan"))
    assert got == sorted(((f"{i}-{h}", i % 2 == 1 or (i % 3 == 0 and h >= 12)) for i in range(1100) for h in (1, 5, 11, 12, 13, 20)), key=repr)
