import random
from collections import Counter

from pyspark.sql import functions as F

from notefold.llm import families as L


def brute(edges, nodes):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    for n in nodes:
        find(n)
    return sorted((x, find(x)) for x in parent)


def _run(spark, rows, edges, nodes=(), **kw):
    e = spark.createDataFrame([(a, b, "x", "y") for a, b in edges], "a string, b string, node string, component string")
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    return rows(L.components(e, "a", "b", n, **kw))


def test_chain_hub_and_pairs(spark, rows):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    hub = [("hub", f"h{i}") for i in range(80)]
    rng = random.Random(2)
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    edges = [*chain, *hub, *loose, ("solo", "solo"), ("left", None), (None, None), *hub[:3]]
    assert _run(spark, rows, edges, ["alone"], hot=30) == brute(edges, ["alone"])


def test_empty(spark, rows):
    assert _run(spark, rows, []) == []


def test_family_over_ids_without_rows(spark, rows):
    data = [("train_1", "train", "ghost_9"), ("val_1", "val ", " GHOST_9.mid"), ("val_2", None, ""), ("test_3", "test", "x/test_4.json"), ("test_4", "TEST", None), ("test_4", "TEST", None)]
    clips = spark.createDataFrame([(*d, 1, 2) for d in data], "sample_id string, split string, source_sample_id string, component int, node int")
    f = L.families(clips)
    assert rows(f.where("lo <> hi").select("family_id", "sample_id")) == [("train_1", "train_1"), ("train_1", "val_1")]
    assert f.count() == 5


def test_rendezvous(spark):
    d = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    a = d.select("k", L.rendezvous_split(F.col("k")).alias("s"), L.rendezvous_split(F.col("k"), {"train": 0.8, "val": 0.2, "test": 0.1}).alias("t")).collect()
    n = Counter(r.s for r in a)
    assert abs(n["train"] / 20_000 - 0.8) < 0.02 and abs(n["val"] / 20_000 - 0.1) < 0.01
    assert all(r.t == "val" for r in a if r.s != r.t)  # only the split whose share grew gains
    assert d.select(L.rendezvous_split(F.lit(None).cast("string")).alias("s")).first()[0] is None


def test_more_tied_hubs_than_can_be_broadcast(spark, rows):
    """1,100 families of equal size tie for 1,024 places of large clusters; none loses or doubles a member."""
    edges = [(f"f{i:04}", f"m{i:04}-{k}") for i in range(1100) for k in range(4)]
    assert _run(spark, rows, edges, hot=4) == brute(edges, [])
