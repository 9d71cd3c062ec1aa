import math
from collections import Counter, defaultdict

from notefold.llm import quota_sample as L

CATS = "field_name string, item_id long, split string, category string, plan_id int, rank int"
GOALS = "plan_id int, split string, field_name string, category string, want_milli long, floor long"


def _cats(spark, counts):
    data, i = [], 0
    for c, n in counts.items():
        for _ in range(n):
            data.append(("concept", i, "train", c, 99, 7))
            i += 1
    return spark.createDataFrame(data, CATS)


def test_exact_sizes_and_floors(spark):
    counts = {"a": 5000, "b": 300, "c": 7, "d": 2, "e": 40}
    goals = {"a": (500_000, 0), "b": (120_500, 0), "c": (9_000, 3), "d": (0, 1), "e": (700, 4), "none": (5_000, 1)}
    g = spark.createDataFrame([(1, "train", "concept", c, w, f) for c, (w, f) in goals.items()], GOALS)
    got = L.systematic_sample(_cats(spark, counts).drop("plan_id", "rank"), g, seed=3).collect()
    assert len({r.item_id for r in got}) == len(got)
    by = defaultdict(Counter)
    for r in got:
        by[r.category][r.reason] += 1
    for c, (w, f) in goals.items():
        n = counts.get(c, 0)
        want, drawn = min(w / 1000, n), by[c]["crossing"]
        assert math.floor(want) <= drawn <= math.ceil(want)
        assert sum(by[c].values()) == max(drawn, min(f, n))
    total = sum(min(w / 1000, counts.get(c, 0)) for c, (w, _) in goals.items())
    assert abs(sum(b["crossing"] for b in by.values()) - total) < 1  # one random start for the whole plan


def test_shares_are_even_over_seeds(spark):
    cats = _cats(spark, {"a": 20, "b": 5}).drop("plan_id", "rank").cache()
    g = spark.createDataFrame([(1, "train", "concept", "a", 4_000, 0), (1, "train", "concept", "b", 1_000, 0)], GOALS)
    n = Counter(r.item_id for seed in range(12) for r in L.systematic_sample(cats, g, seed).collect())
    assert sum(n.values()) == 12 * 5 and max(n.values()) < 10


def test_found_and_targets(spark, rows):
    plans = spark.createDataFrame([(1, "Train ", "concept", 10), (1, "Train ", "concept", 10), (2, "val", "gold_answer", 3)], "plan_id int, split string, field_name string, sample_size long")
    wanted = spark.createDataFrame([(1, " A", 400, 0), (1, "B", 301, 0), (1, "c", None, 3), (1, None, 100, 1), (2, "0.50", 1000, None), (9, "a", 1, 1)], "plan_id int, category string, target_permille int, min_items long")
    goals = L.targets(plans, wanted)
    assert rows(goals.select("plan_id", "category", "want_milli", "floor")) == [(1, "a", 4000, 0), (1, "b", 3010, 0), (1, "c", 0, 3), (2, "0.5", 3000, 0)]
    cats = _cats(spark, {"a": 4, "b": 3, "c": 3})
    assert rows(L.available(cats, goals).where("have < need").select("plan_id", "category")) == [(1, "b"), (2, "0.5")]


def test_empty(spark, rows):
    none = spark.createDataFrame([], CATS).drop("plan_id", "rank")
    g = spark.createDataFrame([(1, "train", "concept", "a", 1000, 1)], GOALS)
    assert rows(L.systematic_sample(none, g)) == [] and rows(L.systematic_sample(_cats(spark, {"a": 2}).drop("plan_id", "rank"), g.where("false"))) == []
