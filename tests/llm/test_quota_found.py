from notefold.llm import quota_sample as L
from tests.llm.test_quota_sample import GOALS, _cats


def test_found_comes_from_the_sample(spark, rows, monkeypatch):
    """Categories with too few items are found from what was drawn; one short by a fraction of an item is not."""
    counts = {"a": 4, "b": 3, "c": 3, "d": 50}
    wants = {"a": (4_000, 0), "b": (3_010, 0), "c": (0, 3), "d": (10_500, 0), "none": (1_000, 0)}
    g = spark.createDataFrame([(1, "train", "concept", c, w, f) for c, (w, f) in wants.items()], GOALS)
    cats = _cats(spark, counts).drop("plan_id", "rank")
    calls, sample = [], L.systematic_sample
    monkeypatch.setattr(L, "systematic_sample", lambda *x: calls.append(1) or sample(*x))
    monkeypatch.setattr(L, "_inputs", lambda s, d: (cats, g))
    assert rows(L.p6_found(spark, "")) == [(1, "b"), (1, "none")] and calls
