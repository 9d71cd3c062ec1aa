"""The text-only baseline finds answers that the text gives away, and only these."""

import random

from pyspark.sql import functions as F

from notefold.operators import quality as Q


def test_given_away_or_not(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        y, words = rng.choice(["yes", "no", "maybe"]), rng.sample("when does the second bar begin and which note sounds longest here".split(), 6)
        rows.append(("told", " ".join([*words, {"yes": "rising", "no": "falling", "maybe": "level"}[y]]), y, i % 3 > 0))
        rows.append(("hidden", " ".join(words), y, i % 3 > 0))
    rows += [("one answer", "a b", "x", i % 2 > 0) for i in range(100)] + [("few", "a b", rng.choice("xy"), i > 5) for i in range(40)] + [(None, "a", "x", True), ("told", None, "yes", True), ("told", "", "yes", False), ("hidden", "x" * 20_000, "no", False), ("told", "a", None, False)]
    d = spark.createDataFrame(rows, "g string, q string, y string, t boolean").withColumn("grp", F.lit("clash"))
    got = {r.g: r for r in Q.text_baseline(d, "g", F.col("q"), "y", F.col("t")).collect()}
    assert set(got) == {"told", "hidden"}
    assert got["told"].accuracy > 0.95 and not got["told"].passed and got["told"].z > 10
    assert got["hidden"].passed and abs(got["hidden"].accuracy - got["hidden"].majority) < 0.1 and got["told"].rows == got["hidden"].rows == 301


def test_bounded_fit_and_many_passes(spark, monkeypatch):
    """Few train rows and little room for models change how it runs, not what is scored."""
    monkeypatch.setattr(Q, "MODEL_MB", 0.01)
    rng = random.Random(7)
    rows = [(f"g{i % 3}", f"word{i % 2} " + rng.choice("abc"), str(i % 2), rng.random() < 0.5) for i in range(600)]
    d = spark.createDataFrame(rows, "g string, q string, y string, t boolean")
    got = Q.text_baseline(d, "g", F.col("q"), "y", F.col("t"), fit_rows=40).collect()
    assert {r.g for r in got} == {"g0", "g1", "g2"} and all(r.accuracy > 0.99 for r in got)
    assert Q.text_baseline(d.where("false"), "g", F.col("q"), "y", F.col("t")).count() == 0


def test_many_answers_fit_in_little_memory():
    """Rows of few texts with hundreds of answers: arrays of terms by answers for every row of train would be gigabytes."""
    import tracemalloc

    rng = random.Random(8)
    words = "when does the second bar begin and which note sounds longest here or there".split()
    texts = [" ".join(rng.sample(words, 8)) for _ in range(40)]
    pairs = [(rng.choice(texts), f"answer {rng.randrange(600)}") for _ in range(1500)] + [(t, f"own {k}") for k, t in enumerate(texts) for _ in range(80)]
    tracemalloc.start()
    classes, idf, x, coef, bias = Q.fit_text([t for t, _ in pairs], [y for _, y in pairs], [1] * len(pairs))
    weights = Q._weights(x, coef)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(classes) > 500
    assert coef.shape == (40, len(classes)) and weights.shape == (Q.FIT_TERMS, len(classes))
    for k, t in enumerate(texts):
        at, _ = Q._weighted([t], idf)
        assert classes[next(Q._scores(at, 1, weights, bias)).argmax()] == f"own {k}"


def test_rows_counted_are_rows_repeated():
    """A text and label given with a count fit as the same rows one by one."""
    pairs = [("a b c", "x", 3), ("a b c", "y", 1), ("c d", "y", 2), ("d e f", "z", 4)]
    once = Q.fit_text(*map(list, zip(*pairs)))
    many = Q.fit_text(*map(list, zip(*[(t, y, 1) for t, y, n in pairs for _ in range(n)])))
    assert once[0] == many[0] and all(abs(a - b).max() < 1e-5 for a, b in ((once[1], many[1]), (once[3], many[3]), (once[4], many[4])))


def test_all_train_rows_are_fitted(spark):
    """Every word tells its answer, and only all 6,000 train rows hold all words."""
    rows = [("g", f"which is word{k:03d}", f"own {k}", True) for k in range(300) for _ in range(20)] + [("g", f"which is word{k:03d}", f"own {k}", False) for k in range(300)]
    d = spark.createDataFrame(rows, "g string, q string, y string, t boolean")
    (r,) = Q.text_baseline(d, "g", F.col("q"), "y", F.col("t")).collect()
    assert r.rows == 300 and r.accuracy > 0.95


def test_many_texts_fit_alike_in_blocks():
    """Above ``direct`` texts the weights are moved themselves, in blocks of texts and parts of the classes: the same scores."""
    rng = random.Random(9)
    words = "when does the second bar begin and which note sounds longest here or there".split()
    pairs = [(" ".join(rng.sample(words, 5)), f"answer {rng.randrange(600)}", rng.randrange(1, 4)) for _ in range(700)]
    texts, labels, counts = map(list, zip(*pairs))
    one, two = (Q.fit_text(texts, labels, counts, rounds=8, direct=n) for n in (4000, 100))
    assert one[0] == two[0] and len(one[0]) > 300 and two[3].shape == (Q.FIT_TERMS, len(two[0])) and abs(one[1] - two[1]).max() < 1e-6
    a, b = Q._weights(one[2], one[3]), Q._weights(two[2], two[3])
    assert abs(a - b).max() < 1e-4 * abs(a).max() and abs(one[4] - two[4]).max() < 1e-4 * abs(one[4]).max()
