import random

from pyspark.sql import functions as F

from notefold.llm import overlap as L


def within(a, b, most=2):
    """True if b, moved by a constant, is at most ``most`` edits from a."""
    if not a or not b:
        return False

    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return row[-1]

    if max(len(a), len(b)) <= most:
        return True
    return any(edit(a, [p + s for p in b]) <= most for s in {x - y for x in a for y in b})


def _melody(rng, n):
    return [rng.randrange(50, 70) for _ in range(n)]


def _changed(rng, m):
    m = [p + rng.randrange(-5, 6) * 0 for p in m]
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(3)
        at = rng.randrange(len(m))
        if k == 0:
            m[at] += rng.choice([-1, 1, 7])
        elif k == 1 and len(m) > 1:
            del m[at]
        else:
            m.insert(at, rng.randrange(50, 70))
    s = rng.randrange(-7, 8)
    return [p + s for p in m]


def _clips(spark, tunes):
    data = [(i, [(0.1 * k, 0.1 * k + 0.05, p, 80) for k, p in enumerate(m)] if m is not None else None, "z") for i, m in tunes.items()]
    return spark.createDataFrame(data, "sample_id string, notes array<struct<start:double,end:double,pitch:int,velocity:int>>, seq_id string")


def _check(spark, rows, tunes, entries):
    e = spark.createDataFrame([(*x, 1) for x in entries], "id string, split string, source string, semitones int, sx int")
    got = {tuple(sorted((r.train_id, r.other_id))) for r in L.split_overlaps(e, _clips(spark, tunes)).collect()}
    want = set()
    for a, sa, ta, ma in entries:
        for b, sb, tb, mb in entries:
            if None in (sa, ta, ma, sb, tb, mb) or sa != "train" or sb == "train" or abs(ma - mb) > 1:
                continue
            if ta == tb or within(tunes.get(ta) or [], tunes.get(tb) or []):
                want.add(tuple(sorted((a, b))))
    assert got == want
    return got


def test_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "HOT_POSTINGS", 5)
    rng = random.Random(5)
    tunes = {}
    for i in range(40):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 31])
        tunes[f"t{i}"] = _melody(rng, n)
        tunes[f"v{i}"] = _changed(rng, tunes[f"t{i}"]) if rng.random() < 0.8 else _melody(rng, n)
    tunes |= {"none": [], "null": None, "same": [60] * 20, "same2": [62] * 21}
    entries = [(f"a{k}", "train", f"t{k % 40}", rng.randrange(-2, 3)) for k in range(60)] + [(f"b{k}", rng.choice(["val", "test"]), f"v{k % 40}", rng.randrange(-2, 3)) for k in range(60)]
    entries += [("c1", "train", "same", 1), ("c2", "val", "same2", 2), ("c3", "test", "ghost", 1), ("c4", "train", "ghost", 0), ("c5", "train", "none", 0), ("c6", "val", "null", 0), ("c7", None, "t1", 0), ("c8", "val", None, 0), ("c9", "val", "t1", None), *entries[:4]]
    assert len(_check(spark, rows, tunes, entries)) > 30


def test_edit_bound_loses_no_pair(spark, rows):
    """Two edits anywhere in a melody of any length from 6 on are found."""
    rng = random.Random(6)
    tunes, entries = {}, []
    for n in range(6, 33):
        m = _melody(rng, n)
        x = list(m)
        i, j = sorted(rng.sample(range(n), 2))
        x[i] += 1
        x[j] -= 1
        tunes |= {f"m{n}": m, f"x{n}": [p + 5 for p in x], f"d{n}": [p for k, p in enumerate(m) if k not in (i, j)]}
        entries += [(f"m{n}", "train", f"m{n}", n * 10), (f"x{n}", "val", f"x{n}", n * 10), (f"d{n}", "test", f"d{n}", n * 10)]
    got = _check(spark, rows, tunes, entries)
    assert len(got) >= 2 * 27


def test_empty(spark, rows):
    e = spark.createDataFrame([], "id string, split string, source string, semitones int")
    assert rows(L.split_overlaps(e, _clips(spark, {"a": [1, 2]}))) == []
    one = spark.createDataFrame([("a", "train", "s", 1), ("b", "val", "s", 2)], e.schema)
    assert rows(L.split_overlaps(one, _clips(spark, {"q": [1]}).where("false")).select("train_id", "other_id")) == [("a", "b")]


def test_gram_size_leaves_an_overlap(spark):
    for r in spark.range(6, 60).select("id", L.gram_size(F.col("id").cast("int")).alias("q")).collect():
        grams = r.id - 1 - r.q + 1
        assert grams > 2 * (r.q + 1) or r.q == 1 and grams > 4
