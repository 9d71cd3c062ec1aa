import random
from collections import Counter

from notefold.operators import selection as S


def brute_cap(ns, share):
    return max([1] + [c for c in range(1, max(ns) + 1) if c <= share * sum(min(n, c) for n in ns) + 1e-9])


def brute_alloc(caps, total):
    level = max(l for l in range(0, total + 1) if sum(min(c, l) for c in caps.values()) <= total)
    out = {k: min(c, level) for k, c in caps.items()}
    room = sorted((k for k in caps if caps[k] > out[k]), key=lambda k: (-(caps[k] - out[k]), k))
    for k in room[: total - sum(out.values())]:
        out[k] += 1
    return out


def test_waterfill(spark):
    rng = random.Random(1)
    groups = {g: [rng.randrange(1, 60) for _ in range(rng.randrange(1, 7))] for g in range(25)}
    shares = {g: rng.choice([0.35, 0.55, 0.5, 1.1 / 3, 0.25]) for g in groups}
    d = spark.createDataFrame([(g, n, shares[g]) for g, ns in groups.items() for n in ns], "g int, n long, share double")
    assert {r.g: r.cap for r in S.waterfill_cap(d, ["g"]).collect()} == {g: brute_cap(ns, shares[g]) for g, ns in groups.items()}
    caps = {g: {f"k{i}": n for i, n in enumerate(ns)} for g, ns in groups.items()}
    totals = {g: rng.randrange(0, 120) for g in groups}
    d = spark.createDataFrame([(g, k, c, totals[g]) for g, x in caps.items() for k, c in x.items()], "g int, key string, cap long, total long")
    got = {}
    for r in S.waterfill_alloc(d, ["g"], "key").collect():
        got.setdefault(r.g, {})[r.key] = r.alloc
    assert got == {g: brute_alloc(caps[g], totals[g]) for g in groups}


def test_hash_rank_is_a_permutation(spark):
    d = spark.createDataFrame([(i % 3 if i % 7 else None, i // 2) for i in range(500)], "g int, k int")
    a = S.hash_ranked(d, ["g"], ["k"], 1).collect()
    for g in {r.g for r in a}:
        assert sorted(r["rank"] for r in a if r.g == g) == list(range(1, sum(r.g == g for r in a) + 1))
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, S.hash_ranked(d.repartition(7), ["g"], ["k"], 1).collect()), key=repr)
    assert S.hash_ranked(d.where("false"), ["g"], ["k"], 1).count() == 0


def test_subsample_and_split_sizes(spark):
    d = spark.createDataFrame([(i, "ab"[i % 5 == 0], None if i % 4 else "s") for i in range(333)], "item long, cls string, st string")
    kept = S.proportional_subsample(d.selectExpr("*", "'x' as f"), ["f"], ["cls", "st"], ["item"], 100, 1)
    assert kept.count() == 100
    n = Counter(r.new_split for r in S.exact_split(d, ["item"], {"train": 0.8, "val": 0.1, "test": 0.1}, 1).collect())
    assert n == {"train": 266, "val": 33, "test": 34}


def test_dense_ids(spark, rows):
    d = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None, "ä"]], "k string")
    assert rows(S.dense_ids(d, "k")) == [("a", 0), ("b", 1), ("c", 2), ("ä", 3)]
    assert rows(S.dense_ids(d.where("false"), "k")) == []


def test_balanced_pick(spark):
    rng = random.Random(2)
    data = [("f", f"clip{i}", rng.choice("aaaab"), "", False, i * 10 + k) for i in range(200) for k in range(3)] + [("f", "hot", "a", "", False, 10_000 + k) for k in range(2000)]
    got = S.greedy_balanced_pick(spark.createDataFrame(data, "family string, clip string, akey string, stratum string, empty boolean, cand_id long"), 1).collect()
    assert len(got) == len({r.clip for r in got}) == 201
    n = Counter(r.akey for r in got)
    assert n["b"] >= sum(any(d[1] == f"clip{i}" and d[2] == "b" for d in data) for i in range(200)) * 0.9


def test_yesno_limit_is_filled(spark):
    """Below the limit all stay; above it half goes to each answer, and the room of a rare answer to the other."""
    def rows(concept, others, t, f):
        return [(concept, False, None, f"{concept}-{i}") for i in range(others)] + [(concept, True, i < t, f"{concept}+{i}") for i in range(t + f)]

    data = rows("odd", 27, 5, 5) + rows("few", 90, 4, 5) + rows("one", 90, 0, 40) + rows("rare", 90, 2, 40) + rows("none", 0, 3, 3)
    d = spark.createDataFrame([(*x, 1) for x in data], "concept string, boolean boolean, yes boolean, id string, nt int").drop("nt")
    n = {}
    for r in S.yesno_trim(d, ["id"], 1).collect():
        k = (r.concept, r.yes if r.boolean else None)
        n[k] = n.get(k, 0) + 1
    assert n == {("odd", None): 27, ("odd", True): 1, ("odd", False): 2, ("few", None): 90, ("few", True): 4, ("few", False): 5, ("one", None): 90, ("one", False): 10, ("rare", None): 90, ("rare", True): 2, ("rare", False): 8}


def test_concept_quota(spark):
    data = [("u", "a", f"a{i % 3}", False) for i in range(60)] + [("u", "a", "ay", True)] * 30 + [("u", "b", "b0", False)] * 45 + [("g", "a", "g0", False)] * 7 + [("g", "z", "z0", False)] * 3
    d = spark.createDataFrame([(k == "u", c, f, y) for k, c, f, y in data], "understanding boolean, concept string, family string, yesno boolean")
    got = {(r.understanding, r.family): (r.target, r.alloc) for r in S.concept_quota(d).collect()}
    # a can give 60 and 6 yes/no ones, b 45: both get 45, of which a tenth, 4, may be yes/no
    assert got == {(True, "a0"): (45, 14), (True, "a1"): (45, 14), (True, "a2"): (45, 13), (True, "ay"): (45, 4), (True, "b0"): (45, 45), (False, "g0"): (3, 3), (False, "z0"): (3, 3)}
    soft = {(r.understanding, r.family): r.alloc for r in S.concept_quota(d, 50).collect()}
    assert soft[True, "b0"] == 45 and soft[False, "g0"] == 7 and soft[True, "ay"] == 5 and sum(soft[True, f"a{i}"] for i in range(3)) == 45


def _cap(counts, share):
    return max([c for c in range(1, max(counts) + 1) if c <= share * sum(min(n, c) for n in counts) + 1e-9], default=1)


def test_family_trim_against_brute_force(spark):
    """Both trims by loops over lists of ids in hash order."""
    import hashlib
    import random
    from collections import defaultdict

    rng = random.Random(31)
    data = []
    for fam, kind, k, strata in (("u1", True, 4, ["s", "t", "one"]), ("u2", True, 2, [""]), ("g1", False, 5, ["m", "n"]), ("g2", False, 3, [""])):
        for i in range(400):
            st = rng.choice(strata)
            cls = "only" if st == "one" else rng.choice([f"c{j}" for j in range(k) for _ in range(3 * j * j + 1)] + (["tiny"] if i % 40 == 0 else []))
            data.append((fam, kind, st, cls, False, not kind and rng.random() < 0.5, f"{fam}-{i}"))
    h = lambda i: (hashlib.md5(f"4|{i}".encode()).hexdigest(), i)

    def by(rows, f):
        out = defaultdict(list)
        for r in rows:
            out[f(r)].append(r)
        return out

    def take(rows, n):
        return sorted(rows, key=lambda r: h(r[6]))[:n]

    def share(k, stratum):
        return 1.1 / k if stratum and k >= 3 else max(0.35, 1.5 / max(k, 1))

    def strata_(rows, kind):
        out = []
        for st, some in by(rows, lambda r: r[2]).items():
            groups = by(some, lambda r: r[3])
            floor = max(2, 0.05 * len(some))
            k = sum(len(v) >= floor for v in groups.values())
            if st and not kind:
                out += some
                continue
            if st and kind:
                groups = {a: v for a, v in groups.items() if len(v) >= floor}
                if k < 2:
                    continue
            cap = _cap([len(v) for v in groups.values()], share(k, bool(st)))
            out += [r for v in groups.values() for r in take(v, cap)]
        return out

    def whole(rows):
        groups = by(rows, lambda r: r[3])
        k = sum(len(v) >= max(2, 0.01 * len(rows)) for v in groups.values())
        cap = _cap([len(v) for v in groups.values()], share(k, False)) if groups else 1
        return [r for v in groups.values() for r in take(v, cap)]

    want = []
    for fam, rows in by(data, lambda r: r[0]).items():
        kind = rows[0][1]
        rows = strata_(rows, kind)
        if not kind:
            kept = []
            for st, some in by(rows, lambda r: r[2]).items():
                full = [r for r in some if not r[5]]
                kept += some if not st else full + take([r for r in some if r[5]], int(0.2 / 0.8 * len(full) + 1e-9))
            rows = kept
        rows = whole(rows)
        for _ in range(8 if kind else 0):
            new = whole(strata_(rows, kind))
            if len(new) == len(rows):
                break
            rows = new
        want += [r[6] for r in rows]
    d = spark.createDataFrame([(*r, 3) for r in data], "family string, understanding boolean, stratum string, akey string, boolean boolean, empty boolean, id string, n int").drop("n")
    got = [r.id for r in S.family_trim(d, ["id"], 4).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got) < len(data)


def _greedy(rows, seed, h):
    """One family by plain loops: (clip, akey, stratum, empty, cand)."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    counts, empty, out = Counter(), 0, []
    for clip in sorted(by, key=lambda c: (h(seed, "f", c), c)):
        r = min(by[clip], key=lambda r: (r[3] and empty >= 0.2 * (len(out) + 1), counts[r[2], r[1]], h(seed, "f", clip, r[4])))
        counts[r[2], r[1]] += 1
        empty += r[3]
        out.append(r[4])
    return out


def test_slots_pick_from_what_is_left(spark):
    import hashlib

    h = lambda *k: hashlib.md5("|".join(map(str, k)).encode()).hexdigest()
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(40)}", rng.choice("abbccc"), rng.choice(["s", "t"]), rng.random() < 0.3, i) for i in range(300)]
    for family, many in (("f", 1), ("H-G2", 3)):
        d = spark.createDataFrame([(family, *r, 9) for r in rows], "family string, clip string, akey string, stratum string, empty boolean, cand_id long, n int").drop("n")
        got = {}
        for r in S.slot_picks(d, 7).collect():
            got.setdefault(r.slot, []).append(r.cand_id)
        left, want = list(rows), {}
        hf = lambda seed, f, *k: h(seed, family, *k)  # noqa: E731, B023
        for k in range(many):
            want[k] = sorted(_greedy(left, f"7|slot{k}", hf))
            left = [r for r in left if r[4] not in want[k]]
        assert {k: sorted(v) for k, v in got.items()} == want


def test_evaluation_subset(spark):
    rng = random.Random(4)
    rows = [("g", f"c{rng.randrange(60)}", rng.choice(["x", "y", "z"]), f"F{rng.randrange(6)}", rng.choice("ab"), rng.random() < 0.4, i) for i in range(600)]
    got = S.evaluation_subset(spark.createDataFrame(rows, "kind string, clip string, concept string, family string, akey string, boolean boolean, cand_id long"), 5).collect()
    assert len(got) == len({r[1] for r in rows}) == len({r.clip for r in got})
    n = Counter(r.concept for r in got)
    assert max(n.values()) - min(n.values()) <= 2 and sum(r.boolean for r in got) <= 0.08 * len(got) + 3


def test_whole_build(spark):
    """The rules hold at the end: classes in their shares, concepts equal, yes/no and empties limited; the same rows every time."""
    rng = random.Random(5)
    rows = []
    for fam, concept, kind, boolean in (("u1", "a", True, False), ("u2", "a", True, True), ("u3", "b", True, False), ("g1", "a", False, False), ("g2", "b", False, False)):
        for i in range(500):
            cls = rng.choice(["true", "false"]) if boolean else rng.choice("pqqrrrr")
            rows.append((fam, concept, kind, f"c{rng.randrange(300)}", cls, "", not kind and rng.random() < 0.4, boolean, cls == "true", f"{fam}-{i}"))
    d = spark.createDataFrame(rows, "family string, concept string, understanding boolean, clip string, akey string, stratum string, empty boolean, boolean boolean, yes boolean, cand_id string")
    got = S.build(d, ["cand_id"], 3).collect()
    assert sorted(r.cand_id for r in got) == sorted(r.cand_id for r in S.build(d.repartition(3), ["cand_id"], 3).collect())
    n = Counter((r.understanding, r.concept) for r in got)
    assert len({v for (k, _), v in n.items() if not k}) == 1 and len({r.cand_id for r in got}) == len(got) == len({(r.family, r.clip) for r in got})
    yes = Counter((r.concept, r.boolean) for r in got if r.understanding)
    assert 0 < yes["a", True] <= 0.1 * (yes["a", True] + yes["a", False]) and n[True, "a"] <= n[True, "b"]
    empty = Counter((r.family, r.empty) for r in got if not r.understanding)
    assert all(0 < empty[f, True] <= 0.25 * (empty[f, True] + empty[f, False]) for f in ("g1", "g2"))  # thinning to the quota may move a share a little
