import random

from notefold.llm import leakage as L


def test_words_and_offsets():
    t = "Ｒｅad​ing  the “ﬁrst” NOTE—A#4\n\tat 2­.5 s_x É é"
    assert L.words(t) == ["reading", "the", "first", "note", "a", "4", "at", "2", "5", "s", "x", "é", "é"]
    assert [w for w, _, _ in L.word_offsets(t)] == L.words(t)
    at = {w: t[a:z] for w, a, z in L.word_offsets(t)}
    assert at["reading"] == "Ｒｅad​ing" and at["first"] == "“ﬁrst”" and at["note"] == "NOTE"


def test_against_brute_force(spark, rows):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = {i: text(rng.randrange(3, 25)) for i in range(12)} | {50: ["a"] * 14}
    docs = {}
    for i in range(60):
        d = text(40)
        p = passages[rng.randrange(12)]
        k = rng.randrange(4, 16)
        docs[i] = d[:20] + p[:k] + d[20:]
    docs |= {100: [], 101: ["a"] * 5000, 102: ["a"] * 9}
    dirty = lambda w: "".join(rng.choice([x.upper(), x]) + rng.choice([" ", ", ", " \n", " ​"]) for x in w)
    d = spark.createDataFrame([(i, dirty(w), 1) for i, w in docs.items()] + [(200, None, 1)], "doc_id long, text string, eval_id int")
    p = spark.createDataFrame([(i, dirty(w), "x") for i, w in passages.items()] + [(60, None, "x"), (61, "", "x"), (62, dirty(passages[50]), "x")], "eval_id long, passage string, doc_id string")
    got = set(rows(L.leaked(d, "doc_id", "text", p, "eval_id", "passage").select("doc_id", "eval_id")))
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    want = {(i, j) for i, w in docs.items() for j, v in [*passages.items(), (62, passages[50])] if grams(w) & grams(v)}
    assert got == want and (101, 62) in got and (102, 50) not in got
    assert rows(L.leaked(d.where("false"), "doc_id", "text", p, "eval_id", "passage")) == [] and rows(L.leaked(d, "doc_id", "text", p.where("false"), "eval_id", "passage")) == []


def test_spans_point_at_the_original(spark):
    p = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "eval_id long, passage string")
    text = "Intro. Two — THREE four, five six (seven) eight nine​ ten\neleven!! Then more."
    d = spark.createDataFrame([(7, text)], "doc_id long, text string")
    r = L.leaked(d, "doc_id", "text", p, "eval_id", "passage").collect()
    assert len(r) == 1 and text[r[0].first_char : r[0].last_char] == "Two — THREE four, five six (seven) eight nine​ ten\neleven" and r[0].n_words == 10


def test_runs_against_all_windows():
    """Runs of texts of few words, where blocks repeat, against every pair of windows; passages that repeat themselves too."""
    rng = random.Random(12)
    for size in (3, 4, 10):
        passages = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(2, 40)))) for i in range(15)] + [(20, "a " * 60), (21, "a b " * 40), (22, "a " * 60), (23, None), (24, "")]
        w = L.Windows(passages, size)
        assert any(at < 0 for _, places in w.automaton.values() for _, at in places)
        for _ in range(60):
            text = " ".join(rng.choice("abcdeX") if rng.random() < 0.8 else rng.choice(["a a a", "a b a b", "zz"]) for _ in range(rng.randrange(0, 60)))
            if rng.random() < 0.5:
                text += " " + passages[rng.randrange(15)][1]
            t = text.lower().split()
            want = {}
            for pid, p in passages:
                v = (p or "").split()
                grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
                runs = []
                for i in range(len(t) - size + 1):
                    if tuple(t[i : i + size]) in grams:
                        if runs and i <= runs[-1][1] - size + 2:
                            runs[-1][1] = i + size - 1
                        else:
                            runs.append([i, i + size - 1])
                if runs:
                    want[pid] = [tuple(r) for r in runs]
            assert w.hits(text) == want
