import random

import numpy as np
from pyspark.sql import functions as F

from notefold.llm import language as L
from notefold.llm.gru import ByteGRU

TEXTS = {
    "en": "the quiet melody comes back after every short rest and nobody in the room had noticed that the left hand keeps a steady pulse while the right hand climbs".split(),
    "de": "die leise melodie kommt nach jeder kurzen pause wieder und niemand im raum hat bemerkt dass die linke hand einen ruhigen puls behält während die rechte steigt".split(),
    "es": "la melodía tranquila vuelve después de cada pausa corta y nadie en la sala notó que la mano izquierda mantiene un pulso estable mientras la derecha sube".split(),
}


def sentence(rng, lang):
    w = rng.sample(TEXTS[lang], 9)
    return " ".join(w).capitalize() + rng.choice([".", "?", "!"])


def test_gradients():
    g = ByteGRU(["a", "b", "c"], 4, 1)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = g.loss(x, y)
    for k, w in g.p.items():
        at = (int(x[2, 1]), 3) if k.startswith("wx") else tuple(int(rng.integers(0, s)) for s in w.shape)
        old, e = w[at], 1e-4
        w[at] = old + e
        up = g.loss(x, y)[0]
        w[at] = old - e
        down = g.loss(x, y)[0]
        w[at] = old
        assert abs(grads[k][at] - (up - down) / (2 * e)) < 2e-5


def test_batches_do_not_matter():
    g = ByteGRU(["a", "b"], 8, 2)
    texts = [b"", b"a", b"abcdefgh" * 5, "é".encode(), b"xyz"]
    one = np.vstack([g.probabilities([t]) for t in texts])
    assert np.allclose(g.probabilities(texts), one, atol=1e-5) and np.allclose(one[0], 0.5)
    assert np.allclose(ByteGRU.load(g.dump()).probabilities(texts), one, atol=1e-5)


def test_held_out_accuracy_with_wrong_labels():
    rng = random.Random(12)
    data = [(lang, sentence(rng, lang)) for lang in TEXTS for _ in range(250)]
    noisy = [(rng.choice(["en", "de", "es", "xx"]) if rng.random() < 0.1 else lang, s) for lang, s in data]
    net = L.train(noisy, steps=500)
    assert net.classes == ["de", "en", "es"]  # the label that names nothing is gone
    test = [(lang, sentence(rng, lang)) for lang in TEXTS for _ in range(60)]
    got = net.probabilities([L.sentence_bytes(s) for _, s in test]).argmax(1)
    assert np.mean([net.classes[k] == lang for k, (lang, _) in zip(got, test)]) > 0.97


def test_sentences():
    cut = lambda t: [(t[a:z], full) for a, z, full in L.sentences(t)]
    assert cut("Near 3.38 seconds it stops. “Is it so?” Yes…\n\nC4 0.25 | D4 0.50\n\nTrailing words without end") == [("Near 3.38 seconds it stops.", True), ("“Is it so?”", True), ("Yes…", False), ("C4 0.25 | D4 0.50", False), ("Trailing words without end", False)]
    assert cut("A line\nbroken inside goes on. Pourquoi la figure reste-t-elle ?") == [("A line\nbroken inside goes on.", True), ("Pourquoi la figure reste-t-elle ?", True)]
    assert L.sentences("") == L.sentences(None) == [] and L.sentences("   ") == []


def test_labels_in_usual_forms(spark):
    cases = {"en": "en", "ENG": "en", "en_GB": "en", "pt-BR": "pt", "français": "fr", " Deutsch ": "de", "dut": "nl", "und": None, "": None, None: None, "n/a": None, "?": None, "klingon": None}
    d = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in d.select("l", L.named_language(F.col("l"))).collect()} == cases


def test_change_inside_a_sentence():
    rng = random.Random(13)
    labeller = L.Labeller(L.train([(lang, sentence(rng, lang)) for lang in ["en", "de", "es"] * 200], steps=600).dump())
    broken = [" ".join(rng.sample(TEXTS["en"], 8)) + "\n" + sentence(rng, "de") for _ in range(10)]
    whole = [sentence(rng, "de") for _ in range(10)]
    got = [labeller.document([p])[0][0] for p in labeller(broken + whole)]
    assert got[:10].count("de") >= 8 and got[10:] == ["de"] * 10


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 500)
    monkeypatch.setattr(L.train, "__defaults__", (5, 500))
    rng = random.Random(13)
    data = [(i, " ".join(sentence(rng, lang) for _ in range(4)), lang, "zz") for i, lang in enumerate(["en", "de", "es"] * 60)]
    mixed = sentence(rng, "en") + " " + sentence(rng, "de") + "\n\n" + sentence(rng, "de")
    data += [(1000, mixed, "en", "zz"), (1001, sentence(rng, "es"), "en-US", "zz"), (1002, sentence(rng, "es"), "Spanish", "zz"), (1003, sentence(rng, "de"), None, "zz"), (1004, "C4 0.2 | D4 0.3", None, "zz"), (1005, "", "en", "zz"), (1006, None, "en", "zz"), (1007, (sentence(rng, "en") + " ") * 3000, "en", "zz")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, label string")  # "label" clashes
    body = L.fitted_network(docs)
    parts = {r.doc_id: [p["lang"] for p in r.parts] for r in L.labelled_sentences(docs, body).collect()}
    assert parts[1000] == ["en", "de", "de"] and parts[1001] == ["es"] and parts[1003] == ["de"] and parts[1004] == parts[1005] == parts[1006] == [] and set(parts[1007]) == {"en"} and len(parts[1007]) == 3000
    wrong = sum(set(parts[i]) != {lang} for i, _, lang, _ in data[:180])
    assert wrong <= 2


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "Some words are here.", "und")], "doc_id long, text string, lang string")
    assert L.fitted_network(docs) is None
    assert [r.parts for r in L.labelled_sentences(docs, None).collect()] == [[]]
    assert L.labelled_sentences(docs.where("false"), None).count() == 0


def test_sentences_without_spaces():
    cut = lambda t: [(t[a:z], full) for a, z, full in L.sentences(t)]
    assert cut("左手保持稳定的节奏。右手慢慢升高！") == [("左手保持稳定的节奏。", True), ("右手慢慢升高！", True)]
    assert cut("「これは静かな旋律です。」次の音は短い。") == [("「これは静かな旋律です。」", True), ("次の音は短い。", True)]
    assert cut("音。") == [("音。", False)]
    assert L.word_count("две ноты") == 2 and L.word_count("音乐很好听 ok") == 3 and L.word_count("") == 0


def test_pieces_end_at_words_and_characters():
    rng = random.Random(3)
    for text in ["", "word " * 300, "é" * 900, "音" * 500 + " " + "x" * 900, "".join(rng.choice("aé音 ") for _ in range(3000))]:
        s = text.encode()
        pieces = L.pieces_of(s, 40)
        assert b"".join(pieces) == s and max(map(len, pieces)) <= 40
        assert all(p.decode("utf-8") is not None for p in pieces)


def test_positions_of_a_long_text():
    g = ByteGRU(["a", "b", "c"], 8, 2)
    text = bytes(random.Random(4).choices(range(97, 120), k=5000))
    whole, cut = (g.positions([b"", text, b"x"], piece=p, around=128)[1] for p in (10_000, 300))
    assert whole.shape == cut.shape == (5000, 3) and np.allclose(whole, cut, atol=1e-3) and np.allclose(cut.sum(1), 1, atol=1e-5)
    assert [x.shape for x in g.positions([b"", b"ab"])] == [(0, 3), (2, 3)] and g.positions([]) == []
    assert np.allclose(g.positions([text[:40], b"abc", text[:70]])[0], g.positions([text[:40]])[0], atol=1e-6)


def _three():
    rng = random.Random(13)
    return rng, L.Labeller(L.train([(lang, sentence(rng, lang)) for lang in ["en", "de", "es"] * 200], steps=600).dump())


def test_change_inside_a_very_long_sentence():
    """No length is too long for the search of a change: 20 kB of one language broken off, then a sentence in another."""
    rng, labeller = _three()
    text = " ".join(rng.choice(TEXTS["en"]) for _ in range(4000)) + "\n" + sentence(rng, "de") + " " + sentence(rng, "de")
    assert len(text) > 16_000
    parts = L.document_parts(labeller, [text], every=True)[0]
    assert [p["lang"] for p in parts] == ["en", "de", "de"] and [p["whole"] for p in parts] == [False, True, True]
    assert text[parts[1]["first"] :].startswith(text.split("\n")[1][:12]) and text[: parts[0]["last"]] == text.split("\n")[0].strip()


def test_every_document_with_words_has_a_language():
    rng, labeller = _three()
    de = " ".join(rng.sample(TEXTS["de"], 6))
    texts = [de, "C4 0.25 | D4 0.5", "", None, " \n", de + "\n\n" + sentence(rng, "en"), sentence(rng, "es")]
    plain = [[p["lang"] for p in x] for x in L.document_parts(labeller, texts)]
    assert plain == [["de"], [], [], [], [], ["en"], ["es"]]
    assert [[p["lang"] for p in x] for x in L.document_parts(labeller, texts, pooled=False)] == [[], [], [], [], [], ["en"], ["es"]]
    every = L.document_parts(labeller, texts, every=True)
    assert [[(p["lang"], p["whole"]) for p in x] for x in every] == [[("de", False)], [], [], [], [], [("de", False), ("en", True)], [("es", True)]]
    joined = L.stretches(every[5] + [dict(every[5][1], first=500, last=520, confidence=0.0)])
    assert [(s["lang"], s["last"]) for s in joined] == [("de", every[5][0]["last"]), ("en", 520)] and 0 < joined[1]["confidence"] < every[5][1]["confidence"]
