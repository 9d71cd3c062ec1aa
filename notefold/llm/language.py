"""Languages of documents and of every stretch of mixed ones, by a byte-level bidirectional GRU."""

from __future__ import annotations

import re
import unicodedata
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.llm.gru import ByteGRU
from notefold.runtime import tables

SAMPLE_PER_LABEL = 500
SAMPLE_SENTENCES = 20_000
SAMPLE_CHARS = 4_000
SENTENCE_BYTES = 400
STEPS = 2_200
LEAST_WORDS = 3
REMEMBERED = 100_000
UNSURE = 0.75
DOUBTED = 0.97
CHANGED = 0.7

# fixed values: usual names of languages, two-letter code first
NAMES = {
    "en": "en eng english anglais englisch inglese inglés",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "uk": "uk ukr ukrainian українська",
    "pl": "pl pol polish polski",
    "cs": "cs ces cze czech čeština",
    "sv": "sv swe swedish svenska",
    "da": "da dan danish dansk",
    "no": "no nor nb nob norwegian norsk",
    "fi": "fi fin finnish suomi",
    "tr": "tr tur turkish türkçe",
    "el": "el ell gre greek ελληνικά",
    "ro": "ro ron rum romanian română",
    "hu": "hu hun hungarian magyar",
    "ca": "ca cat catalan català",
    "zh": "zh zho chi chinese 中文",
    "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어",
    "ar": "ar ara arabic العربية",
}


def named_language(label: Column) -> Column:
    """The two-letter code a label names in any usual form, with or without region; null for blanks,
    placeholders and anything that names no known language."""
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)])
    t = F.lower(F.btrim(label, F.lit(" \t\n\r")))
    return F.coalesce(F.try_element_at(known, t), F.try_element_at(known, F.regexp_extract(t, r"^([a-z]{2,3})[-_]", 1)))


_END = re.compile(r"[.!?．]+[\"'»”“’)\]*_]*(?=\s|$)|[。！？]+[\"'»”“’)\]*_」』）]*|…+[\"'»”“’)\]*_]*(?=\s|$)|\n[^\S\n]*\n")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # scripts that put no spaces between words
_DROP = {c: None for c in (0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD, ord("*"), ord(">"), ord("`"))}  # invisible, or marks of emphasis and quotation


def word_count(text: str) -> int:
    """Words of two letters; of scripts without spaces every two letters are one."""
    if not _UNSPACED.search(text):
        return len(_LETTERS.findall(text))
    return sum((len(w) // 2 if _UNSPACED.search(w) else 1) for w in _LETTERS.findall(text))


def sentences(text: str | None) -> list[tuple[int, int, bool]]:
    """Ranges of a text with whether each is a whole sentence: it ends with a full stop, question or
    exclamation mark and has at least ``LEAST_WORDS`` words (:func:`word_count`). The stops of Chinese and Japanese need no space behind them. Line breaks inside do not
    end it, blank lines do; what trails off or has no words, such as note lists, is none."""
    out, at = [], 0
    if not text:
        return out
    for m in [*_END.finditer(text), None]:
        end = m.end() if m else len(text)
        part = text[at:end]
        first = at + len(part) - len(part.lstrip())
        last = at + len(part.rstrip())
        if last > first:
            full = m is not None and m[0][0] in ".!?。！？．" and word_count(text[first:last]) >= LEAST_WORDS
            out.append((first, last, full))
        at = end
    return out


def _plain(part: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", part.translate(_DROP)).split())


def sentence_bytes(part: str) -> bytes:
    return _plain(part).lower().encode("utf-8", "replace")


def pieces_of(s: bytes, size: int = SENTENCE_BYTES) -> list[bytes]:
    """Pieces of at most ``size`` bytes, cut behind a space where there is one, else between characters."""
    out, at = [], 0
    while len(s) - at > size:
        end = s.rfind(b" ", at, at + size) + 1
        if end <= at:
            end = at + size
            while end > at + 1 and s[end] & 0xC0 == 0x80:
                end -= 1
        out.append(s[at:end])
        at = end
    out.append(s[at:])
    return out


def believable(pairs: list[tuple[str, bytes]]) -> list[tuple[str, bytes, float]]:
    """The pairs whose label their words speak for, each with a weight for drawing it.

    Labels may be wrong and texts mixed. For each word the shares of the labels it occurs under are
    counted over all pairs; a pair stays if the product of the shares of its words is highest for
    its own label, which leaves out labels that name another language than their texts. Sentences
    of seldom words weigh more, by the root of how seldom the median word is, so that what is said in few texts is learned too."""
    bags = [sorted(set(_LETTERS.findall(s.decode("utf-8", "replace")))) for _, s in pairs]
    labels = sorted({y for y, _ in pairs})
    at = {y: i for i, y in enumerate(labels)}
    count: dict[str, np.ndarray] = {}
    for (y, _), bag in zip(pairs, bags):
        for w in bag:
            if w not in count:
                count[w] = np.full(len(labels), 0.05)
            count[w][at[y]] += 1
    share = {w: np.log(c / c.sum()) for w, c in count.items()}
    out = []
    for (y, s), bag in zip(pairs, bags):
        if bag and int(np.sum([share[w] for w in bag], axis=0).argmax()) == at[y]:
            out.append((y, s, float(np.median([count[w].sum() for w in bag])) ** -0.5))
    return out


def train(labelled: list[tuple[str, str]], seed: int = 5, steps: int = STEPS) -> ByteGRU | None:
    """A network from (label, sentence) pairs, trained on those whose label is believable; None without any."""
    pairs = [(y, sentence_bytes(s)) for y, s in labelled]
    pairs = believable(sorted((y, s) for y, s in pairs if s))
    if not pairs:
        return None
    classes = sorted({y for y, _, _ in pairs})
    net = ByteGRU(classes, seed=seed)
    if len(classes) > 1:
        net.fit([s for _, s, _ in pairs], [classes.index(y) for y, _, _ in pairs], steps, seed=seed, weights=[w for _, _, w in pairs])
    return net


def fitted_network(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> bytes | None:
    """Parameters of a network trained on a bounded sample of labelled rows: for each language named
    the ``SAMPLE_PER_LABEL`` documents with the lowest hash of their key, of these the sentences in
    the first ``SAMPLE_CHARS`` characters, up to ``SAMPLE_SENTENCES`` in all. The sample is trained on in one task; only parameters reach the driver."""
    d = docs.select(F.xxhash64(key).alias("h"), F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text"), named_language(F.col(lang)).alias("label")).where("label is not null and text is not null and text <> ''")
    some = d.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("r") <= SAMPLE_PER_LABEL)

    def run(_, table):
        rows = sorted(zip(table["r"].to_pylist(), table["label"].to_pylist(), table["text"].to_pylist()))
        pairs = [(label, t[a:b]) for _, label, t in rows for a, b, full in sentences(t) if full]
        each = -(-len(pairs) // SAMPLE_SENTENCES) or 1
        net = train(pairs[::each])
        return pa.table({"body": pa.array([net.dump()] if net else [], pa.binary())})

    got = some.select(F.lit(0).alias("one"), "r", "label", "text").groupBy("one").applyInArrow(run, "body binary").collect()
    return bytes(got[0][0]) if got else None


class Labeller:
    """Language probabilities of sentences; remembers those seen lately, as many texts repeat them."""

    def __init__(self, body: bytes):
        self.net, self.seen = ByteGRU.load(body), OrderedDict()

    def document(self, probs: list[np.ndarray]) -> list[tuple[str, float]]:
        """Languages of the sentences of one document. A sentence below ``UNSURE`` takes the likeliest
        of the languages that other sentences of the document have for sure, if there are any."""
        sure = sorted({int(p.argmax()) for p in probs if p.max() >= UNSURE})
        out = []
        for p in probs:
            best = int(p.argmax()) if p.max() >= UNSURE or not sure else max(sure, key=lambda k: p[k])
            out.append((self.net.classes[best], float(p[best])))
        return out

    def changes(self, plains: list[str]) -> list[tuple[int, np.ndarray, np.ndarray] | None]:
        """Where sentences change their language, by the labels of their positions: of each the number of the first word behind
        the change and the probabilities of what is before and behind it, or None.

        What breaks off in one language may be followed by a whole sentence in another. The change
        is the place that makes both sides likeliest, if each side is ``CHANGED`` sure of another
        language, both have ``LEAST_WORDS`` words and the second starts with a capital. Sentences of any length are looked at."""
        out: list = [None] * len(plains)
        asked = []
        for i, plain in enumerate(plains):
            words = plain.split(" ")
            real = np.cumsum([0] + [bool(_LETTERS.search(w)) for w in words])
            places = [k for k in range(1, len(words)) if real[k] >= LEAST_WORDS and real[-1] - real[k] >= LEAST_WORDS and words[k].lstrip("«\"'„“¿¡(—- ")[:1].isupper()]
            if places:
                asked.append((i, [w.lower().encode("utf-8", "replace") for w in words], places))
        labels = self.net.positions([b" ".join(low) for _, low, _ in asked])
        for (i, low, places), at in zip(asked, labels):
            ends = np.cumsum([len(w) + 1 for w in low])
            sums = np.vstack([np.zeros(at.shape[1]), np.cumsum(at, 0, dtype=np.float64)])
            size = np.array([len(w) for w in low])[:, None]
            each = np.where(size > 0, (sums[ends - 1] - sums[ends - 1 - size[:, 0]]) / np.maximum(size, 1), 1 / at.shape[1])
            run = np.vstack([np.zeros(at.shape[1]), np.cumsum(np.log(each + 1e-6), 0)])
            before, after = run[places], run[-1] - run[places]
            both = np.where(before.argmax(1) != after.argmax(1), before.max(1) + after.max(1), -np.inf)
            k = places[int(both.argmax())]
            if both.max() > -np.inf:
                first, second = each[:k].mean(0), each[k:].mean(0)
                if first.max() >= CHANGED and second.max() >= CHANGED and first.argmax() != second.argmax():
                    out[i] = (k, first, second)
        return out

    def label(self, parts: list[str]) -> tuple[list[np.ndarray], list]:
        """Of each part its probabilities, those behind the change if it has one, and that change (:meth:`changes`) or None."""
        texts = [_plain(p) for p in parts]
        new = [t for t in dict.fromkeys(texts) if t not in self.seen]
        pieces, owner = [], []
        for i, t in enumerate(new):
            for piece in pieces_of(t.lower().encode("utf-8", "replace")):
                pieces.append(piece)
                owner.append(i)
        if new:
            prob = np.zeros((len(new), len(self.net.classes)), np.float64)
            weight = np.array([len(p) for p in pieces], np.float64)[:, None]
            each = self.net.probabilities(pieces)
            np.add.at(prob, owner, each * weight)
            prob /= np.maximum(prob.sum(1, keepdims=True), 1e-9)
            least = np.ones(len(new))  # what the least sure piece of a sentence gives its language
            np.minimum.at(least, owner, each[np.arange(len(pieces)), prob.argmax(1)[owner]])
            doubted = [i for i in range(len(new)) if least[i] < DOUBTED]
            found = dict(zip(doubted, self.changes([new[i] for i in doubted])))
            for i, t in enumerate(new):
                change = found.get(i)
                self.seen[t] = ((change[2] if change else prob[i]).astype(np.float32), change)
        out = [self.seen[t] for t in texts]
        while len(self.seen) > REMEMBERED:
            self.seen.popitem(last=False)
        return [p for p, _ in out], [c for _, c in out]

    def __call__(self, parts: list[str]) -> list[np.ndarray]:
        return self.label(parts)[0]


def _word_start(part: str, k: int) -> int:
    """Where in a part the k-th word of its plain form begins."""
    for m in re.finditer(r"\S+", part):
        n = len(_plain(m[0]).split(" ")) if _plain(m[0]) else 0
        if k < n:
            return m.start()
        k -= n
    return len(part)


def document_parts(label: Labeller | None, texts: list[str | None], every: bool = False, pooled: bool = True) -> list[list[dict]]:
    """Labelled parts of texts: ``first, last, lang, confidence, whole``.

    These are the whole sentences; with ``pooled`` also, of a text that has none, the whole text as one part, if it has a word of two letters. With
    ``every`` what is no sentence but has ``LEAST_WORDS`` words is a part too, and a sentence that follows a
    broken-off one in another language is two."""
    if label is None:
        return [[] for _ in texts]
    ranges: list[list[tuple[int, int, bool]]] = []
    for t in texts:
        mine = [x for x in sentences(t) if x[2] or every and word_count(t[x[0] : x[1]]) >= LEAST_WORDS]
        if pooled and not any(x[2] for x in mine) and t and _LETTERS.search(t):
            mine = [(len(t) - len(t.lstrip()), len(t.rstrip()), False)]
        ranges.append(mine)
    probs, changes = label.label([t[a:z] for t, r in zip(texts, ranges) for a, z, _ in r])
    out, at = [], 0
    for t, r in zip(texts, ranges):
        names, parts = label.document(probs[at : at + len(r)]), []
        for (a, z, whole), (name, sure), change in zip(r, names, changes[at : at + len(r)]):
            if every and change:
                mid = a + _word_start(t[a:z], change[0])
                k = int(change[1].argmax())
                parts.append({"first": a, "last": len(t[:mid].rstrip()), "lang": label.net.classes[k], "confidence": float(change[1][k]), "whole": False})
                a = mid
            parts.append({"first": a, "last": z, "lang": name, "confidence": sure, "whole": whole})
        out.append(parts)
        at += len(r)
    return out


def stretches(parts: list[dict]) -> list[dict]:
    """Neighbouring parts of one language as one, with the mean confidence of their characters."""
    out: list[dict] = []
    for p in parts:
        n = p["last"] - p["first"]
        if out and out[-1]["lang"] == p["lang"]:
            s = out[-1]
            s["confidence"] = (s["confidence"] * s["n"] + p["confidence"] * n) / max(s["n"] + n, 1)
            s["last"], s["n"], s["whole"] = p["last"], s["n"] + n, s["whole"] or p["whole"]
        else:
            out.append({**p, "n": n})
    return out


_LABELLED = "array<struct<first:int,last:int,lang:string,confidence:double,whole:boolean>>"


def labelled_sentences(docs: DataFrame, body: bytes | None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", every: bool = False, joined: bool = False, pooled: bool = True) -> DataFrame:
    """``doc_id, label, parts`` of every whole text (:func:`document_parts`); with ``joined`` neighbouring parts of one language are one. One pass, no shuffle.

    Null and empty texts and those without a word of two letters have no parts; without a network nothing has."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), named_language(F.col(lang)).alias("label"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(body)  # about 200 kB, by the size of the network
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("whole", pa.bool_())]))

    def run(batches):
        label = Labeller(shared.value) if shared.value else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                parts = document_parts(label, b.column(2).to_pylist(), every, pooled)
                if joined:
                    parts = [[{k: x[k] for k in ("first", "last", "lang", "confidence", "whole")} for x in stretches(p)] for p in parts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, kind)], ["doc_id", "label", "parts"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, label string, parts {_LABELLED}")


_fitted: dict[tuple, bytes | None] = {}


def _network(spark: SparkSession, sf_dir: str) -> bytes | None:
    """The network of the documents of a folder, fitted once in an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _fitted:
        _fitted[at] = fitted_network(tables(spark, sf_dir)("documents"))
    return _fitted[at]


def _labelled(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return labelled_sentences(tables(spark, sf_dir)("documents"), _network(spark, sf_dir), **how)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = F.array_distinct(F.transform(F.filter("parts", lambda p: p["whole"]), lambda p: p["lang"]))
    d = _labelled(spark, sf_dir, pooled=False).select("doc_id", "label", langs.alias("langs")).where("size(langs) > 0")
    case = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.coalesce("label", F.lit("")))
    return d.where(case).select("doc_id", F.explode("langs").alias("lang")).distinct()


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, with its share of the text as confidence-weighted mean; null where no word is."""
    d = _labelled(spark, sf_dir)
    size = lambda p: (p["last"] - p["first"]).cast("double")
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + size(p))
    score = lambda l: F.aggregate(F.filter("parts", lambda p: p["lang"] == l), F.lit(0.0), lambda a, p: a + size(p) * p["confidence"])
    best = F.array_max(F.transform(F.array_distinct(F.transform("parts", lambda p: p["lang"])), lambda l: F.struct(score(l).alias("score"), l.alias("lang"))))
    return d.withColumn("best", best).select("doc_id", F.col("best.lang").alias("lang"), F.try_divide("best.score", total).alias("confidence"), F.col("label").alias("delivered"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of every document in one language, from the labels of its sentences, of what is no sentence and of the positions
    where a sentence changes: ``doc_id, first_char, last_char, lang, confidence, has_sentence``."""
    d = _labelled(spark, sf_dir, every=True, joined=True).select("doc_id", F.inline("parts"))
    return d.select("doc_id", F.col("first").alias("first_char"), F.col("last").alias("last_char"), "lang", "confidence", F.col("whole").alias("has_sentence"))


def p9_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of a network fitted without them with the labels of the documents set aside (a tenth by hash), per language named:
    ``lang, sentences, agreed``. Labels are wrong for some documents, so full agreement isn't to be had."""
    docs = tables(spark, sf_dir)("documents")
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(10)) == 0
    d = labelled_sentences(docs.where(aside), fitted_network(docs.where(~aside))).where("label is not null")
    return d.select("label", F.explode(F.filter("parts", lambda p: p["whole"])).alias("p")).groupBy(F.col("label").alias("lang")).agg(F.count("*").alias("sentences"), F.count_if(F.col("p.lang") == F.col("label")).alias("agreed"))


QUERIES = {"p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments, "p9_accuracy": p9_accuracy}
ORACLE: dict[str, str] = {}
