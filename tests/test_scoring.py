import pytest
from pyspark.sql import functions as F

from notefold.functions import spans as S
from notefold.functions.wording import grounding_answers, numeric_answers, two_places
from notefold.operators import scoring as G


def one(spark, column, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return d.select(column.alias("v")).first()[0]


def sp(*pairs):
    return F.array(*[F.struct(F.lit(float(a)).alias("s"), F.lit(float(b)).alias("e")) for a, b in pairs]) if pairs else F.array().cast(S.NO_SPANS)


def test_parsing(spark):
    parse = lambda t: [tuple(x) for x in one(spark, S.parse_spans(F.col("t")), t=t)]
    assert parse("From 1.08 seconds to 1.48 seconds; from .5 Second to 2 seconds.") == [(1.08, 1.48), (0.5, 2.0)]
    assert parse("3 seconds to 2 seconds") == [(3.0, 3.0)] and parse("none") == []
    assert one(spark, S.is_abstention(F.col("t")), t="  NONE.. ") is True and one(spark, S.is_abstention(F.col("t")), t="there is  no such note in this clip.") is True
    assert one(spark, S.is_abstention(F.col("t")), t="nothing") is False and one(spark, S.is_abstention(F.lit(None).cast("string"))) is False


def test_overlap_and_merging(spark):
    assert one(spark, S.iou(sp((0, 2))[0], sp((1, 3))[0])) == pytest.approx(1 / 3) and one(spark, S.iou(sp((1, 1))[0], sp((1, 1))[0])) == 0
    assert [tuple(x) for x in one(spark, S.merged(sp((1, 2), (0, 1), (3, 4), (3.5, 3.6))))] == [(0, 2), (3, 4)]
    assert one(spark, S.merged_iou(sp(), sp())) == 0 and one(spark, S.merged_iou(sp((0, 1), (1, 2)), sp((0, 2)))) == 1


def test_greedy_takes_best_pair_first(spark):
    m = one(spark, S.greedy_match(sp((0, 1), (0.1, 1.1)), sp((0.1, 1.0), (0.2, 2.0)), 0.3))
    assert [(x["pi"], x["gi"]) for x in m] == [(0, 0), (1, 1)]
    ties = one(spark, S.greedy_match(sp((0, 1), (0, 1)), sp((0, 1), (0, 1)), 0.5))
    assert [(x["pi"], x["gi"]) for x in ties] == [(0, 0), (1, 1)]
    assert one(spark, S.greedy_match(sp((0, 1)), sp(), 0.5)) == []


def test_alignment(spark, rows):
    q = spark.createDataFrame([("a", "q1"), ("a", "q2"), (None, "q")], "sample_id string, question string")
    p = spark.createDataFrame([("a", "q1", "x"), ("a", "q2", None), (None, "q", "n")], "sample_id string, question string, prediction string")
    assert rows(G.aligned(q, p).select("question", "prediction")) == [("q", "n"), ("q1", "x"), ("q2", "")]
    with pytest.raises(Exception, match="two predictions"):
        G.aligned(q, p.union(p)).collect()
    with pytest.raises(Exception, match="no prediction"):
        G.aligned(q, p.where("question = 'q1'")).collect()
    assert rows(G.aligned(q, p.where("false"), allow_missing=True).select("prediction")) == [("",)] * 3


def test_json_in_free_text():
    assert G.find_json('so ```json\n{"a": 1}\n``` {"b": 2}') == '{"a": 1}' and G.find_json('x {"a":"}"} y') == '{"a": "}"}'
    assert G.find_json("no {") is None and G.find_json(None) is None and G.find_json('{bad} {"c": {"d": []}}') == '{"c": {"d": []}}'


def test_two_places_round_the_binary_value():
    assert [two_places(x) for x in (0.125, 1.005, 2.675, 0.135, None)] == ["0.12", "1.00", "2.67", "0.14", None]


def test_answers(spark):
    assert one(spark, grounding_answers(F.lit("0.50|1.00;2.00|2.50"), F.lit("the notes"), F.lit(True)))[:2] == ["[0.50s, 1.00s]; [2.00s, 2.50s]", "From 0.50 seconds to 1.00 seconds; From 2.00 seconds to 2.50 seconds."]
    assert one(spark, grounding_answers(F.lit(""), F.lit("x"), F.lit(True)))[0] == "none"
    assert one(spark, numeric_answers(F.lit(1), F.lit("beats"))) == ["1", "1 beat", "The answer is 1 beat."]


def test_judge_resumes(spark, tmp_path):
    asked = []

    def make_model():
        return lambda batch: ['{"instruction_following_score": 1, "accuracy_score": %d}' % (p == r) for _, p, r in batch]

    q = spark.createDataFrame([("a", "q1", "x", "x"), ("a", "q2", "y", "z"), ("b", "q1", None, "z")], "sample_id string, question string, prediction string, reference string")
    path = str(tmp_path / "judged")
    assert G.judge_resumable(q.limit(1), path, make_model).count() == 1
    done = G.judge_resumable(q, path, make_model)
    assert done.count() == 3 and asked == []
    scores = {r.concept: (r.n, r.accuracy) for r in G.understanding_scores(G.verdicts(done).withColumn("concept", F.col("sample_id"))).collect()}
    assert scores == {"overall": (3, pytest.approx(1 / 3)), "a": (2, 0.5), "b": (1, 0.0)}


def test_only_tagged_fences_come_first(spark):
    same = {"instruction_following_score": 1.0, "accuracy_score": 1.0, "confidence": 1.0, "error_reason": "correct (fallback)"}
    other = {"instruction_following_score": 0.0, "accuracy_score": 0.0, "confidence": 0.0, "error_reason": "Fallback to string match (incorrect)"}
    none = dict.fromkeys(same)
    cases = [
        ('{"a": 1} then ```\n{"instruction_following_score": 1}\n```', "x", "x", none),  # a fence without the tag is text like any other
        ('{"a": 1} then ```JSON {"instruction_following_score": 1, "accuracy_score": 0.5}```', "x", "y", none | {"instruction_following_score": 1.0, "accuracy_score": 0.5}),
        ("```json\n{broken}\n``` {\"confidence\": 2}", "x", "y", none | {"confidence": 2.0}),
        ("nothing {", "x", "x", same), ("nothing", "x", "x ", other), (None, None, "", same), ("", "a", None, other),
        ('{"instruction_following_score": true, "accuracy_score": "1", "error_reason": {"k": 1}}', "x", "x", none | {"instruction_following_score": 1.0, "error_reason": '{"k": 1}'}),
    ]
    d = spark.createDataFrame([(i, o, p, r) for i, (o, p, r, _) in enumerate(cases)], "i int, output string, prediction string, reference string")
    got = {r.i: r.verdict.asDict() for r in G.verdicts(d).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
