"""Scores of predicted answers against the reference: spans and judged labels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from notefold.functions import spans as S

THRESHOLDS = (0.5, 0.7)
# fixed values: order in which concepts are reported
CONCEPTS = ["rhythm", "tonality", "interval", "bar_comparison", "harmony", "repetition", "harmonic_pattern"]


def group_of(concept: Column, query_key: Column) -> Column:
    """The concept, else the second part of the query key, else ``unknown``."""
    return F.coalesce(F.nullif(concept, F.lit("")), F.try_element_at(F.split(query_key, "/"), F.lit(2)), F.lit("unknown"))


def aligned(qa: DataFrame, predictions: DataFrame, keys: tuple = ("sample_id", "question"), allow_missing: bool = False) -> DataFrame:
    """Questions with their prediction text.

    Two predictions for one question, and questions without any unless ``allow_missing``, raise an
    error when the rows are computed; allowed missing ones count as empty text. Keys are compared
    null-safe."""
    p = predictions.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.coalesce("prediction", F.lit(""))).alias("prediction"))
    p = p.withColumn("prediction", F.when(F.col("_n") > 1, F.raise_error(F.lit("two predictions for one question"))).otherwise(F.col("prediction"))).drop("_n")
    p = p.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & qa[k].eqNullSafe(p[f"_{k}"])
    j = qa.join(p, on, "left").drop(*[f"_{k}" for k in keys])
    missing = F.lit("") if allow_missing else F.raise_error(F.lit("a question has no prediction"))
    return j.withColumn("prediction", F.coalesce("prediction", missing.cast("string")))


def unmatched_predictions(qa: DataFrame, predictions: DataFrame, keys: tuple = ("sample_id", "question")) -> DataFrame:
    return predictions.join(qa.select(*keys).distinct(), list(keys), "left_anti")


def duplicate_predictions(predictions: DataFrame, keys: tuple = ("sample_id", "question")) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def remaining(qa: DataFrame, done: DataFrame, keys: tuple = ("sample_id", "question")) -> DataFrame:
    """Questions that an interrupted run has still to answer."""
    return qa.join(done.select(*keys).distinct(), list(keys), "left_anti")


def grounding_items(rows: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Per question: followed, merged IoU, numbers of spans and sums over its matches. ``rows`` has
    ``grp, prediction, gold`` (spans). Everything stays in the row."""
    d = rows.withColumn("p", S.parse_spans(F.col("prediction")))
    d = d.select("grp", ((F.size("p") > 0) | S.is_abstention(F.col("prediction"))).alias("followed"), S.merged_iou(F.col("p"), F.col("gold")).alias("miou"), F.size("p").alias("n_pred"), F.size("gold").alias("n_gold"), *[S.greedy_match(F.col("p"), F.col("gold"), t).alias(f"m{i}") for i, t in enumerate(thresholds)])
    add = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + x[f])
    out = d.select("*", *[x for i in range(len(thresholds)) for x in (F.size(f"m{i}").alias(f"hit{i}"), add(f"m{i}", "onset").alias(f"on{i}"), add(f"m{i}", "offset").alias(f"off{i}"))])
    return out.drop(*[f"m{i}" for i in range(len(thresholds))])


def grounding_scores(items: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Pooled scores over all and per group (``grp`` null for all); a ratio over nothing is 0."""
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = [F.count("*").alias("n"), F.sum(F.col("followed").cast("int")).alias("f"), F.sum("miou").alias("miou"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold")]
    sums += [F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(len(thresholds)) for c in ("hit", "on", "off")]
    g = items.groupingSets([[], ["grp"]], "grp").agg(F.grouping("grp").alias("overall"), *sums)
    out = [F.when(F.col("overall") == 1, "overall").otherwise(F.col("grp")).alias("grp"), "n", div(F.col("f"), F.col("n")).alias("ifr"), div(F.col("miou"), F.col("n")).alias("merged_iou")]
    for i, t in enumerate(thresholds):
        k = str(t).replace("0.", "")
        p, r = div(F.col(f"hit{i}"), F.col("n_pred")), div(F.col(f"hit{i}"), F.col("n_gold"))
        out += [p.alias(f"p{k}"), r.alias(f"r{k}"), div(2 * p * r, p + r).alias(f"f{k}"), (div(F.col(f"on{i}"), F.col(f"hit{i}")) * 1000).alias(f"onset_ms{k}"), (div(F.col(f"off{i}"), F.col(f"hit{i}")) * 1000).alias(f"offset_ms{k}"), F.col(f"hit{i}").alias(f"hits{k}")]
    return g.select(*out)


def followed(v: Column) -> Column:
    return F.coalesce(v["instruction_following_score"] == 1, F.lit(False))


def correct(v: Column) -> Column:
    return followed(v) & F.coalesce(v["accuracy_score"] == 1.0, F.lit(False))


def understanding_scores(judged: DataFrame) -> DataFrame:
    """Followed and correct shares over all and per concept, in the order of reports."""
    v = F.col("verdict")
    g = judged.groupingSets([[], ["concept"]], "concept").agg(F.grouping("concept").alias("o"), F.count("*").alias("n"), F.avg(followed(v).cast("double")).alias("ifr"), F.avg(correct(v).cast("double")).alias("accuracy"))
    rank = F.array_position(F.array(*[F.lit(c) for c in CONCEPTS]), F.col("concept"))
    return g.select(F.when(F.col("o") == 1, "overall").otherwise(F.col("concept")).alias("concept"), "n", "ifr", "accuracy", F.when(F.col("o") == 1, 0).when(rank > 0, rank).otherwise(len(CONCEPTS) + 1).cast("int").alias("place"))


def _balanced(text: str) -> Iterator[str]:
    """Objects in braces that are complete, from the first on; braces in strings do not count."""
    at = text.find("{")
    while at >= 0:
        depth, quoted, i = 0, False, at
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    yield text[at : i + 1]
                    break
            i += 1
        at = text.find("{", at + 1)


_FENCE = re.compile(r"```json\s*(\{.*?\})\s*```", re.DOTALL | re.IGNORECASE)


def find_json(text: str | None) -> str | None:
    """The first JSON object in free text: one that fills a fence tagged json, else the first complete one that parses."""
    for piece in [*_FENCE.findall(text or ""), *_balanced(text or "")]:
        try:
            return json.dumps(json.loads(piece))
        except ValueError:
            continue
    return None


_VERDICT = StructType([
    StructField("found", BooleanType()), *[StructField(k, DoubleType()) for k in ("instruction_following_score", "accuracy_score", "confidence")],
    StructField("error_reason", StringType()),
])


@F.pandas_udf(_VERDICT)
def extract_verdict(texts: pd.Series) -> pd.DataFrame:
    """The scores of judge outputs; a score that is missing or no number is null, truth values count as 0 and 1."""
    def number(v):
        return float(v) if isinstance(v, (int, float)) else None

    rows = []
    for t in texts:
        v = find_json(t)
        w = json.loads(v) if v else {}
        reason = w.get("error_reason")
        rows.append((v is not None, *[number(w.get(k)) for k in ("instruction_following_score", "accuracy_score", "confidence")], reason if isinstance(reason, str) or reason is None else json.dumps(reason)))
    return pd.DataFrame(rows, columns=["found", "instruction_following_score", "accuracy_score", "confidence", "error_reason"])


def verdicts(rows: DataFrame) -> DataFrame:
    """Judge outputs as ``verdict``: the scores of the object found; only where none is found, whether prediction and reference are the same text.

    An object without a score does not follow the instruction. Null texts count as empty."""
    v = extract_verdict("output")
    same = F.coalesce("prediction", F.lit("")) == F.coalesce("reference", F.lit(""))
    one = same.cast("double")
    # fixed values: the reasons given for a fallback
    reason = F.when(same, "correct (fallback)").otherwise("Fallback to string match (incorrect)")
    fallback = F.struct(one.alias("instruction_following_score"), one.alias("accuracy_score"), one.alias("confidence"), reason.alias("error_reason"))
    found = F.struct(*[F.col("_v")[k].alias(k) for k in ("instruction_following_score", "accuracy_score", "confidence", "error_reason")])
    return rows.withColumn("_v", v).withColumn("verdict", F.when(F.col("_v")["found"], found).otherwise(fallback)).drop("_v")


def judged(rows: DataFrame, make_model, batch: int = 64) -> DataFrame:
    """``output`` of a judge for every row with ``question, prediction, reference``.

    ``make_model()`` is called once in each task and gives a function from a list of (question,
    prediction, reference) to a list of texts, so a model is loaded once and sees batches. Null
    texts reach it as empty ones."""
    import pyarrow as pa

    schema = StructType([*rows.schema.fields, StructField("output", StringType())])

    def run(batches):
        model = make_model()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                asked = list(zip(*([x or "" for x in part.column(c).to_pylist()] for c in ("question", "prediction", "reference"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if t is None else str(t) for t in model(asked)], pa.string())], [*part.schema.names, "output"])

    return rows.mapInArrow(run, schema)


def judge_resumable(questions: DataFrame, path: str, make_model, keys: tuple = ("sample_id", "question")) -> DataFrame:
    """Judge what is not yet in the table at ``path`` and append it; a run that broke off goes on where it was."""
    spark = questions.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        questions = remaining(questions, spark.read.parquet(path), keys)
    judged(questions, make_model).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def score_table(scores: DataFrame) -> DataFrame:
    """Grounding scores as lines of fixed width, overall first."""
    f = lambda c: F.format_string("%.4f", c)
    line = F.concat_ws("  ", F.rpad(F.coalesce("grp", F.lit("")), 18, " "), F.format_string("%5d", "n"), *[f(c) for c in ("ifr", "merged_iou", "p5", "r5", "f5", "p7", "r7", "f7")])
    return scores.select("grp", line.alias("line")).orderBy(F.col("grp") != "overall", "grp")
