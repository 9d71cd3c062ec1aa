"""Event streams: windowed counts with late data, and running melodies per user."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from notefold.runtime import shared_dir


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """The events table of a folder as a stream of files, up to ``per_trigger`` of them in a micro-batch."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and mean value per type and window; rows later than ``late`` behind the newest are dropped."""
    e = events.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(result: DataFrame, name: str | None = None, keys: list[str] | None = None, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give its result.

    The state and the results of a stream with a ``name`` lie under that name in the shared folder: run again, also after it broke off, it goes on behind
    what it has read. Each micro-batch is written to a place of its own, so a repeated one replaces itself. In update mode the newest row of each of
    ``keys`` counts; in complete mode the last batch is the result."""
    spark = result.sparkSession
    place = f"{shared_dir(spark)}/notefold-stream-{name or uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/out")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return spark.createDataFrame([], result.schema)
    rows = spark.read.schema(StructType([*result.schema.fields, StructField("batch", LongType())])).option("basePath", f"{place}/out").parquet(f"{place}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))  # one row
        return rows.join(F.broadcast(last), "batch").select(*result.columns)
    newest = F.max_by(F.struct(*result.columns), "batch").alias("r")
    return rows.groupBy(*keys).agg(newest).select("r.*")


STATE = "last int, leaps long, n long"


def running_leaps(events: DataFrame) -> DataFrame:
    """Per user the moves of six semitones and more so far; the state of a user is three numbers, whatever comes.

    Events of a user must come in order of time over the micro-batches; within one they are sorted. A task holds the events a user has in one
    micro-batch, which ``per_trigger`` of :func:`event_stream` bounds."""
    import numpy as np
    import pandas as pd

    def step(key, batches, state):
        last, leaps, n = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        pitch = (rows["value"].to_numpy() // 1).astype("int64") % 88 + 21
        before = np.concatenate([[pitch[0] if last is None else last], pitch[:-1]])
        state.update((int(pitch[-1]), leaps + int((abs(pitch - before) >= 6).sum()), n + len(pitch)))
        yield pd.DataFrame({"user_id": [key[0]], "leaps": [state.get[1]], "n": [state.get[2]]})

    e = events.where("user_id is not null and value is not null and ts is not null").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, leaps long, n long", STATE, "update", "NoTimeout")
