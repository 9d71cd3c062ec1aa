"""Session helpers: the shared folder, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder is made and set if all runs in this one process (a ``local`` master); a cluster has no
    folder of its own that every executor sees, so there it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='notefold-')}"
        sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_notefold_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    place = tempfile.mkdtemp(prefix="notefold-package-")  # of the driver alone: Spark serves the file from there
    atexit.register(shutil.rmtree, place, True)
    sc.addPyFile(shutil.make_archive(os.path.join(place, "notefold-package"), "zip", os.path.dirname(here), os.path.basename(here)))
    sc._notefold_shipped = True


def cut(df: DataFrame, facts: list[Column] | None = None, codec: str = "snappy"):
    """Write ``df`` as Parquet into the shared folder and read it again.

    The written table survives the loss of any executor, is computed once however often it is used
    and ends the lineage, so loops keep plans of constant size. With ``facts``, named aggregates, these are taken
    while it is written and (table, row) is returned. Rows of tasks that ran twice may count twice in them."""
    spark = df.sparkSession
    if facts:
        seen = Observation()
        out = cut(df.observe(seen, *facts), codec=codec)
        return out, seen.get
    path = f"{shared_dir(spark)}/notefold-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._notefold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_notefold_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def alone(make):
    """``make()``, which gives a written table, several or plain values. What else it wrote is deleted and the shuffle files of its jobs are freed,
    which Spark does only when the driver collects its garbage: so a loop needs no more disk than its largest round and what the rounds give."""
    before = {path for _, path in _written}
    out = make()
    keep = before | {getattr(x, "_notefold_path", None) for x in (out if isinstance(out, (list, tuple)) else [out])}
    for spark, path in [x for x in _written if x[1] not in keep]:
        _delete(spark, path)
        _written.remove((spark, path))
    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            pass


def heaviest(counts: DataFrame, n: str = "n", most: int = 1024, least: int = 50_000) -> DataFrame:
    """The ``most`` keys of ``counts`` with the largest ``n`` of at least ``least``.

    At most ``most`` rows, so it may be broadcast at any size of the data, and any key left out
    holds less than 1/``most`` of all rows. Keys of equal ``n`` come in the order of their other
    columns, so every evaluation gives the same keys. It only plans salting; no row is dropped."""
    return counts.where(F.col(n) >= least).orderBy(F.col(n).desc(), *[c for c in counts.columns if c != n]).limit(most)


def tables(spark: SparkSession, sf_dir: str):
    """Reader of the test tables below ``sf_dir``: ``t("clips")``."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
