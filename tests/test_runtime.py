"""The shared folder and the choice of hot keys."""

import pytest
from pyspark.sql import functions as F

from notefold import runtime as R


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master):
        self.sparkContext = _Context(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_no_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        R.shared_dir(_Session(master))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_own_folder_in_one_process(master):
    assert R.shared_dir(_Session(master)).startswith("file:///")


def test_tied_hot_keys_are_the_same_every_time(spark):
    """1,030 keys tie for 1,024 places; whatever the partitions, the same ones are chosen."""
    counts = spark.range(1030).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("other"), F.lit(60_000).alias("n"))
    chosen = [{r["key"] for r in R.heaviest(counts.repartition(k, F.xxhash64("key", F.lit(k)))).collect()} for k in (1, 3, 7)]
    assert len(chosen[0]) == 1024 and chosen[0] == chosen[1] == chosen[2]
