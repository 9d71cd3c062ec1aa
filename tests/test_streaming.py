"""Streams that go on where they were."""

from notefold.streaming import events as S

ROWS = "event_id long, user_id long, ts timestamp, value double, event_type string"


def _add(spark, folder, name, data):
    spark.createDataFrame(data, ROWS).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{folder}/tmp-{name}/part-*.parquet")[0], f"{folder}/events{name}.parquet")


def test_a_named_stream_goes_on(spark, tmp_path, rows):
    """A second run reads only what is new, keeps users of earlier batches and goes on from their state."""
    from datetime import datetime

    t = lambda m: datetime(2025, 1, 1, 0, m)
    _add(spark, tmp_path, "", [(1, 1, t(1), 0.0, "a"), (2, 1, t(3), 10.0, "a"), (3, 1, t(2), 1.0, "a"), (4, 2, t(1), 5.0, "a"), (5, None, t(1), 5.0, "a")])
    run = lambda: rows(S.run_once(S.running_leaps(S.event_stream(spark, str(tmp_path))), f"test-{tmp_path.name}", ["user_id"], "update"))
    assert run() == [(1, 1, 3), (2, 0, 1)]
    _add(spark, tmp_path, "2", [(6, 1, t(5), 0.0, "a"), (7, 3, t(5), 0.0, "a")])
    assert run() == [(1, 2, 4), (2, 0, 1), (3, 0, 1)]
    assert run() == [(1, 2, 4), (2, 0, 1), (3, 0, 1)]


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], ROWS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert S.run_once(S.running_leaps(S.event_stream(spark, str(tmp_path))), keys=["user_id"], mode="update").count() == 0
