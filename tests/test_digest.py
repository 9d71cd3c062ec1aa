from notefold.plans import registry


def test_other_content_gives_another_digest(spark, tmp_path):
    """Two tables with equal rows in the columns first read, and another value in one more column."""
    got = []
    for name, last in (("a", "x"), ("b", "y"), ("c", "x")):
        df = spark.createDataFrame([(1, "s", 0, last), (2, "s", 1, None)], "id long, source string, semitones int, other string")
        (df if name != "c" else df.orderBy("id", ascending=False)).write.parquet(f"{tmp_path}/{name}/manifest.parquet")
        got.append(tuple(registry.queries()["content_digest_whole"](spark, f"{tmp_path}/{name}").first()))
    assert got[0] == got[2] and got[0] != got[1] and got[0][0] == got[1][0] == 2
