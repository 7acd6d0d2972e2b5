from verdata.sources.files import read_spread


def test_small_table_is_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, 'x') AS t").coalesce(1).write.parquet(str(tmp_path / "one"))
    got = read_spread(spark, str(tmp_path / "one"))
    assert got.rdd.getNumPartitions() == cores
    assert sorted(got.collect()) == sorted(spark.read.parquet(str(tmp_path / "one")).collect())


def test_few_rows_many_files_and_no_rows_are_read_in_place(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(2000).repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "few"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    for name, n in (("many", 2000), ("few", 10), ("none", 0)):
        got = read_spread(spark, str(tmp_path / name))
        assert got.count() == n
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
