"""The stored index: its rows are moved once, and dealt by term and by parts of the texts."""

from pyspark.sql import functions as F

from joblattice.operators import search



def texts(spark):
    rows = [(i % 7 or None, f"Intern {i}", "Reno" if i % 2 else None, "the running runs of a runner, runs and Running") for i in range(20)]
    return spark.createDataFrame(rows, "id long, title string, location string, description string")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def plain(df):
    return sorted(map(str, df.select("term", "id", "field", "weight", "positions").collect()))


def test_index_rows_are_moved_once_and_equal_the_plain_ones(spark, tmp_path):
    df = texts(spark)
    index, dealt = search.build_index(df), search.build_index(df, buckets=4)
    # texts by their key; then, to be stored, the index rows
    assert (shuffles(index), shuffles(dealt)) == (1, 2)
    assert plain(dealt) == plain(index)
    # words of one term, and rows of one id, meet; rows without an id are one text
    runs = index.filter("term = 'run' AND field = 'description' AND id = 1").collect()
    assert len(runs) == 1 and runs[0].positions == sorted(runs[0].positions) and len(runs[0].positions) == 4 * 3
    assert index.filter("term = 'reno'").groupBy("id").count().filter("count > 1").count() == 0
    search.write_index(dealt, f"{tmp_path}/dealt", 4)
    search.write_index(index, f"{tmp_path}/plain", 4)
    stored = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("dealt", "plain")]
    assert plain(stored[0]) == plain(index) and plain(stored[0].filter("bucket = 1")) == plain(stored[1].filter("bucket = 1"))
    assert [sorted(map(str, search.search(s, "running reno", buckets=4).collect())) for s in stored] == [sorted(map(str, search.search(index, "running reno").collect()))] * 2


def test_a_frequent_term_is_cut_by_parts_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_ROWS", 5)
    dealt = search.build_index(texts(spark).withColumn("id", F.monotonically_increasing_id()), buckets=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 1
