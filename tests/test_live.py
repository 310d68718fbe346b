"""Tables that are replaced whole or not at all, and streams that keep running sums in them."""

import pytest
from pyspark.sql import functions as F

from spendscope.sources.live import LiveTable
from spendscope.sources.sinks import COST_KEYS, COST_PARTITIONS, upsert
from spendscope.streaming import runner as R
from tests.test_sources import _costs


def rows_of(df):
    return sorted((r.account_id, r.cost_usd) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = LiveTable(spark, f"{tmp_path}/costs", COST_PARTITIONS, COST_KEYS)
    t.write(_costs(spark, [("a", 1, "g", 1), ("b", 2, "g", 2), ("c", 3, None, 3)]))
    return t


def test_upsert_and_versions(spark, table):
    load = _costs(spark, [("b", 2, "g", 7), ("d", 2, "g", 1)])
    before = table.read()
    want = rows_of(upsert(before, load, COST_KEYS))
    for _ in range(2):
        table.upsert(load)
        assert rows_of(table.read()) == want == [("a", 1.0), ("b", 7.0), ("c", 3.0), ("d", 1.0)]
    assert table.version() == 2 and rows_of(table.read(0)) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    table.vacuum(keep=1)
    assert rows_of(table.read()) == want and table.version() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table.live(0)


def test_only_touched_partitions_are_written(spark, table, tmp_path):
    table.upsert(_costs(spark, [("b", 2, "g", 7)]))
    loads = {p.name: len(list(p.iterdir())) for p in (tmp_path / "costs/data/cloud_provider=aws").iterdir()}
    assert loads == {"usage_date=2024-01-01": 1, "usage_date=2024-01-02": 2, "usage_date=2024-01-03": 1}
    plan = table.read(within=spark.createDataFrame([("aws", "2024-01-02")], "cloud_provider string, d string").select("cloud_provider", F.to_date("d").alias("usage_date")))
    assert rows_of(plan) == [("b", 7.0)]


def test_a_failure_between_two_partitions_leaves_the_old_table(spark, table, tmp_path):
    """The second partition's rows fail when they are written; so does the list of versions that has begun."""
    load = _costs(spark, [("a", 1, "g", 9), ("b", 2, "g", 9)])
    want = rows_of(table.read())

    def broken(stored, source):
        bad = F.when(F.col("account_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("cost_usd"))
        return upsert(stored, source, COST_KEYS).repartition(2, "usage_date").withColumn("cost_usd", bad.cast("double"))

    with pytest.raises(Exception, match="lost"):
        table.upsert(load, broken)
    assert rows_of(table.read()) == want and table.version() == 0
    (tmp_path / "costs/live/1/_temporary").mkdir(parents=True)  # a version whose marker was never written
    assert rows_of(table.read()) == want
    assert rows_of(LiveTable(spark, table.path, COST_PARTITIONS, COST_KEYS).read()) == want


def test_null_partitions_and_empty_ones(spark, tmp_path):
    t = LiveTable(spark, f"{tmp_path}/t", COST_PARTITIONS, COST_KEYS)
    first = _costs(spark, [("a", 1, "g", 1), ("b", 2, "g", 2)]).withColumn("usage_date", F.when(F.col("account_id") != "a", F.col("usage_date")))
    t.write(first)
    t.upsert(first.withColumn("cost_usd", F.col("cost_usd") * 10))
    assert rows_of(t.read()) == [("a", 10.0), ("b", 20.0)]
    t.write(first.where("account_id = 'a'"), touched=first.select(*COST_PARTITIONS))
    assert rows_of(t.read()) == [("a", 1.0)]
    with pytest.raises(ValueError, match="no complete version"):
        LiveTable(spark, f"{tmp_path}/none", COST_PARTITIONS, COST_KEYS).read()
    with pytest.raises(ValueError, match="among the keys"):
        LiveTable(spark, f"{tmp_path}/none", COST_PARTITIONS, ("account_id",))


def sums(df):
    return df.groupBy(*COST_KEYS).agg(F.sum("cost_usd").alias("cost_usd"))


def test_running_sums_over_batches(spark, tmp_path, table):
    load = _costs(spark, [("a", 1, "g", 5), ("a", 1, "g", 7), ("b", 2, "g", 2), ("new", 1, "g", 4)])
    for amount in (5, 7, 2, 4):
        load.where(F.col("cost_usd") == amount).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{amount}")
    stream = spark.readStream.schema(load.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    R.run_available(stream, f"{tmp_path}/cp", R.sums_writer(table, sums, lambda df: df.withColumn("cost_usd", F.col("cost_usd") * 2)), mode="append")
    assert rows_of(table.read()) == [("a", 24.0), ("b", 4.0), ("c", 3.0), ("new", 8.0)]


def test_a_repeated_batch_adds_nothing_and_reads_only_its_partitions(spark, table):
    write = R.sums_writer(table, sums, lambda df: df)
    for number, amount in enumerate((5, 6, 7)):
        write(_costs(spark, [("a", 1, "g", amount)]), number)
    write(_costs(spark, [("a", 1, "g", 7)]), 2)  # once more after a crash
    assert rows_of(table.read()) == [("a", 18.0), ("b", 2.0), ("c", 3.0)]
    # What a batch reads does not grow with the number of batches: the live files of one day, one for each partition.
    touched = _costs(spark, [("a", 1, "g", 1)]).select(*COST_PARTITIONS)
    assert table.read(within=touched).count() == 1
    day = table.live().where("usage_date = '2024-01-01'").count()
    for number in range(3, 8):
        write(_costs(spark, [("a", 1, "g", 1)]), number)
    assert table.live().where("usage_date = '2024-01-01'").count() == day == 1
    assert rows_of(table.read(within=touched)) == [("a", 23.0)]
