"""Every trace query against its SQL on the smallest tables, and the replay at any partitioning."""

import pytest
from pyspark.sql import functions as F

from chronoloom import catalog
from chronoloom.operators import replay as rp
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_entry_at_any_partitioning(spark, duck, partitions):
    import __spark_entry__

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = __spark_entry__.entry(spark).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows_of(got) == rows_of(duck.sql(catalog.SQL["state_spans"]).df())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_replay_of_batches_of_one_row(spark):
    """Every batch of the replay holds one record kind only, so most columns are null in it."""
    events = catalog._log_events(spark, SF).filter("session_id < 6")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(rp.replay(events))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = key(rp.replay(events))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and {r["rec"] for r in rp.replay(events).select("rec").distinct().collect()} == {"executor", "task", "core", "metric"}


def test_stream_of_ten_micro_batches_equals_the_batch(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_MICRO_BATCHES", 10)
    got = catalog._streamed_replay(spark, SF)
    entity = F.concat_ws("/", "rec", "core_id", "executor_id", "task_id", "prev_label", "label", "by_executor_id", "prev_executor_id", "name", "value", "pid")
    rows = lambda df: sorted(map(str, df.select("session_id", "seq", "ts_us", entity).collect()))
    # E2 routing leaves out cores that an event cannot change, so the rows are the same and only their numbers differ
    assert rows(got) == rows(catalog._replayed(spark, SF))


def test_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from chronoloom import shared

    unset = SimpleNamespace(get=lambda k, d=None: d)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, applicationId="x"))
    with pytest.raises(ValueError):
        shared.shared_dir(cluster)
