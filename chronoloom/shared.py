"""The folder that driver and executors share, for tables that are written once and read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session in one process gets a temporary folder; a
    cluster has to name one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        if sc.applicationId not in _own_dir:
            _own_dir[sc.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
            sc.setCheckpointDir(_own_dir[sc.applicationId])
        where = _own_dir[sc.applicationId]
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that ends in here go with it: of use to none, as what it wrote is read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back; cuts lineage and survives lost executors. ``lean``
    takes less of the disk, for tables about as large as the input or larger."""
    path = scratch(df.sparkSession, name)
    if lean:
        with shuffles_dropped(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
