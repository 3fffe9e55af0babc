"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on. A hot key on the probe side of a
# shuffled join is split by AQE; the forced form also covers joins whose output
# is re-partitioned afterwards.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # few bytes per match become hundreds of grid cells or draws: keep small tables spread
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(name: str = "matchframe", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.driver.host", "127.0.0.1")
                       .config("spark.driver.bindAddress", "127.0.0.1")
                       .config("spark.ui.enabled", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


_local_scratch: str | None = None
_scopes: list[list[str]] = []  # folders handed out in each open scope


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Owns the scratch folders handed out inside and removes them at the end: whatever is read
    from them has to be written elsewhere by then. Folders made outside a scope stay."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local master without a configured folder gets a temporary one; on a
    cluster a machine-local folder would not be seen by the other executors.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _local_scratch = _local_scratch or tempfile.mkdtemp(prefix="matchframe-")
        base = _local_scratch
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    return folder


def materialize(df: DataFrame, *folders: str) -> DataFrame:
    """Write once to the shared scratch folder and read back (cuts lineage).

    With columns as folders, a filter on them reads the files it needs only."""
    path = scratch_dir(df.sparkSession)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
