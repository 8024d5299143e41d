"""Session settings and the scratch area used to cut lineage between iterations."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

# Safe on any cluster; the number of shuffle partitions is left to the deployment and AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName("ripple")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, name: str = "step", bucket_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and continue from the written table.

    The table survives executor loss, ends the lineage, and gives the planner exact sizes, so a later
    join broadcasts it only when it really is small. With ``bucket_by`` the table is laid out by those
    columns once, and later joins on them do not shuffle it again.
    """
    spark = df.sparkSession
    token = f"ripple_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{scratch_root(spark)}/{token}"
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *bucket_by).write.bucketBy(n, *bucket_by).sortBy(*bucket_by)
     .option("path", path).format("parquet").saveAsTable(token))
    return spark.table(token)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core; larger scans are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Levels:
    """Rows of an iterative walk, one folder per level, read back together as a single table."""

    def __init__(self, spark: SparkSession, name: str, number: str):
        self.spark, self.number, self.count = spark, number, 0
        self.path = f"{scratch_root(spark)}/ripple_{name}_{uuid.uuid4().hex}"
        self.schema = None

    def append(self, rows: DataFrame) -> DataFrame:
        """Write the next level and return it as a stored table."""
        self.schema = rows.schema
        path = f"{self.path}/{self.number}={self.count}"
        rows.write.parquet(path)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """Every level so far, with the level number as an integer column."""
        full = StructType(list(self.schema.fields) + [StructField(self.number, IntegerType())])
        return self.spark.read.schema(full).parquet(self.path)
