"""Sessions and table access."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators assume; all are Spark defaults or safe on any cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "tessera", **settings: str) -> SparkSession:
    """A session with the assumed settings; master and sizes are the caller's."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A base table, pruned to ``columns``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder of ``spark.checkpoint.dir`` that nothing else uses. Where that is unset a session in one local
    process has a default; on a cluster it is an error. What is written there goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{(base or '/tmp/checkpoints').rstrip('/')}/tessera/{spark.sparkContext.applicationId}")
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(own)
    fs.deleteOnExit(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder and read back."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
