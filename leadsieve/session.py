"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # the JVM does not compile methods beyond 8000 bytes; the widest rule stages would run
    # interpreted if they were fused into one
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(app: str = "leadsieve", cores: str = "*", partitions: int = 8, **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    # the generated code of one queue alone takes about forty entries of the default hundred
    builder = builder.config("spark.sql.codegen.cache.maxEntries", "2000")
    # call sites in error messages cost a JVM round trip per column expression
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Apply the settings every result depends on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder named in `spark.checkpoint.dir`.

    A machine-local folder is used only by a local-mode session that names none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    name = f"{label}-{uuid.uuid4().hex}"
    if shared:
        return f"{shared.rstrip('/')}/leadsieve/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.mkdtemp(prefix="leadsieve-"), name)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a costly result to the scratch folder and read it back, for plans that use it twice.

    The stored rows survive lost executors, and nothing upstream runs again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
