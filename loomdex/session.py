"""What sessions need to know of this package, how small inputs are spread, and where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where it lies; on a cluster without it there, ship it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Rows and bytes in one Arrow batch; both bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    importable(spark)


#: A split of input is worth a task from this size on.
SPLIT_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows that would fill fewer tasks than there are cores; larger inputs come in enough splits and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SPLIT_BYTES else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that ``spark.checkpoint.dir`` names; it is removed when the JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:  # only local sessions, such as tests, come here
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="loomdex-")
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/loomdex-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target.getParent())
    return path
