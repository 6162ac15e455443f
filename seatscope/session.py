"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Wall-clock times carry no zone, so both settings below are needed for right results.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}
# Runtime re-planning: partition sizes, broadcast choice by measured size, splitting of hot keys.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the review relies on."""
    for key, value in {**RESULT_SETTINGS, **SCALE_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local-mode session that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="seatscope-")
    raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach")


class StagedTables:
    """Writes intermediate results once, so that the tables built on them do not recompute them.

    The written tables also cut lineage: losing an executor later costs a re-read, not a re-run.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._root = f"{shared_folder(spark)}/seatscope-{uuid.uuid4().hex}"

    def __call__(self, name: str, table: DataFrame) -> DataFrame:
        path = f"{self._root}/{name}"
        table.write.parquet(path)
        return self._spark.read.schema(table.schema).parquet(path)

    def remove(self) -> None:
        """Delete what this run has staged; its tables cannot be read afterwards."""
        jvm, context = self._spark._jvm, self._spark._jsc.sc()
        path = jvm.org.apache.hadoop.fs.Path(self._root)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def unstaged(name: str, table: DataFrame) -> DataFrame:
    """Leave the table lazy; for a single query Spark reuses equal shuffles on its own."""
    return table
