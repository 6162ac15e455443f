"""Output: one folder per result table under the output path."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# Missing values are blank cells in text output.
OUTPUT_OPTIONS = {
    "parquet": {},
    "csv": {"header": "true", "nullValue": "", "emptyValue": "", "escape": '"'},
    "json": {},
    "orc": {},
}


class Publication:
    """A folder of its own for each run under ``path``, and a marker file that makes the run the current one.

    A marker is created in one step once all tables are written, so readers see a run whole or not at all.
    Its name begins with a running number; the highest is current. The run before it is kept for readers
    that have begun with it, older ones are removed.
    """

    _MARKERS = "_published"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = path.rstrip("/")
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._run = f"run-{uuid.uuid4().hex}"

    @property
    def folder(self) -> str:
        """Where this run writes its tables."""
        return f"{self._root}/{self._run}"

    def _path(self, name: str):
        return self._hadoop.Path(f"{self._root}/{name}" if name else self._root)

    def published(self) -> list[str]:
        """Marker names of the published runs, the current one last."""
        markers = self._path(self._MARKERS)
        if not self._files.exists(markers):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(markers))

    def publish(self) -> None:
        before = self.published()
        number = int(before[-1].split("-", 1)[0]) + 1 if before else 1
        self._files.create(self._path(f"{self._MARKERS}/{number:09d}-{self._run}"), False).close()
        for marker in before[:-1]:
            self._files.delete(self._path(f"{self._MARKERS}/{marker}"), False)
            self._files.delete(self._path(marker.split("-", 1)[1]), True)

    def withdraw(self) -> None:
        """Remove what an unfinished run has written."""
        if not any(marker.endswith(self._run) for marker in self.published()):
            self._files.delete(self._path(self._run), True)


def current_run(spark: SparkSession, path: str) -> str:
    """The folder of the published run under ``path``."""
    published = Publication(spark, path).published()
    if not published:
        raise FileNotFoundError(f"No published review under {path}")
    return f"{path.rstrip('/')}/{published[-1].split('-', 1)[1]}"


def read_result(spark: SparkSession, path: str, name: str, output_format: str = "parquet") -> DataFrame:
    """One result table of the published run under ``path``."""
    options = {"header": "true"} if output_format == "csv" else {}
    return spark.read.format(output_format).options(**options).load(f"{current_run(spark, path)}/{name}")


def write_tables(
    tables: Mapping[str, DataFrame],
    path: str,
    output_format: str = "parquet",
    at_once: int = 4,
    partition_by: str | None = None,
) -> list[str]:
    """Write each table, replacing what an earlier run left there. Returns the folders written.

    Most result tables are small, so a few writes are submitted at a time to keep the cluster busy.
    """
    if output_format not in OUTPUT_OPTIONS:
        raise ValueError(f"Unsupported output format: {output_format}")

    def write(name: str) -> str:
        folder = f"{path.rstrip('/')}/{name}"
        writer = tables[name].write.mode("overwrite").format(output_format)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.options(**OUTPUT_OPTIONS[output_format]).save(folder)
        return folder

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(write, tables))
