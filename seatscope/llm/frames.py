"""Small helpers on DataFrames shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.session import shared_folder


_PREFIX = "llm-"


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores added until no column has that name in any case."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def staged(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Write ``table`` to the shared folder and read it back: computed once, lineage cut."""
    path = f"{shared_folder(spark)}/{_PREFIX}{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def one_text_each(table: DataFrame, *keys: str) -> DataFrame:
    """One row per value of ``keys``, with the first of its texts in order: a bound on keys is one on rows."""
    return table.groupBy(*keys).agg(F.min("text").alias("text"))


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove what ``staged`` has written for these tables; nothing may read them afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if PurePosixPath(folder).name.startswith(_PREFIX):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int, weight: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key`` and its number of rows in ``weight``.

    Keys with more than a ten-thousandth of ``total`` rows, of which there are at most ten thousand, are
    broadcast; so no task of the shuffle for the others meets a large key.
    """
    is_heavy = F.col(weight) > max(100, total // 10_000)
    heavy, light = table.filter(is_heavy), table.filter(~is_heavy)
    marks = F.broadcast(heavy.select(F.col(key).alias("heavy_key")))
    rest = rows.join(marks, F.col(key) == F.col("heavy_key"), "left_anti")
    return rest.join(light, key).unionByName(rows.join(F.broadcast(heavy), key))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` for ``mapInArrow``, after which the worker gives unused memory back to the system.

    Workers live on from task to task, and the memory of numpy and Arrow would stay with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
