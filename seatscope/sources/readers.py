"""The four inputs: login audit, denial audit, named licences, technician list."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.functions.text import name_key, strip
from seatscope.operators.reshape import first_per_key
from seatscope.params import Params, Source

FILE_FORMATS = ("csv", "parquet", "json", "orc")
# Quotes are doubled inside quoted cells, as spreadsheet exports write them.
CSV_OPTIONS = {"header": "true", "inferSchema": "false", "quote": '"', "escape": '"'}
JSON_OPTIONS = {"primitivesAsString": "true"}

TECHNICIAN_COLUMNS = {
    "production_technician_name": "string",
    "production_technician_match_key": "string",
}
NAMED_COLUMNS = {
    "named_user": "string",
    "allocated_licence": "string",
    "named_user_match_key": "string",
}
_ORDER = "_input_order"


def empty_table(spark: SparkSession, columns: dict[str, str]) -> DataFrame:
    """A table with no rows. Spark drops joins to it while planning."""
    return spark.range(0).select(
        *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]
    )


def check_columns(table: DataFrame, required: Iterable[str], what: str = "") -> None:
    """Refuse a table that lacks required columns. Looks at the schema only."""
    missing = sorted(set(required) - set(table.columns))
    if missing:
        raise ValueError(f"Missing required {what}columns: {', '.join(missing)}")


def _source_format(source: Source) -> str:
    kind = (source.format or PurePosixPath(source.path).suffix.lstrip(".")).lower()
    if kind not in (*FILE_FORMATS, "table"):
        raise ValueError(f"Unsupported input format: {kind or source.path}")
    return kind


def _scan(spark: SparkSession, source: Source) -> DataFrame:
    kind = _source_format(source)
    if kind == "table":
        return spark.read.table(source.path)
    defaults = {"csv": CSV_OPTIONS, "json": JSON_OPTIONS}.get(kind, {})
    return spark.read.format(kind).options(**{**defaults, **source.options}).load(source.path)


def _trim_headers(table: DataFrame) -> DataFrame:
    return table.toDF(*[name.strip() for name in table.columns])


def _missing_to_null(table: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """Text cells that stand for "missing" become NULL."""
    if not tokens:
        return table
    return table.select(
        *[
            F.when(~F.col(f"`{name}`").isin(*tokens), F.col(f"`{name}`")).alias(name)
            if kind == "string"
            else F.col(f"`{name}`")
            for name, kind in table.dtypes
        ]
    )


def read_input(spark: SparkSession, source: Source, params: Params) -> DataFrame:
    """One input table with trimmed header names; a missing path is Spark's own error."""
    table = _trim_headers(_scan(spark, source))
    is_text = _source_format(source) == "csv"
    return _missing_to_null(table, params.missing_tokens) if is_text else table


def _file_position() -> Column:
    """Position of a row in its input files: file, block, then running number within the scan."""
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )


def _read_ordered(spark: SparkSession, source: Source, params: Params) -> DataFrame:
    """As ``read_input`` plus the input order, for lists where the first spelling counts."""
    table = _scan(spark, source)
    if source.order_column:
        position = F.col(f"`{source.order_column}`")
    elif _source_format(source) == "table":
        position = F.monotonically_increasing_id()
    else:
        position = _file_position()
    table = _trim_headers(table.withColumn(_ORDER, position))
    is_text = _source_format(source) == "csv"
    return _missing_to_null(table, params.missing_tokens) if is_text else table


def read_login_audit(spark: SparkSession, params: Params) -> DataFrame:
    if params.login is None:
        raise ValueError("A login audit source is required")
    return read_input(spark, params.login, params)


def read_denial_audit(spark: SparkSession, params: Params) -> DataFrame:
    """The denial audit, or an empty audit when the parameters name none."""
    if params.denials is None:
        names = (params.denial_label_column, params.denial_timestamp_column, params.denial_user_column)
        return empty_table(spark, dict.fromkeys(names, "string"))
    return read_input(spark, params.denials, params)


def technician_list(table: DataFrame, params: Params, order: Column) -> DataFrame:
    """Names stripped, blanks dropped, first spelling kept per key."""
    if params.technician_name_column not in table.columns:
        raise ValueError(
            f"Missing Production Technician name column: {params.technician_name_column}"
        )
    name = strip(F.col(f"`{params.technician_name_column}`").cast("string"))
    names = (
        table.select(name.alias("production_technician_name"), order.alias(_ORDER))
        .filter(F.col("production_technician_name") != "")
        .withColumn("production_technician_match_key", name_key(F.col("production_technician_name")))
    )
    kept = first_per_key(
        names, "production_technician_match_key", [_ORDER, "production_technician_name"]
    )
    return kept.select(*TECHNICIAN_COLUMNS)


def read_technicians(spark: SparkSession, params: Params) -> DataFrame:
    if params.technicians is None:
        return empty_table(spark, TECHNICIAN_COLUMNS)
    table = _read_ordered(spark, params.technicians, params)
    return technician_list(table, params, F.col(_ORDER))


def named_licence_list(table: DataFrame, params: Params, order: Column) -> DataFrame:
    """Licence holders stripped, blank users dropped, first row kept per key."""
    check_columns(
        table, [params.named_user_column, params.named_licence_column], "named licence "
    )
    named = (
        table.select(
            strip(F.col(f"`{params.named_user_column}`").cast("string")).alias("named_user"),
            strip(F.col(f"`{params.named_licence_column}`").cast("string")).alias("allocated_licence"),
            order.alias(_ORDER),
        )
        .filter(F.col("named_user") != "")
        .withColumn("named_user_match_key", name_key(F.col("named_user")))
    )
    kept = first_per_key(named, "named_user_match_key", [_ORDER, "named_user", "allocated_licence"])
    return kept.select(*NAMED_COLUMNS)


def read_named_licences(spark: SparkSession, params: Params) -> DataFrame:
    if params.named is None:
        return empty_table(spark, NAMED_COLUMNS)
    table = _read_ordered(spark, params.named, params)
    return named_licence_list(table, params, F.col(_ORDER))
