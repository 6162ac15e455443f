"""Excluded users from JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.params import Exclusions

# The document fields and the kind of exclusion each one lists.
EXCLUSION_FIELDS = {
    "excluded_user_exact_values": "exact",
    "excluded_user_contains_values": "contains",
}


def _field_problem(field: str) -> Column:
    """Why a document field is not a list of strings; NULL when it is one, or is absent."""
    kind = F.schema_of_variant(F.variant_get("document", f"$.{field}", "variant"))
    is_list = kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>")
    items = F.try_variant_get("document", f"$.{field}", "array<string>")
    has_null = F.exists(items, lambda item: item.isNull())
    return F.when(
        kind.isNotNull() & (~is_list | F.coalesce(has_null, F.lit(False))),
        F.concat(F.lit(f"{field} in "), F.col("origin"), F.lit(" must be a JSON array of strings")),
    )


def _documents(texts: DataFrame) -> DataFrame:
    """``(origin, value)`` JSON texts to documents, each with its problem or NULL."""
    parsed = texts.select("origin", F.try_parse_json("value").alias("document"))
    not_object = F.coalesce(
        ~F.schema_of_variant("document").startswith("OBJECT"), F.lit(True)
    )
    problem = F.coalesce(
        F.when(
            not_object,
            F.concat(F.lit("Exclusions file must contain a JSON object: "), F.col("origin")),
        ),
        *[_field_problem(field) for field in EXCLUSION_FIELDS],
    )
    return parsed.withColumn("problem", problem)


def _rows(documents: DataFrame) -> DataFrame:
    lists = F.map_from_arrays(
        F.array(*[F.lit(kind) for kind in EXCLUSION_FIELDS.values()]),
        F.array(
            *[
                F.try_variant_get("document", f"$.{field}", "array<string>")
                for field in EXCLUSION_FIELDS
            ]
        ),
    )
    return documents.select(F.explode(lists).alias("kind", "values")).select(
        "kind", F.explode("values").alias("value")
    )


def parse_exclusions(texts: DataFrame) -> DataFrame:
    """``(kind, value)`` rows of exclusion documents; a malformed document fails the query."""
    documents = _documents(texts)
    checked = F.when(F.col("problem").isNull(), F.col("document")).otherwise(
        F.raise_error(F.col("problem")).cast("variant")
    )
    return _rows(documents.select(checked.alias("document")))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, value)`` rows of the exclusion files at a path; none when the path is missing."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(
            F.lit("").alias("kind"), F.lit("").alias("value")
        )
    documents = _documents(files.select(F.col("_metadata.file_path").alias("origin"), "value"))
    bad = documents.filter(F.col("problem").isNotNull()).select("problem").first()
    if bad is not None:
        raise ValueError(bad["problem"])
    return _rows(documents)


def load_exclusions(spark: SparkSession, path: str) -> Exclusions:
    """Exclusions ready for use in ``Params``: always a table, whatever the length of the lists."""
    return Exclusions(table=read_exclusions(spark, path))
