"""Small relational building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compute_once(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns whose expressions are evaluated once per row.

    Spark copies a computed column into every filter that uses it. Values that come out of a
    generator are not copied, so costly expressions that are filtered on go through one.
    """
    kept = [f"`{name}`" for name in table.columns if name not in columns]
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return table.select(*kept, F.inline(F.array(values))).select(
        *[f"`{name}`" for name in table.columns],
        *[f"`{name}`" for name in columns if name not in table.columns],
    )


def first_per_key(table: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    Spark limits each key to its first row before the shuffle as well as after it, so a key that
    holds a large share of all rows sends one row per task.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return (
        table.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def match_list(
    listed: DataFrame, list_key: str, users: DataFrame, user_key: str
) -> DataFrame:
    """Every listed person with every user of the same key; user columns NULL where there is none.

    Same rows as a left join, built so that the user side never has to be the build side: matched
    rows come from an inner join in which either side may be broadcast or split when a key is hot,
    and the rest of the list from an anti join against the keys that occur.
    """
    keyed_users = users.withColumnRenamed(user_key, "_user_key")
    matched = keyed_users.join(listed, F.col("_user_key") == F.col(list_key), "inner")
    seen_keys = (
        users.select(F.col(user_key).alias("_user_key"))
        .join(listed.select(F.col(list_key).alias("_list_key")), F.expr("_user_key = _list_key"), "left_semi")
        .distinct()
    )
    unmatched = listed.join(seen_keys, F.col(list_key) == F.col("_user_key"), "left_anti")
    return matched.drop("_user_key").unionByName(unmatched, allowMissingColumns=True)


def metric_table(parts: Sequence[tuple[DataFrame, Sequence[tuple[str, Column]]]]) -> DataFrame:
    """One-row aggregates turned into ``(metric, value)`` rows, in the order they are listed."""
    pieces = []
    position = 0
    for one_row, metrics in parts:
        cells = []
        for label, value in metrics:
            cells.append(
                F.struct(
                    F.lit(position).alias("position"),
                    F.lit(label).alias("metric"),
                    value.alias("value"),
                )
            )
            position += 1
        pieces.append(one_row.select(F.inline(F.array(*cells))))
    table = pieces[0]
    for piece in pieces[1:]:
        table = table.unionByName(piece)
    if len(pieces) > 1:
        table = table.orderBy("position")
    return table.drop("position")
