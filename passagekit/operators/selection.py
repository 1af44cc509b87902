"""Value filters shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Everything:
    def __repr__(self) -> str:
        return "EVERYTHING"


EVERYTHING = _Everything()
"""No filter at all. ``None`` and an empty list select nothing."""

Selection = Iterable | DataFrame | None | _Everything


def keep_selected(df: DataFrame, column: str, wanted: Selection) -> DataFrame:
    """Rows whose ``column`` is one of ``wanted``.

    A list becomes an IN predicate that reaches the scan. A one-column
    DataFrame, for lists too long to be literals, becomes a left semi join.
    """
    if wanted is EVERYTHING:
        return df
    if isinstance(wanted, DataFrame):
        key = wanted.columns[0]
        keys = wanted.select(F.col(f"`{key}`").alias("_wanted"))
        return df.join(keys, df[column] == keys["_wanted"], "left_semi")
    values = list(wanted or ())
    if not values:
        return df.where(F.lit(False))
    return df.where(F.col(column).isin(values))
