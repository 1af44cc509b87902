"""How often vessels enter geofences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.functions.dates import period_label, period_start


#: Steps of the calendar, by period.
STEPS = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH"}


def entries_per_period(
    events: DataFrame,
    period: str = "D",
    time_col: str = "entry_time",
    by: Sequence[str] = (),
    fill_gaps: bool = False,
) -> DataFrame:
    """Events per day (``D``), Monday-based week (``W``) or month (``M``), in order.

    Output columns are ``by``, ``period_start``, ``period_label`` and ``count``.
    Events without a time are left out. With ``by=("geofence",)`` all geofences are counted at once.
    Periods without events have no row, or with ``fill_gaps`` a count of 0 if they lie between
    the first and last period of their group.
    """
    start = F.col("period_start")
    counts = (
        events.where(F.col(time_col).isNotNull())
        .groupBy(*by, period_start(F.col(time_col), period).alias("period_start"))
        .count()
    )
    if fill_gaps:
        step = F.expr(STEPS[period])
        # Counted groups may be null, which the calendar must find again.
        keys = [f"_key{i}" for i in range(len(by))]
        known = counts.withColumnsRenamed(dict(zip(by, keys)))
        calendar = (
            counts.groupBy(*by)
            .agg(F.min("period_start").alias("_first"), F.max("period_start").alias("_last"))
            .where(F.col("_first").isNotNull())
            .select(*by, F.explode(F.sequence("_first", "_last", step)).alias("_start"))
        )
        same = F.col("_start") == start
        for name, key in zip(by, keys):
            same = same & F.col(name).eqNullSafe(F.col(key))
        counts = calendar.join(known, same, "left").select(
            *by, F.col("_start").alias("period_start"), F.coalesce("count", F.lit(0)).alias("count")
        )
    return counts.select(*by, "period_start", period_label(start, period).alias("period_label"), "count").orderBy(
        *by, "period_start"
    )
