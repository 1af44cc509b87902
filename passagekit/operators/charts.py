"""Reductions of a table to the data of a chart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, NumericType

from passagekit.operators.quantiles import (
    SALT,
    SALTS,
    SKETCH_ACCURACY,
    exact_quantiles,
    for_all_salts,
    salted,
    value_weights,
)

HISTOGRAM_BINS = 20
QUARTILES = (0.25, 0.5, 0.75)
WHISKER_REACH = 1.5
AGGREGATIONS = ("sum", "mean", "min", "max", "count")
CHART_KINDS = ("bar", "line", "scatter", "pie", "box", "histogram")


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


#: Text for the null keys of a column: one for the x column, or one for each column named.
NullLabel = str | Mapping[str, str] | None


def _keyed(df: DataFrame, keys: Sequence[str], null_label: NullLabel) -> DataFrame:
    """Rows with all keys present; a label turns a column into text, its nulls into a group.

    A plain label belongs to the first key only; null keys without a label are left out.
    """
    labels = {keys[0]: null_label} if isinstance(null_label, str) else dict(null_label or {})
    df = df.dropna(subset=[key for key in keys if key not in labels])
    for key in keys:
        if key in labels:
            df = df.withColumn(key, F.coalesce(_q(key).cast("string"), F.lit(labels[key])))
    return df


def _finite(value: Column) -> Column:
    """A number as double, null if it is not a finite number."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def chart_agg(
    df: DataFrame,
    x: str,
    y: str | None = None,
    agg: str = "count",
    color: str | None = None,
    null_label: NullLabel = None,
) -> DataFrame:
    """``agg`` of ``y`` per ``x`` and optional ``color``, ordered by these keys.

    ``sum`` skips nulls and is 0 for a group of nulls only; ``count`` counts
    rows whatever ``y`` is. The value column is named ``value`` (``count`` for
    counts). A colour is a column of the result, one series per value.
    """
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}, expected one of {AGGREGATIONS}")
    keys = [x] if color is None or color == x else [x, color]
    grouped = _keyed(df, keys, null_label).groupBy(*[_q(key) for key in keys])
    if agg == "count":
        result = grouped.count()
    else:
        if y is None:
            raise ValueError(f"{agg} needs a y column")
        if agg in ("sum", "mean") and not _is_numeric(df, y):
            raise ValueError(f"{agg} needs a numeric y column, {y!r} is not")
        reducers = {
            "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
            "mean": F.avg,
            "min": F.min,
            "max": F.max,
        }
        result = grouped.agg(reducers[agg](_q(y)).alias("value"))
    return result.orderBy(*[_q(key) for key in keys])


def value_counts(df: DataFrame, x: str, null_label: NullLabel = None) -> DataFrame:
    """Rows per value of ``x``, most frequent first, ties by value."""
    return (
        _keyed(df, [x], null_label).groupBy(_q(x)).count().orderBy(F.desc("count"), _q(x))
    )


def _beside_total(rolled: DataFrame, *totals: str) -> DataFrame:
    """Rows of a rollup by one key, each with the given columns of the row for all, prefixed with ``all_``.

    ``rolled`` has ``_all``, 1 in that row alone, which stays. It is repeated for each of ``SALTS`` parts that the others
    are dealt to, so that it meets them without a second look at the input.
    """
    is_all = F.col("_all") == 1
    parts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    own = F.array(F.pmod(F.xxhash64(*[_q(c) for c in rolled.columns]), F.lit(SALTS)).cast("int"))
    dealt = rolled.withColumn(SALT, F.explode(F.when(is_all, parts).otherwise(own)))
    part = Window.partitionBy(SALT)
    beside = {f"all_{name}": F.max(F.when(is_all, _q(name))).over(part) for name in totals}
    return dealt.withColumns(beside).where(~is_all | (F.col(SALT) == 0)).drop(SALT)


def value_shares(df: DataFrame, x: str, null_label: NullLabel = None) -> DataFrame:
    """Value counts with each value's share of all counted rows; counts and total come from one rollup."""
    counts = (
        _keyed(df, [x], null_label).rollup(_q(x)).agg(F.count(F.lit(1)).alias("count"), F.grouping(_q(x)).alias("_all"))
    )
    shared = _beside_total(counts, "count").where("_all = 0")
    share = F.col("count") / F.col("all_count")
    return shared.select(_q(x), "count", share.alias("share")).orderBy(F.desc("count"), _q(x))


def series_values(df: DataFrame, color: str, null_label: NullLabel = None) -> DataFrame:
    """Distinct values of the colour column, one series each."""
    return _keyed(df, [color], null_label).select(_q(color)).distinct().orderBy(_q(color))


def histogram(
    df: DataFrame, x: str, bins: int = HISTOGRAM_BINS, null_label: NullLabel = None
) -> DataFrame:
    """Rows per bin of a numeric column, in ``bins`` equal widths from least to greatest.

    Bins run from 1; each one is closed below and the last one also above.
    Every bin has a row, empty ones with count 0. Missing and infinite numbers
    are in no bin. A column that is not numeric gives :func:`value_counts`.
    One rollup gives the counts of distinct values and the range of all, so the table is read once.
    """
    if not _is_numeric(df, x):
        return value_counts(df, x, null_label)
    values = df.select(_finite(_q(x)).alias("v")).where(F.col("v").isNotNull())
    value = F.col("v")
    rolled = (
        values.select("v", value.alias("w"))
        .rollup("v")
        .agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.grouping("v").alias("_all"))
    )
    ranged = _beside_total(rolled, "lo", "hi")
    lo, spread = F.col("all_lo"), F.col("all_hi") - F.col("all_lo")
    place = F.when(spread == 0, F.lit(1)).otherwise(
        F.least(F.floor((value - lo) * bins / F.nullif(spread, F.lit(0.0))) + 1, F.lit(bins))
    )
    # The row for all stands in every bin and counts for nothing, so that empty bins are there.
    every = F.sequence(F.lit(1), F.lit(bins))
    placed = ranged.withColumn("bin", F.explode(F.when(F.col("_all") == 1, every).otherwise(F.array(place.cast("int")))))
    lo, spread = F.max("all_lo"), F.max("all_hi") - F.max("all_lo")
    return (
        placed.groupBy("bin")
        .agg(
            (lo + spread * (F.first("bin") - 1) / bins).alias("bin_start"),
            (lo + spread * F.first("bin") / bins).alias("bin_end"),
            F.sum(F.when(F.col("_all") == 0, F.col("n")).otherwise(F.lit(0))).alias("count"),
        )
        .orderBy("bin")
    )


def box_summary(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    approximate: bool = False,
    null_label: NullLabel = None,
) -> DataFrame:
    """Box-plot numbers of ``y`` per ``x`` and optional ``color``.

    Output columns are the keys, ``n``, ``min``, ``q1``, ``median``, ``q3``,
    ``max``, ``lower_whisker`` and ``upper_whisker``, the last two being the
    outermost values within 1.5 interquartile ranges of the box. Quartiles are
    exact with linear interpolation, or taken from a sketch if ``approximate``.
    """
    if not _is_numeric(df, y):
        raise ValueError(f"a box summary needs a numeric y column, {y!r} is not")
    names = [x] if color is None or color == x else [x, color]
    keys = [f"_key{i}" for i in range(len(names))]
    keyed = _keyed(df, names, null_label).select(
        *[_q(name).alias(key) for name, key in zip(names, keys)],
        # Not a number is missing, as a null is.
        F.nanvl(_q(y).cast("double"), F.lit(None).cast("double")).alias("y"),
    )
    if approximate:
        quartiles = (
            keyed.where(F.col("y").isNotNull())
            .groupBy(*keys)
            .agg(F.percentile_approx("y", list(QUARTILES), SKETCH_ACCURACY).alias("q"))
            .select(*keys, *[F.col("q")[i].alias(f"q{i}") for i in range(3)])
        )
    else:
        quartiles = exact_quantiles(keyed, keys, "y", QUARTILES)
    weights = salted(value_weights(keyed, keys, "y")).alias("weights")
    quartiles = for_all_salts(quartiles).alias("quartiles")
    same_group = reduce(
        and_, [F.col(f"weights.{key}") == F.col(f"quartiles.{key}") for key in (*keys, SALT)]
    )
    reach = (F.col("q2") - F.col("q0")) * WHISKER_REACH
    value = F.col("y")
    return (
        weights.join(quartiles, same_group)
        .groupBy(*[F.col(f"weights.{key}").alias(key) for key in keys])
        .agg(
            F.sum("n").alias("n"),
            F.min(value).alias("min"),
            F.max("q0").alias("q1"),
            F.max("q1").alias("median"),
            F.max("q2").alias("q3"),
            F.max(value).alias("max"),
            F.min(F.when(value >= F.col("q0") - reach, value)).alias("lower_whisker"),
            F.max(F.when(value <= F.col("q2") + reach, value)).alias("upper_whisker"),
        )
        .orderBy(*keys)
        .withColumnsRenamed(dict(zip(keys, names)))
    )


def scatter_points(
    df: DataFrame, x: str, y: str, color: str | None = None, null_label: NullLabel = None
) -> DataFrame:
    """The points of a scatter chart, one per row of the table.

    Rows with nulls stay; in a column with a label its nulls become that text.
    """
    labels = {x: null_label} if isinstance(null_label, str) else dict(null_label or {})
    for name, label in labels.items():
        df = df.withColumn(name, F.coalesce(_q(name).cast("string"), F.lit(label)))
    return df.select(*[_q(name) for name in dict.fromkeys([x, y, color]) if name is not None])


def chart_data(
    df: DataFrame,
    kind: str,
    x: str,
    y: str | None = None,
    agg: str = "count",
    color: str | None = None,
    null_label: NullLabel = None,
) -> DataFrame:
    """The reduction that belongs to a chart kind.

    Bars and lines aggregate, or count if there is no ``y``; pies give shares,
    histograms bins, boxes quartiles and scatter charts plain points. Pies and
    histograms ignore ``y`` and ``color``.
    """
    if kind not in CHART_KINDS:
        raise ValueError(f"unknown chart kind {kind!r}, expected one of {CHART_KINDS}")
    if kind in ("bar", "line"):
        if y is not None and agg != "count":
            return chart_agg(df, x, y, agg, color, null_label)
        if color is not None:
            return chart_agg(df, x, None, "count", color, null_label)
        return value_counts(df, x, null_label)
    if kind == "pie":
        return value_shares(df, x, null_label)
    if kind == "histogram":
        return histogram(df, x, null_label=null_label)
    if y is None:
        raise ValueError(f"a {kind} chart needs a y column")
    if kind == "scatter":
        return scatter_points(df, x, y, color, null_label)
    return box_summary(df, x, y, color, null_label=null_label)


def _page_order(df: DataFrame, sort: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """The given sort columns and, after them, all others that can be ordered."""
    named = {name for name, _ in sort}
    others = [f.name for f in df.schema.fields if f.name not in named and not isinstance(f.dataType, MapType)]
    return [*sort, *((name, "asc") for name in others)]


def _sorted(df: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    by = {"asc": F.asc_nulls_last, "desc": F.desc_nulls_last}
    return df.orderBy(*[by[direction](_q(name)) for name, direction in order])


def table_page(
    df: DataFrame,
    filter: Column | str | None = None,
    sort: Sequence[tuple[str, str]] = (),
    page: int = 0,
    size: int = 10,
) -> DataFrame:
    """One page of a table after an optional filter and multi-column sort.

    ``sort`` lists columns with ``asc`` or ``desc``; nulls come last. All other
    columns that can be ordered follow, so a page is the same in every run. Every row up to the page's
    end has to be ordered; :func:`page_after` reaches far pages of a long table.
    """
    rows = df if filter is None else df.where(filter)
    return _sorted(rows, _page_order(rows, sort)).offset(page * size).limit(size)


def page_after(
    df: DataFrame,
    last: Row | Mapping | None,
    filter: Column | str | None = None,
    sort: Sequence[tuple[str, str]] = (),
    size: int = 10,
) -> DataFrame:
    """The page that begins after ``last``, the last row seen, in the order of :func:`table_page`.

    ``last`` has a value for each column that can be ordered, and None asks for the first page. Each page costs as the
    first one: rows up to ``last`` are filtered out, and a filter on the leading sort column reaches the
    scan. Rows equal to ``last`` in all columns count as seen.
    """
    rows = df if filter is None else df.where(filter)
    order = _page_order(rows, sort)
    if last is not None:
        seen = last.asDict() if isinstance(last, Row) else dict(last)
        types = {f.name: f.dataType for f in rows.schema.fields}
        known = {name: F.lit(seen[name]).cast(types[name]) for name, _ in order}
        # From the last column on: later in this one, or equal in it and later in those after it.
        later = F.lit(False)
        for name, direction in reversed(order):
            column = _q(name)
            if seen[name] is None:
                later = column.isNull() & later
                continue
            beyond = (column > known[name]) if direction == "asc" else (column < known[name])
            later = beyond | column.isNull() | ((column == known[name]) & later)
        rows = rows.where(F.coalesce(later, F.lit(False)))
        # Implied by it, and simple enough for a scan.
        name, direction = order[0]
        if seen[name] is not None:
            bound = (_q(name) >= known[name]) if direction == "asc" else (_q(name) <= known[name])
            rows = rows.where(bound | _q(name).isNull())
    return _sorted(rows, order).limit(size)
