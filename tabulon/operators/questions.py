"""Analytical questions over a star schema: aggregates, top-n, ranks and period comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAINS = ("year", "quarter", "month", "week", "day", "hour")


def grain_of(ts: Column, grain: str) -> Column:
    """Start of the period; weeks start on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    return F.date_trunc(grain, ts)


def in_period(ts: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """start <= ts < end on the bare column, so that it reaches the scan; an absent bound does not restrict."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= start)
    if end is not None:
        out = out & (ts < end)
    return out


def full_period(start: Column, end: Column, grain: str) -> tuple[Column, Column]:
    """Whole natural periods around [start, end]: an inclusive end is widened to the next period's start."""
    step = {"year": F.make_interval(years=F.lit(1)), "quarter": F.make_interval(months=F.lit(3)), "month": F.make_interval(months=F.lit(1)), "week": F.make_interval(weeks=F.lit(1)), "day": F.make_interval(days=F.lit(1)), "hour": F.make_interval(hours=F.lit(1))}[grain]
    return grain_of(start, grain), grain_of(end, grain) + step


def plain_agg(df: DataFrame, dims: Sequence[str | Column], **metrics: Column) -> DataFrame:
    """Metrics by dimensions."""
    return df.groupBy(*dims).agg(*[m.alias(name) for name, m in metrics.items()])


def top_n(df: DataFrame, metric: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n greatest rows by metric; ties go by the given columns, so that the result is total."""
    return df.orderBy(F.desc(metric), *ties).limit(n)


def rank_by(df: DataFrame, metric: str, partition: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """df with rank by metric, descending, within the partition."""
    f = F.dense_rank() if dense else F.rank()
    return df.withColumn("rank", f.over(Window.partitionBy(*partition).orderBy(F.desc(metric))))


def compare_periods(df: DataFrame, period: str, metric: str, months: int, dims: Sequence[str] = ()) -> DataFrame:
    """df (one row a period and dims) with previous and growth against `months` earlier.

    A self-join on the shifted period, not a lag: a missing period gives null, not the one before it.
    """
    earlier = df.select(*dims, F.add_months(period, months).cast(df.schema[period].dataType).alias(period), F.col(metric).alias("previous"))
    out = df.join(earlier, [*dims, period], "left")
    return out.withColumn("growth", (F.col(metric) - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0).cast(df.schema[metric].dataType)))


def year_over_year(df: DataFrame, period: str, metric: str, dims: Sequence[str] = ()) -> DataFrame:
    return compare_periods(df, period, metric, 12, dims)


def month_over_month(df: DataFrame, period: str, metric: str, dims: Sequence[str] = ()) -> DataFrame:
    return compare_periods(df, period, metric, 1, dims)


def growth_between(df: DataFrame, dims: Sequence[str], value: Column, first: Column, second: Column) -> DataFrame:
    """Sums of value over two conditions in one pass: dims, base, current, growth ((current - base) / base)."""
    out = df.groupBy(*dims).agg(F.sum(F.when(first, value)).alias("base"), F.sum(F.when(second, value)).alias("current"))
    base = F.col("base").cast("double")
    return out.withColumn("growth", (F.col("current").cast("double") - base) / F.when(base != 0, base))


def dependent(step: DataFrame, earlier: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of a step whose key an earlier step returned: one lazy plan, nothing comes to the driver."""
    return step.join(earlier.select(*key).distinct(), list(key), "left_semi")


def _pieces(s: Column, size: int) -> Column:
    """All substrings of `size` characters; none of shorter texts."""
    last = F.length(s) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(s, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def matching(df: DataFrame, filters: DataFrame, column: str) -> DataFrame:
    """Rows whose column equals a filter's value (score 0.8 and over) or contains it (below).

    Contained values are found by their first three characters among those of the column's
    distinct values, and then verified, so that no product of values and filters arises.
    """
    exact = filters.where("score >= 0.8").select(F.col("value").alias(column))
    parts = filters.where("score < 0.8").select(F.col("value").alias("_part")).distinct().withColumn("_g", F.left("_part", F.lit(3)))
    value = F.col(column)
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(value, n) for n in (1, 2, 3)]))
    values = df.select(column).where(value.isNotNull()).distinct().withColumn("_g", F.explode(grams))
    held = values.join(parts, "_g").where(value.contains(F.col("_part"))).select(column)
    return df.join(exact.union(held).distinct(), column, "left_semi")
