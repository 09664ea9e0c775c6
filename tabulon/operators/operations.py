"""Operational audits of checkpoint and log tables, and metrics of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of errors that a retry cannot mend.
FINAL_MARKERS = (" 400", "status_code=400", "bad request", "invalid request", "invalidrequest", " 401", "status_code=401", "authentication", "unauthorized")


def completeness(df: DataFrame, column: str) -> DataFrame:
    """(total, present, missing, blank) of a text column."""
    c = F.col(column)
    return df.agg(F.count("*").alias("total"), F.count(c).alias("present"), (F.count("*") - F.count(c)).alias("missing"), F.count_if(c == "").alias("blank"))


def top_groups(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """Rows a group, the largest first, then by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *keys).limit(n)


def latest(df: DataFrame, condition: Column, by: Sequence[str], n: int = 10) -> DataFrame:
    return df.where(condition).orderBy(*[F.desc(c) for c in by]).limit(n)


def stage_durations(lines: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(query_id, <stage>_at, <stage>_s ...) of log lines '<timestamp> - ... [query] stage': first times and seconds from the stage before."""
    at = F.to_timestamp(F.regexp_extract("value", r"^([\d-]+ [\d:.]+) - ", 1))
    parsed = lines.select(at.alias("at"), F.regexp_extract("value", r"\[([^\]]+)\]", 1).alias("query_id"), F.regexp_extract("value", r"\] (\w+)", 1).alias("stage"))
    firsts = parsed.where("query_id <> ''").groupBy("query_id").agg(*[F.min(F.when(F.col("stage") == s, F.col("at"))).alias(f"{s}_at") for s in stages])
    micros = lambda c: F.unix_micros(F.col(c))
    return firsts.select("*", *[((micros(f"{b}_at") - micros(f"{a}_at")) / 1e6).alias(f"{b}_s") for a, b in zip(stages, stages[1:], strict=False)])


def request_metrics(df: DataFrame, route: str, ok: Column, seconds: Column) -> DataFrame:
    """(route, requests, successes, failures, mean_s) by route; mean over all requests."""
    return df.groupBy(F.col(route).alias("route")).agg(F.count("*").alias("requests"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.avg(seconds).alias("mean_s"))


def fallbacks(df: DataFrame, reason: Column) -> DataFrame:
    return df.where(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def final_records(answers: DataFrame) -> DataFrame:
    """answers (query_id, sub_queries ARRAY<STRUCT<id, validated_sql, success, ms>>) -> sql (of a lone sub-query), counts and total time."""
    good = F.filter("sub_queries", lambda s: s["success"])
    total = F.aggregate("sub_queries", F.lit(0.0), lambda a, s: a + s["ms"])
    return answers.select("query_id", F.when(F.size("sub_queries") == 1, F.get("sub_queries", F.lit(0))["validated_sql"]).alias("sql"), F.size("sub_queries").alias("sub_queries"), F.size(good).alias("successes"), total.alias("total_ms"))


def template_summary(log: DataFrame) -> DataFrame:
    """(query_id, summary) by the rows that successful executions returned."""
    rows = log.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("success"), F.col("row_count"))), F.lit(0)).alias("n"))
    return rows.select("query_id", F.when(F.col("n") == 0, "no rows").when(F.col("n") == 1, "one row").otherwise(F.format_string("%d rows", "n")).alias("summary"))


def scenarios(log: DataFrame, ordinal: str) -> DataFrame:
    """(query_id, scenario, failed) from log (query_id, generated, success, error): what befell the question, and its errors in order."""
    s = log.groupBy("query_id").agg(
        F.bool_or(~F.col("generated")).alias("no_sql"), F.count_if(F.col("success").isNotNull()).alias("ran"), F.count_if("success").alias("good"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(ordinal, "error")))).alias("errors"),
    )
    what = F.when(F.col("no_sql"), "generation_error").when(F.col("ran") == 0, "no_result").when(F.col("good") == 0, "all_failed").otherwise("succeeded")
    return s.select("query_id", what.alias("scenario"), F.array_join(F.transform("errors", lambda e: e["error"]), "; ").alias("failed"))


def messages(errors: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """errors (error_type) with the known message (error_type, message) or the default."""
    return errors.join(known, "error_type", "left").withColumn("message", F.coalesce("message", F.lit(default)))


def retryable(message: Column) -> Column:
    m = F.lower(message)
    return ~F.exists(F.array(*[F.lit(x) for x in FINAL_MARKERS]), lambda x: F.contains(m, x))


def column_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, data_type) of some tables' schemas."""
    out = None
    for name, df in tables.items():
        rows = [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
        part = df.sparkSession.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string")
        out = part if out is None else out.unionByName(part)
    return out


def running_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w).cast("double") / F.count(value).over(w))
