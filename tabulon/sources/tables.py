"""Sources and sinks: Parquet and JDBC tables, appends, upserts, descriptions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, partitions: int, properties: dict[str, str]) -> DataFrame:
    """A table of a database, read in parallel ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties=properties)


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text logs."""
    return spark.read.text(path)


def in_schema_order(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with the columns of `like`, in its order and types; absent ones are null, others are left out."""
    known = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def append(rows: DataFrame, like: DataFrame, path: str) -> None:
    in_schema_order(rows, like).write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new, one of each key (the greatest of several), and those of old whose key new does not have."""
    rows = in_schema_order(new, old)
    rest = [c for c in rows.columns if c not in key]
    if rest:
        rows = rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns])
    else:
        rows = rows.distinct()
    return rows.unionByName(old.join(new.select(*key), key, "left_anti").select(*old.columns))


def describe(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type, row_count) of a table: one aggregate, crossed with its schema's few rows."""
    fields = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")) for i, f in enumerate(df.schema.fields, 1)])
    return df.agg(F.count("*").alias("row_count")).select(F.explode(fields).alias("f"), "row_count").select("f.*", "row_count")


def same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_rows, after_rows, equal) of a table before and after a move."""
    both = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    out = both.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("before_rows"), F.coalesce(F.sum("a"), F.lit(0)).alias("after_rows"))
    return out.withColumn("equal", F.col("before_rows") == F.col("after_rows"))


def json_field(document: Column, path: str) -> Column:
    """One field of a JSON text; null if the text or the path is not there."""
    return F.get_json_object(document, path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def grid(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows, for display."""
    return df.limit(rows)
