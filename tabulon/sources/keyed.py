"""A keyed table of Parquet files: upserts rewrite only the partitions that they touch.

Layout: folder/<part>=<value>/version=<id>/*.parquet, and folder/_versions/<n>.json, which
names the version of every partition.  A run writes its partitions under a version of its own
and then puts the next list in place by one rename, which fails if another run was first.
Readers see what the newest list names, so a run that dies changes nothing and what it
leaves is swept by `vacuum`.  Lists hold one entry a partition; partitions are days or a fixed number of
hash buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.iteration import stored

#: The name that Spark gives the folder of null partition values.
_NULL = "__HIVE_DEFAULT_PARTITION__"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the lists that there are, in order."""
    fs, where = _fs(spark, f"{folder}/_versions")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(where) if f.getPath().getName()[:-5].isdigit()) if fs.exists(where) else []


def state(spark: SparkSession, folder: str) -> dict | None:
    """The newest list: number, part, schema, versions (partition value to version); None if there is no table."""
    found = versions(spark, folder)
    if not found:
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/_versions/{found[-1]:09}.json").collect()))


def _commit(spark: SparkSession, folder: str, number: int, part: str, schema: StructType, parts: dict[str, str]) -> None:
    fs, made = _fs(spark, f"{folder}/_versions/{uuid.uuid4().hex}.tmp")
    out = fs.create(made)
    out.write(bytearray(json.dumps({"number": number, "part": part, "schema": schema.json(), "versions": parts}), "utf-8"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    # A rename without the option to overwrite fails if this number exists.
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    hadoop.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration()).rename(made, _fs(spark, f"{folder}/_versions/{number:09}.json")[1], options)


def _read(spark: SparkSession, folder: str, now: dict, values: Sequence[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(now["schema"]))
    paths = [f"{folder}/{now['part']}={v}/version={x}" for v, x in now["versions"].items() if values is None or v in values]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths).select(*schema.names)


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table as the newest list has it, with its partition column; None if there is none."""
    now = state(spark, folder)
    return now and _read(spark, folder, now)


def _text(part: str) -> Column:
    return F.coalesce(F.col(part).cast("string"), F.lit(_NULL))


def _rewritten(rows: DataFrame, folder: str, part: str) -> dict[str, str]:
    """Writes rows as a new version of their partitions; {partition value: version}."""
    version = uuid.uuid4().hex
    rows.hint("rebalance", part).withColumn("version", F.lit(version)).write.mode("append").partitionBy(part, "version").parquet(folder)
    return version


def upsert(folder: str, rows: DataFrame, key: Sequence[str], part: str, order: Sequence[str] = ()) -> dict:
    """Writes rows, one of each key, over those of the table; the new list.

    Rows have the table's columns, `part` among them, which tells a row's partition and
    must be the same for all rows of a key.  Of several rows of a key, old or new, the one with
    the greatest `order` stays; of equal ones, or without `order`, the new one, of several new ones the greatest.
    """
    spark = rows.sparkSession
    now = state(spark, folder)
    schema = StructType.fromJson(json.loads(now["schema"])) if now else rows.schema
    names = schema.names
    rest = [c for c in names if c not in (*key, part)]
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("_new"), F.struct(*rest)) if rest or order else F.struct("_new")
    new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    packed = lambda df, flag: df.withColumn("_new", F.lit(flag)).select(*key, part, rank.alias("_r"))
    once = lambda df: df.groupBy(*key, part).agg(F.max("_r").alias("_r"))
    fresh = stored(once(packed(new, 1)), "upsert")
    touched = [r[0] for r in fresh.select(_text(part).alias("p")).distinct().collect()]
    old = packed(_read(spark, folder, now, touched), 0) if now and any(t in now["versions"] for t in touched) else None
    merged = once(fresh.unionByName(old)) if old is not None else fresh
    nth = len(order) + 2
    fields = merged.schema["_r"].dataType.names
    merged = merged.select(*[F.col(c) if c in (*key, part) else F.col(f"_r.{fields[nth - 1]}.{c}").alias(c) for c in names])
    version = _rewritten(merged, folder, part)
    parts = {**(now["versions"] if now else {}), **dict.fromkeys(touched, version)}
    number = now["number"] + 1 if now else 0
    _commit(spark, folder, number, part, merged.schema, parts)
    return {"number": number, "versions": parts}


def bucket(key: Sequence[str], buckets: int = 64) -> Column:
    """A row's hash bucket, for tables without a partition of their own."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def drop(spark: SparkSession, folder: str, whole: Sequence[str], edge: Sequence[str] = (), keep: Column | None = None) -> dict:
    """Takes the partitions `whole` out of the list, without reading them, and rewrites those of `edge` with the rows to keep."""
    now = state(spark, folder)
    parts = {v: x for v, x in now["versions"].items() if v not in whole}
    edge = [v for v in edge if v in parts]
    if edge:
        left = stored(_read(spark, folder, now, edge).where(keep), "edge")
        held = {r[0] for r in left.select(_text(now["part"]).alias("p")).distinct().collect()}
        version = _rewritten(left, folder, now["part"]) if held else None
        parts = {v: version if v in edge else x for v, x in parts.items() if v not in edge or v in held}
    if parts != now["versions"]:
        _commit(spark, folder, now["number"] + 1, now["part"], StructType.fromJson(json.loads(now["schema"])), parts)
    return {"versions": parts}


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Deletes what the newest list does not name: old versions, older lists, leavings of runs that died.  Not while others write or read old lists."""
    now = state(spark, folder)
    keep = {f"{now['part']}={v}/version={x}" for v, x in now["versions"].items()}
    fs, root = _fs(spark, folder)
    gone = []
    for part in fs.globStatus(_fs(spark, f"{folder}/{now['part']}=*/version=*")[1]) or []:
        name = "/".join(part.getPath().toString().split("/")[-2:])
        if name not in keep:
            fs.delete(part.getPath(), True)
            gone.append(name)
    for n in versions(spark, folder)[:-1]:
        fs.delete(_fs(spark, f"{folder}/_versions/{n:09}.json")[1], False)
    return sorted(gone)
