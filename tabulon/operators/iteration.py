"""Cutting the lineage of iterative operators with tables in the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a written table up to which Spark may send it through the driver for a join.
SENT = 1 << 16

_local: list[str] = []
_made: dict[str, list[str]] = {}
_inside: dict[str, tuple[int, str]] = {}
_lock = threading.Lock()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under spark.checkpoint.dir; under a temporary one only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-"))
        root = _local[0]
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark._jsparkSession.sessionUUID(), []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes the scratch tables that this session has made so far; results that still read them must be written before."""
    for path in _made.pop(spark._jsparkSession.sessionUUID(), []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the statement that made them.  The setting is the session's: the first of several threads sets it, the last one restores it."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _inside.get(session, (0, spark.conf.get(_CLEAN)))
        _inside[session] = (n + 1, before)
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _inside.pop(session)
            if n > 1:
                _inside[session] = (n - 1, before)
            else:
                spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to the shared scratch folder, in folders by the given columns, and read back: the lineage ends there, and its shuffle files go."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with _cleaning(spark):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """df as a side of a join that Spark may broadcast only up to `most` rows (SENT); rows: their number or a bound of it, counted if not given.

    Spark takes a written table for as large as its compressed files.  Its rows can be fifty times that in the driver, which builds what is broadcast.
    """
    most = SENT if most is None else most
    return df.hint("merge") if (df.count() if rows is None else rows) > most else df
