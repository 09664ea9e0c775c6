"""Line dedup: repeated windows of three consecutive lines lose their later occurrences.

Every window of `width` lines is hashed to 128 bits; over the whole corpus the first
occurrence of each window is its least (doc_id, text hash, place).  All other occurrences are later
ones.  The lines that later occurrences of a document cover are merged into one set of
positions, and those lines go.  Counting is pre-aggregated before its shuffle, and no
list of a window's occurrences is ever gathered.

Defined results: lines end at \\n; null and empty texts have no lines; a text with fewer
lines than a window keeps them all; windows are judged on the input; where a window
overlaps a later occurrence of itself, the lines of that occurrence go, the overlap
included; null doc_ids come last; rows with equal doc_id and text are one document and
get one result.  Only doc_id and text are read.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lines)"""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    return docs.select("doc_id", F.unhex(F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.md5("text")))).alias("key"), lines.alias("lines"))


def later_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(key, at): places of the windows of keyed docs that occur earlier in the corpus."""
    n = F.size("lines")
    hashes = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, width), "\n"))))
    rows = docs.where(n >= width).select("doc_id", "key", F.posexplode(hashes).alias("at", "digest"))
    rows = stored(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "at")).select("digest", "place"), "windows")
    first = rows.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    return rows.join(stored(first, "first"), "digest").where("place > first").select("place.key", "place.at").distinct()


def remove_later(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_removed, kept (the lines left, joined by \\n)."""
    docs = _keyed(docs)
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at") + 1, F.col("at") + width))))
    gone = later_windows(docs, width).groupBy("key").agg(covered.alias("gone"))
    out = docs.join(gone, "key", "left")
    n = F.size("lines")
    left = F.when(n == 0, F.array().cast("array<int>")).when(F.col("gone").isNull(), F.sequence(F.lit(1), n)).otherwise(F.array_except(F.sequence(F.lit(1), n), "gone"))
    out = out.withColumn("left", left)
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i - 1)), "\n"))
    return out.select("doc_id", n.cast("bigint").alias("n_lines"), (n - F.size("left")).cast("bigint").alias("n_removed"), kept.alias("kept"))
