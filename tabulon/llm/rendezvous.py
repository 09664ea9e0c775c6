"""Weighted rendezvous sharding: every key goes to the shard that draws best for it.

A shard's draw for a key is -ln(u) / weight, u from the md5 of key and shard number; the
least draw takes the key.  A draw depends on nothing but key, number and weight, so a
shard takes keys in proportion to its weight, a further shard takes rows only into
itself, and a removed one gives up its own alone: as few rows move as can.

Within a shard rows stand in order of their key's hash, so that slots do not depend on
how the table is split: sums over BINS ranges of the hash give each range its first slot
and the ranges are numbered side by side, however few the shards.  A range of over
HOT rows (a key with a large part of all rows) is dealt over SUBS parts by input task,
each numbered alone; within it the order is that of the tasks.

Defined results: a row without a key has a key of its own, the same for all such rows;
a null text has size 16 and the crc32 of an empty one; rows with the same key are in the same
shard, repeated rows at slots of their own; an empty table gives an empty
result.  Columns of docs are carried in a struct, so none clashes.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BINS = 1024
#: Rows of one range of the hash that one task numbers; a larger one is dealt over SUBS parts.
HOT, SUBS = 1 << 21, 1024


def key_text(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("n"))


def _hash(text: Column) -> Column:
    """52 bits of the md5 of a text: a double holds them."""
    return F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 13), 16, 10).cast("bigint")


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    return -F.log((_hash(F.concat_ws(":", key, shard.cast("string"))) + F.lit(0.5)) / F.lit(2.0**52)) / weight


def _placed(key: Column, weights: Sequence[float], grown: float) -> tuple[Column, Column]:
    """The key's shard among those of `weights`, and with one more of weight `grown`."""
    if not weights or min(*weights, grown) <= 0:
        raise ValueError("every shard needs a weight above 0")
    drawn = F.array(*[F.struct(_draw(key, F.lit(i), F.lit(float(w))).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])
    best = F.array_min(drawn)
    return best["shard"], F.when(_draw(key, F.lit(len(weights)), F.lit(float(grown))) < best["draw"], F.lit(len(weights))).otherwise(best["shard"])


def shard_rows(docs: DataFrame, shards: int | Sequence[float] = 40, key: str = "doc_id", grown: float = 1.0, keep: Sequence[str] | None = None) -> DataFrame:
    """(row, size, text_crc32, shard, slot, grown_shard) of every row of docs (key, text); row: struct of the columns to keep, all by default.

    shards is a number or a list of weights; grown_shard is the row's shard with one more of weight `grown`.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    keyed = docs.select(
        F.struct(*(docs[c] for c in keep or docs.columns)).alias("row"), (F.octet_length(raw) + F.lit(16)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        key_text(key).alias("key"), F.monotonically_increasing_id().alias("at"),
    )
    shard, more = _placed(F.col("key"), weights, grown)
    keyed = stored(keyed.withColumn("hash", _hash(F.col("key"))).withColumn("bin", F.shiftright("hash", 52 - BINS.bit_length() + 1).cast("int")).withColumn("shard", shard).withColumn("grown_shard", more), "keyed")

    # Counts by range: a shard has BINS of them at most, so these tables stay small whatever the corpus.
    hot = stored(keyed.groupBy("shard", "bin").count().where(F.col("count") > HOT).select("shard", "bin", F.lit(True).alias("hot")), "hot")
    sub = F.when(F.col("hot"), F.pmod(F.shiftrightunsigned("at", 33), F.lit(SUBS)) + 1).otherwise(F.lit(0)).cast("int")
    dealt = keyed.join(hot, ["shard", "bin"], "left").withColumn("sub", sub).drop("hot")
    sums = dealt.groupBy("shard", "bin", "sub").count()
    first = F.sum("count").over(Window.partitionBy("shard").orderBy("bin", "sub")) - F.col("count")
    sums = stored(sums.select("shard", "bin", "sub", first.alias("first")), "ranges")
    in_range = Window.partitionBy("shard", "bin", "sub").orderBy("hash", "key", "text_crc32", "size", "at")
    out = dealt.withColumn("place", F.row_number().over(in_range)).join(sums, ["shard", "bin", "sub"])
    return out.select("row", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, folder: str, shards: int | Sequence[float] = 40, key: str = "doc_id", files: int = 200) -> None:
    """Writes `folder`/shard=N/: Parquet files of (slot, row) that follow each other in order of the slots.

    Ranges of (shard, slot) are dealt over about `files` tasks, so a large shard is written by many.
    """
    rows = shard_rows(docs, shards, key).select("shard", "slot", "row").repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(folder)
