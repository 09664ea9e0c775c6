"""Document fingerprints by winnowing, and their likeness to an edited text and a neighbour.

Units are words; a longer word than `width` code points is cut into pieces of that width from its
start, so that texts without blanks have units too (width 1 gives grams of characters).
Units are hashed, every run of `k` units gives a gram hash, and of each window of `w`
consecutive grams the least hash is selected, the rightmost of equal ones.  Hash and place
are packed in one long (32 bits of hash, then 2^31 - 1 - place), so that a plain minimum
breaks ties to the right; places are kept.  Two texts that share k + w - 1 consecutive
units share a selected gram.  The gram hash is the value of its words alone, computed from
their k hashes, so moving on by a word costs the same wherever the window stands.

Everything is DataFrame functions; arrays that are used more than once are bound by a
lambda, so that no projection repeats their computation for each element.

Defined results: null texts count as empty; no words give an empty fingerprint, fewer than
k words one gram of them all, fewer than w grams one window; two empty fingerprints are
alike 1.0, an empty and another one 0.0.  Rows with equal doc_id and text count as one
document in the order and all get its result; a null doc_id comes last; a lone document
follows itself.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K, W, WIDTH = 3, 6, 16
_HASH_BITS, _PLACE_BITS = 32, 31
_PLACES = (1 << _PLACE_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, k: int = K, w: int = W, width: int = WIDTH) -> Column:
    """The selected grams of a text, ascending by place: longs of the hash bits and the packed place."""
    words = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{width}}}"), F.lit(0))

    def pack(h: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH_BITS), _PLACE_BITS).bitwiseOR(F.lit(_PLACES) - i)

    def grams(h: Column) -> Column:
        n = F.size(h)
        every = F.transform(F.sequence(F.lit(0), n - k), lambda i: pack(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i.cast("bigint")))
        return F.when(n >= k, every).when(n > 0, F.array(pack(F.xxhash64(h), F.lit(0).cast("bigint")))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def minima(g: Column) -> Column:
        n = F.size(g)
        every = F.transform(F.sequence(F.lit(0), n - w), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))
        return F.when(n > w, F.array_distinct(every)).when(n > 0, F.array(F.array_min(g))).otherwise(g)

    return _let(_let(F.transform(words, lambda x: F.xxhash64(x)), grams), minima)


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda v: F.shiftrightunsigned(v, _PLACE_BITS)))


def printed(selected: Column) -> Column:
    """hash:place in hexadecimal and decimal, comma-joined."""
    return F.array_join(F.transform(selected, lambda v: F.concat_ws(":", F.hex(F.shiftrightunsigned(v, _PLACE_BITS)), F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, 1.0).otherwise(both / total)


def neighbours(docs: DataFrame) -> DataFrame:
    """(key, copies, before, before_n): the document that each key follows by descending doc_id, in a ring, and its length.

    Only ids, hashes and lengths move: range partitions are numbered, and one row a
    partition gives the offsets.
    """
    keys = docs.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    order = (F.desc_nulls_last("doc_id"), F.asc("key"))
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("c").over(every), F.lit(0)).alias("offset"), F.sum("c").over(Window.partitionBy()).alias("total"))
    placed = ranged.withColumn("part", part).join(offsets, "part").withColumn("i", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = placed.select(F.pmod(F.col("i") + 1, F.col("total")).alias("i"), F.col("key").alias("before"), F.col("n").alias("before_n"))
    return stored(placed.join(before, "i").select("key", "copies", "before", "before_n"), "neighbours")


def fingerprints(docs: DataFrame, k: int = K, w: int = W, width: int = WIDTH) -> DataFrame:
    """doc_id, next_id, text, edited, selected and edited_selected (packed longs), near_edited, near_next of every document.

    edited: the last third (rounded down) of the text gives way to the first as many
    code points of the next document.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text"))))
    ring = neighbours(docs)
    # Both sides of the last join read docs with the same columns, so that Spark shuffles the texts once for both.
    heads = docs.join(ring, "key").select(
        F.col("before").alias("key"), F.col("doc_id").alias("next_id"), F.expr("left(text, cast(before_n div 3 as int))").alias("head"), hashes(fingerprint(F.col("text"), k, w, width)).alias("next")
    )
    if not ring.where("copies > 1").isEmpty():
        heads = heads.dropDuplicates(["key"])  # repeated rows have equal heads
    out = docs.join(heads, "key")
    third = "cast(length(text) div 3 as int)"
    edited = F.concat(F.expr(f"left(text, length(text) - {third})"), F.expr(f"left(head, {third})"))
    out = out.select("doc_id", "next_id", "text", "next", edited.alias("edited"))
    out = out.withColumn("selected", fingerprint(F.col("text"), k, w, width)).withColumn("edited_selected", fingerprint(F.col("edited"), k, w, width))
    own = hashes(F.col("selected"))
    return out.withColumn("near_edited", likeness(own, hashes(F.col("edited_selected")))).withColumn("near_next", likeness(own, F.col("next"))).drop("next")
