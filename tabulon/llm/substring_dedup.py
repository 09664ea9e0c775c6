"""Removal of repeated passages: exact windows of words, counted in super-k-mer buckets.

A window is `width` consecutive words of one document.  Its minimiser is the least hash
among its runs of `gram` words.  Equal windows have equal minimisers, so:

1. Every document is cut into maximal runs of consecutive windows that share one
   occurrence of a minimiser (super-k-mers); only (minimiser, document, place) is kept of them at first.
2. Minimisers that occur once cannot hold a repeated window and are dropped.
3. The rest of the super-k-mers travel as packed strings (their words, space-joined) to
   the bucket of their minimiser, where the windows are sorted by their exact words and
   counted.  A minimiser with very many super-k-mers is dealt over several buckets;
   the windows of those are counted again across buckets by a 128-bit digest.
4. Covered words are the union of the repeated windows of a document.

Defined results: a null text has no words; a text shorter than a window keeps all its
words; every occurrence of a repeated window goes, also the first, and also within one
document; rows are matched by doc_id and text, so repeated rows repeat each other's
windows, each on its own row.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Super-k-mers that one bucket should hold.
BUCKET = 6_000
#: Super-k-mers of one minimiser over which it is dealt to several buckets.
HOT = 2_000


def _runs(words, width: int, gram: int):
    """(document, first window, windows, minimiser) of the super-k-mers of a slice."""
    g = words.grams(gram)
    span = width - gram + 1
    if len(g) < span:
        return None
    # The place of the minimiser, the first of equal ones: equal windows that overlap then lie in different super-k-mers.
    place = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1)
    place += np.arange(len(place))
    doc = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
    n = len(place)
    same_doc = doc[:n] == doc[width - 1 : width - 1 + n]
    at = np.flatnonzero(same_doc)
    if not len(at):
        return None
    d, m = doc[at], place[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    return d[first], at[first] - words.of[d[first]], length, g[m[first]]


def super_kmers(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, first, windows, mini) of every super-k-mer of docs (key, text)."""

    def each(batches):
        for batch in batches:
            for a, b, words in slices(batch.column(1)):
                if (found := _runs(words, width, gram)) is None:
                    continue
                doc, first, windows, mini = found
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + a)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(mini.view(np.int64))],
                    ["key", "first", "windows", "mini"],
                )

    return docs.select("key", "text").mapInArrow(each, "key binary, first int, windows int, mini bigint")


def _packed(docs: DataFrame, width: int) -> DataFrame:
    """(key, first, bucket, hot, packed) from docs (key, text, runs: [(first, windows, bucket, hot)])."""

    def each(batches):
        for batch in batches:
            rows = {"key": [], "first": [], "bucket": [], "hot": [], "packed": []}
            held = 0
            for key, text, runs in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                for run in runs.as_py():
                    rows["key"].append(key.as_py())
                    rows["first"].append(run["first"])
                    rows["bucket"].append(run["bucket"])
                    rows["hot"].append(run["hot"])
                    rows["packed"].append(packed := b" ".join(words[run["first"] : run["first"] + run["windows"] + width - 1]))
                    held += len(packed)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows, held = {k: [] for k in rows}, 0
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("key", pa.binary()), ("first", pa.int32()), ("bucket", pa.int64()), ("hot", pa.bool_()), ("packed", pa.binary())])
    return docs.select("key", "text", "runs").mapInArrow(each, "key binary, first int, bucket bigint, hot boolean, packed binary")


def _counted(packed: DataFrame, width: int) -> DataFrame:
    """In each bucket: (key, at, last), runs of windows met twice there.

    A hot bucket also gives (key, at, last, digest) of every window met once, and (digest) alone for one met twice.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        table, text = [], []
        for row, (p, first) in enumerate(zip(pdf["packed"], pdf["first"], strict=True)):
            words = p.split()
            ends = np.cumsum([len(w) + 1 for w in words])
            text.append(p)
            for i in range(len(words) - width + 1):
                lo = int(ends[i - 1]) if i else 0
                table.append((p[lo : int(ends[i + width - 1]) - 1], row, first + i))
        table.sort(key=lambda x: x[0])
        n = len(table)
        row, at = (np.fromiter((x[i] for x in table), dtype=np.int64, count=n) for i in (1, 2))
        same = np.zeros(n + 1, dtype=bool)
        same[1:n] = [x[0] == y[0] for x, y in zip(table[1:], table, strict=False)]
        twice, keys, hot = same[:-1] | same[1:], pdf["key"].to_numpy(), pdf["hot"].to_numpy(dtype=bool)
        order = np.lexsort((at[twice], row[twice]))
        r, a = row[twice][order], at[twice][order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(r)) - 1
        runs = pd.DataFrame({"key": keys[r[first]], "at": pd.array(a[first], dtype="Int32"), "last": pd.array(a[last] if len(r) else a, dtype="Int32"), "digest": None})
        once = np.flatnonzero(hot[row] & ~same[:-1])
        if not len(once):
            return runs
        alone = ~twice[once]
        digests = [hashlib.blake2b(table[i][0], digest_size=16).digest() for i in once]
        place = pd.array(np.where(alone, at[once], 0), dtype="Int32")
        place[~alone] = pd.NA
        return pd.concat([runs, pd.DataFrame({"key": np.where(alone, keys[row[once]], None), "at": place, "last": place, "digest": digests})])

    return packed.groupBy("bucket").applyInPandas(each, "key binary, at int, last int, digest binary")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key: doc_id and text in 16 bytes.  Equal rows share a key, which is right: they share their windows."""
    digest = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x1e")), F.coalesce("text", F.lit(""))))
    return docs.withColumn("key", F.unhex(digest))


def repeated_windows(docs: DataFrame, width: int = 35, gram: int = 8) -> DataFrame:
    """(key, at): runs (first, last) of the first words of repeated windows, ascending, for the keyed docs that have any."""
    spark = docs.sparkSession
    rows = docs.select("key", "text")
    runs = stored(super_kmers(rows, width, gram), "runs")
    # A repeated row repeats its super-k-mers too, so rows and not keys are counted.
    often = runs.groupBy("mini").agg(F.count("*").alias("m")).where("m > 1")
    often = stored(often, "minimisers")
    total = often.agg(F.sum("m")).first()[0] or 0
    buckets = max(1, int(total) // BUCKET, spark.sparkContext.defaultParallelism)
    parts = F.ceil(F.col("m") / F.lit(HOT))
    salt = F.pmod(F.xxhash64("key", "first"), parts)
    dealt = runs.distinct().join(often, "mini").withColumn("hot", F.col("m") > HOT)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("mini", F.when(F.col("hot"), salt).otherwise(F.lit(0))), F.lit(buckets)))
    per_doc = dealt.groupBy("key").agg(F.collect_list(F.struct("first", "windows", "bucket", "hot")).alias("runs"))
    per_doc = stored(per_doc, "spans")
    packed = _packed(rows.join(per_doc, "key"), width)
    met = stored(_counted(packed, width), "met")
    across = met.where("digest is not null").groupBy("digest").agg(F.count("*").alias("c")).where("c > 1")
    found = met.where("digest is null").union(met.where("key is not null and digest is not null").join(across, "digest", "left_semi").select(*met.columns))
    return found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("first"), "last"))).alias("at"))


def remove_repeats(docs: DataFrame, width: int = 35, gram: int = 8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    docs = keyed(docs.select("doc_id", F.col("text").cast("string")))
    found = repeated_windows(docs, width, gram)

    def each(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                if at.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(edge, at.values.field("first").to_numpy(), 1)
                    np.add.at(edge, at.values.field("last").to_numpy() + width, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    removed.append(int(covered.sum()))
                    words = [words[i] for i in np.flatnonzero(~covered)]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(found, "key", "left").select("doc_id", "text", "at")
    return joined.mapInArrow(each, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
