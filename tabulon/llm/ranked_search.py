"""Ranked lexical search, reversed: the items are indexed and the documents stream through.

The items' distinct terms form an inverted index (term to items), which is broadcast in
blocks of at most POSTINGS entries: an item with more is a block of its own.  For each
block one pass over the documents keeps of each its length and its counts of indexed
terms; from that table come the document frequencies, and a second pass scores it.  A
task holds, for each item, its k best documents so far, and leaves only those; the tasks' lists
are merged in two steps, so that no task reads the lists of all.

Terms are maximal runs of ASCII letters and digits and of other characters than ASCII,
A-Z lower-cased; they are compared as 64-bit hashes.  With N documents that have a term,
L terms in all, df documents that hold a term, n terms in a document and tf of one of them, a
term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and adds
w * (10^9 tf div (1000 tf + 8 m)), m = 10 + 90 n N div L, in whole numbers.

Defined results: null and empty texts have no term, count for nothing and are never
found; an item without terms, or whose terms nothing holds, has no row.  Rows that repeat an item_id,
null too, are one item with the terms of all.  Each row of docs is a document: repeated
rows are ranked one after the other.  Equal scores stand by ascending doc_id, null last;
doc_id is an integer.  Empty tables give an empty result.  Only the named columns are read, so others never clash.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Bytes that end a term.
BREAKS = np.ones(256, dtype=bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: (term, item) entries of one block of the index.
POSTINGS = 1 << 21
#: Cells of (document, item) sums that a task holds at once, and entries that it adds to them at once.
CELLS = 1 << 20


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def each(batches):
        for batch in batches:
            for a, b, words in slices(batch.column(1), True, space=BREAKS):
                at = np.repeat(np.arange(a, b), np.diff(words.of))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(words.hash.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string")).mapInArrow(each, f"item_id {kind}, term bigint").distinct()


def _counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tf): a document's number of terms, and its counts of those of the sorted vocabulary (a broadcast)."""

    def each(batches):
        terms = vocabulary.value
        for batch in batches:
            for a, b, words in slices(batch.column(1), True, space=BREAKS):
                at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
                known = np.flatnonzero(terms[at] == words.hash)
                doc = np.searchsorted(words.of, known, side="right") - 1
                key, tf = np.unique(doc * len(terms) + at[known], return_counts=True)
                doc, ids = key // len(terms), key % len(terms)
                ends = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (ids, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(words.of).astype(np.int64)), *lists], ["doc_id", "n", "ids", "tf"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(each, "doc_id bigint, n bigint, ids array<int>, tf array<int>")


class Best:
    """The k best (score, doc) of each item so far; equal scores by ascending doc, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)
        self.wait, self.waiting = [], 0

    def add(self, item, score, doc, null):
        near = score >= self.least[item]
        self.wait.append((item[near], score[near], doc[near], null[near]))
        self.waiting += int(near.sum())
        if self.waiting > CELLS:
            self.settle()

    def settle(self):
        self.item, self.score, self.doc, self.null = (np.concatenate(x) for x in zip((self.item, self.score, self.doc, self.null), *self.wait, strict=True))
        self.wait, self.waiting = [], 0
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        self.item, self.score, self.doc, self.null = self.item[order], self.score[order], self.doc[order], self.null[order]
        full = place == self.k - 1
        self.least[item[full]] = self.score[np.searchsorted(self.item, item[full], side="right") - 1]


def lengths(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """10 + 90 n N div L, exact also where 90 n N is beyond 64 bits."""
    if len(n) and 90 * int(n.max()) * total >= 1 << 63:
        n = n.astype(object)
    return (10 + 90 * n * total // terms).astype(np.int64)


def _found(counts: DataFrame, index, ids: pa.Array, total: int, terms: int, k: int, schema: str) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents of each item; index: a broadcast (weight, first posting, items)."""

    def each(batches):
        weight, of, items = index.value
        best = Best(len(ids), k)
        for batch in batches:
            doc_id = batch.column(0)
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            doc_id = doc_id.fill_null(0).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            term, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            m = lengths(batch.column(1).to_numpy(), total, max(1, terms))[doc]
            part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            width = of[term + 1] - of[term]
            # Whole documents, as many as CELLS sums and entries allow; one with more is a part of its own.
            ends = np.cumsum(np.bincount(doc, width, batch.num_rows)).astype(np.int64)
            a = 0
            while a < batch.num_rows:
                done = ends[a - 1] if a else 0
                b = max(a + 1, min(a + max(1, CELLS // len(ids)), int(np.searchsorted(ends, done + CELLS, side="right"))))
                lo, hi = np.searchsorted(doc, (a, b))
                w, first = width[lo:hi], of[term[lo:hi]]
                place = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first, w)
                sums = np.zeros((b - a) * len(ids), dtype=np.int64)
                np.add.at(sums, (np.repeat(doc[lo:hi], w) - a) * len(ids) + items[place], np.repeat(part[lo:hi], w))
                at = np.flatnonzero(sums)
                row = at // len(ids) + a
                best.add(at % len(ids), sums[at], doc_id[row], null[row])
                a = b
        best.settle()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.item)), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return counts.where("size(ids) > 0").select("doc_id", "n", "ids", "tf").mapInArrow(each, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, with scores above 0."""
    spark = docs.sparkSession
    pairs = stored(item_terms(items), "terms")
    blocks = max(1, -(-pairs.count() // POSTINGS))
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id bigint, score bigint"
    passes = []
    for i in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        kinds = block.column("item_id").combine_chunks().dictionary_encode("encode")
        kinds = kinds.chunk(0) if isinstance(kinds, pa.ChunkedArray) else kinds
        item, term = kinds.indices.to_numpy().astype(np.int64), block.column("term").to_numpy().view(np.uint64)
        vocabulary, number = np.unique(term, return_inverse=True)
        order = np.lexsort((item, number))
        of = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
        counts = stored(_counts(docs, spark.sparkContext.broadcast(vocabulary)), "counts")
        held = counts.select(F.explode("ids").alias("id")).groupBy("id").count().toPandas()
        total, terms = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        df[held["id"].to_numpy(dtype=np.int64)] = held["count"].to_numpy(dtype=np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        found = _found(counts, spark.sparkContext.broadcast((weight, of, item[order])), kinds.dictionary, total, terms, k, schema)
        passes.append(stored(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256))), "found"))
    if not passes:
        return spark.createDataFrame([], schema.replace(", doc_id", ", rank int, doc_id"))
    found = reduce(DataFrame.union, passes)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for by in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
