"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. The n-grams of the test items are looked up in every document.  Each item that holds a
   hit, however frequent that n-gram is, gets a window around its hits, as wide on either
   side as an alignment through a hit can reach that scores enough (two item lengths at 0.5).
2. An item's words that a window holds, counted with repeats, bound the score from above;
   pairs whose bound is below the threshold are left out, which loses nothing.
3. Word-level local alignment (match 2, mismatch and gap -1) scores the other pairs.  The
   score is divided by the best possible one, so edited and paraphrased copies score
   between 0 and 1.

All of it happens where the document is read, so no window travels.  Words are runs of
letters and digits, with A-Z lower-cased, so punctuation does not matter.  The items' words
are sent to the tasks in blocks of about SEEDS, one pass over the documents for each block,
so what is broadcast is bounded whatever the benchmark's size.

Defined results: null and empty texts and items match nothing; an item with fewer words
than n has no seed and matches nothing; of equal items each is reported; equal documents
are reported once per doc_id; rows with a null doc_id are reported with a null doc_id; of
alignments with equal scores the one that ends last is told.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, SPACE, mix, slices, stored

#: Words of items in one block, at least as many as their seeds: 16 MB of hashes.
SEEDS = 2_000_000
#: Hits of items and words of items that are worked on together.
PART = 500_000
_BREAKS = SPACE.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        _BREAKS[_c] = True


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, item, words): word hashes; item: a row number that is the item's own."""

    def each(batches):
        for batch in batches:
            words_of = []
            for a, b, words in slices(batch.column(1), True, space=_BREAKS):
                words_of += [words.hash[words.of[i] : words.of[i + 1]].view(np.int64) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words_of, pa.list_(pa.int64()))], ["item_id", "item", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string"), F.monotonically_increasing_id().alias("item"))
    return rows.mapInArrow(each, f"item_id {kind}, item bigint, words array<bigint>")


def _parts(sizes: np.ndarray, most: int):
    """(first, after the last) of runs whose sizes add up to at most `most`, or of one element."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (sizes[i] of them) for each i in turn."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Index:
    """The seeds of some items and the items of each, and each item's distinct words with their counts."""

    def __init__(self, words: np.ndarray, of: np.ndarray, n: int, least: float):
        self.words, self.of, self.n, self.size = words, of, n, np.diff(of)
        # m matches and g other steps score 2 m - g >= 2 least size, so m + g <= (3 - 2 least) size.
        self.reach = np.ceil((3 - 2 * least) * self.size).astype(np.int64)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for j in range(n):
            grams += words[j : j + len(grams)] * PLACE[j % 64]
        grams = mix(grams)
        inside = np.arange(len(grams)) + n <= of[owner[: len(grams)] + 1]
        self.seeds, seed = np.unique(grams[inside], return_inverse=True)
        pairs = np.unique(seed * len(self.size) + owner[: len(grams)][inside])
        self.item = pairs % max(1, len(self.size))
        self.item_of = np.searchsorted(pairs // max(1, len(self.size)), np.arange(len(self.seeds) + 1))
        self.vocabulary, number = np.unique(words, return_inverse=True)
        pairs, self.count = np.unique(owner * len(self.vocabulary) + number, return_counts=True)
        self.word = pairs % max(1, len(self.vocabulary))
        self.word_of = np.searchsorted(pairs // max(1, len(self.vocabulary)), np.arange(len(self.size) + 1))
        # A bitmap of the low bits rules nearly every gram out before the binary search.
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.low = np.uint64(len(self.bits) - 1)
        self.bits[self.seeds & self.low] = True

    def hits(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of seeds, their numbers and their documents."""
        grams = words.grams(self.n)
        at = np.flatnonzero(self.bits[grams & self.low])
        seed = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        doc = np.searchsorted(words.of, at, side="right") - 1
        good = (self.seeds[seed] == grams[at]) & (at + self.n <= words.of[doc + 1])
        return at[good], seed[good], doc[good]

    def windows(self, words, at: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, document, first word, word after the last) of the windows around an item's hits."""
        times = self.item_of[seed + 1] - self.item_of[seed]
        item = self.item[_ranges(self.item_of[seed], times)]
        order = np.argsort(item, kind="stable")
        item, at, doc = item[order], np.repeat(at, times)[order], np.repeat(doc, times)[order]
        reach = self.reach[item]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach[1:])
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(at)) - 1
        return item[s], doc[s], np.maximum(words.of[doc[s]], at[s] - reach[s]), np.minimum(words.of[doc[s] + 1], at[e] + self.n + reach[s])

    def shared(self, words, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of an item's words, counted with repeats, the words from lo to hi hold."""
        total = len(words.hash) + 1
        edges = np.zeros(total, dtype=np.int64)
        np.add.at(edges, lo, 1)
        np.add.at(edges, hi, -1)
        place = np.flatnonzero(np.cumsum(edges) > 0)
        number = np.minimum(np.searchsorted(self.vocabulary, words.hash[place]), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == words.hash[place]
        keys = np.sort(number[known] * total + place[known])
        sizes = self.word_of[item + 1] - self.word_of[item]
        out = np.zeros(len(item), dtype=np.int64)
        for a, b in _parts(sizes, PART):
            mine = _ranges(self.word_of[item[a:b]], sizes[a:b])
            key = self.word[mine] * total
            held = np.searchsorted(keys, key + np.repeat(hi[a:b], sizes[a:b])) - np.searchsorted(keys, key + np.repeat(lo[a:b], sizes[a:b]))
            out[a:b] = np.add.reduceat(np.minimum(held, self.count[mine]), np.cumsum(sizes[a:b]) - sizes[a:b])
        return out


def align(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs of word sequences, and where in `right` they end (exclusive).

    All pairs advance together by one word of `left`; gaps along `right` are a running maximum.
    """
    rows, cols = max(map(len, left)), max(map(len, right))
    a = np.zeros((len(left), rows), dtype=np.int64)
    b = np.zeros((len(left), cols), dtype=np.int64)
    a_in, b_in = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a[i, : len(x)], b[i, : len(y)], a_in[i, : len(x)], b_in[i, : len(y)] = x, y, True, True
    step = np.arange(cols, dtype=np.int32)
    h = np.zeros((len(left), cols + 1), dtype=np.int32)
    best, end = np.zeros(len(left), dtype=np.int32), np.zeros(len(left), dtype=np.int64)
    every = np.arange(len(left))
    for i in range(rows):
        same = (b == a[:, i : i + 1]) & b_in & a_in[:, i : i + 1]
        now = np.maximum(np.maximum(h[:, :-1] + np.where(same, 2, -1), h[:, 1:] - 1), 0).astype(np.int32)
        now = np.maximum.accumulate(now + step, axis=1) - step
        h[:, 1:] = now
        at = now.argmax(axis=1)
        better = now[every, at] > best
        best[better], end[better] = now[every, at][better], at[better] + 1
    return best, end


def _aligned(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of pairs as shares of the best possible ones, and where in `right` they end (exclusive)."""
    score, end = np.zeros(len(left)), np.zeros(len(left), dtype=np.int64)
    order = sorted(range(len(left)), key=lambda i: len(right[i]))
    while order:
        # Pairs of like size together, about 64k cells of a row at once.
        take = max(1, 65536 // max(1, len(right[order[-1]])))
        part, order = order[-take:], order[:-take]
        best, at = align([left[i] for i in part], [right[i] for i in part])
        score[part], end[part] = best / np.array([2 * len(left[i]) for i in part]), at
    return score, end


def _found(docs: DataFrame, ids: pa.Array, words: np.ndarray, of: np.ndarray, n: int, least: float, schema: str) -> DataFrame:
    """(doc_id, item_id, score, end_word): windows that score `least` or more, for the items of one block."""

    def each(batches):
        index = Index(words, of, n, least)
        for batch in batches:
            for a, _, text in slices(batch.column(1), True, space=_BREAKS):
                at, seed, doc = index.hits(text)
                # A window reaches beyond each hit of its own part, so parts may be cut between any hits.
                for i, j in _parts(index.item_of[seed + 1] - index.item_of[seed], PART):
                    item, d, lo, hi = index.windows(text, at[i:j], seed[i:j], doc[i:j])
                    may = 2 * index.shared(text, item, lo, hi) / (2 * index.size[item]) >= least
                    item, d, lo, hi = item[may], d[may], lo[may], hi[may]
                    score, end = _aligned([index.words[of[k] : of[k + 1]] for k in item], [text.hash[x:y] for x, y in zip(lo, hi, strict=True)])
                    keep = np.flatnonzero(score >= least)
                    if len(keep):
                        end = (end + lo - text.of[d])[keep]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + d[keep])), ids.take(pa.array(item[keep])), pa.array(score[keep]), pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "end_word"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(each, schema)


def contaminated(docs: DataFrame, items: DataFrame, n: int = 4, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, end_word): pairs whose alignment scores `least` or more, with the best score and where it ends."""
    kept = stored(item_words(items).where(F.size("words") >= n), "items")
    blocks = max(1, -(-(kept.agg(F.sum(F.size("words"))).first()[0] or 0) // SEEDS))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, end_word bigint"
    passes = []
    for i in range(blocks):
        # One block of a bounded number of words; all documents are read for each.
        block = kept.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).select("item_id", "words").toArrow().combine_chunks()
        if block.num_rows:
            words = block.column("words").combine_chunks()
            of = np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            found = _found(docs, block.column("item_id").combine_chunks(), words.flatten().to_numpy().view(np.uint64), of, n, least, schema)
            # Written, so that the driver holds one block at a time.
            passes.append(stored(found, "found") if blocks > 1 else found)
    if not passes:
        return docs.sparkSession.createDataFrame([], schema)
    found = reduce(DataFrame.union, passes)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("best")).select("doc_id", "item_id", "best.score", "best.end_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents without those that hold a test item; rows without a doc_id stay."""
    bad = stored(contaminated(docs, items, **parameters).select(F.col("doc_id").alias("_bad")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
