"""N-gram Jaccard join by token-combination prefixes.

Sets of distinct word shingles link when |A & B| / |A | B| >= threshold.  The steps:

1. Every text becomes a 128-bit fingerprint of its shingle set; equal sets are one node.
2. The shingles whose hash falls in a fixed 5/16 of the hash space are counted over all
   documents.  A node that has more shingles of its own than a partner could lack is done.
   For the others every shingle is counted, over their whole sets; that closes more.
3. The open nodes' shingles in order of frequency give a prefix.  Rare shingles are indexed
   one by one.  A frequent one is of a class whose k grows with the frequency: the
   k-combinations of the prefix within small hashed parts of a class are the entries, and
   a part with c shingles counts as c - k + 1, so the prefix is extended accordingly.  Two
   linked nodes always share an entry; a node whose shingles do not suffice for
   its k takes part with k - 1 as well.
4. Entries with the same nodes are one.  An entry's nodes are held against one of them
   (the one with the fewest private shingles, its hub), once more for the large
   entries that stay in several components, and the links' components are formed.
5. Entries of up to FREQUENT nodes that still hold several components are joined with themselves.
   In larger ones every node is written as its difference from the hub.  Two nodes of
   which one is not linked with the hub can only link if they share many of their
   differences: the same index, now of differences, finds those that may.  Differences that
   the same nodes have count as one of their number's weight, so combinations are of different
   passages, and entries that stay large get a hub of their own and are indexed again.
6. Every pair is verified on whole shingle sets; components follow from the links.

Defined results: null, empty and blank texts have n_shingles 0 and only themselves as
component; fewer words than k give one shingle; documents with equal sets link; rows
with a null doc_id take part, and a component's id is its smallest id that is not null.
Repeated rows stay repeated.  Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, components, mix, slices, stored

#: A shingle with (hash & 15) < COUNTED is counted over the corpus.
COUNTED = 5
#: Counts over this make a shingle frequent.
FREQUENT = 64
#: A hub's nodes that have under 2**WHOLE classes of shingles each form combinations of all of a frequency class.
WHOLE = 4
#: Differences from a hub that are within nh / BANDS of each other are indexed with one bound.
BANDS = 16
#: A large entry of differences with under 1/SHRINK of its group's nodes gets a hub of its own, a larger one is joined with itself.
SHRINK = 4


def _shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, words in slices(column, lower=True):
        grams = words.grams(k)
        for i in range(b - a):
            lo, hi = words.of[i], words.of[i + 1]
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                whole = int((words.hash[lo:hi] * PLACE[: hi - lo]).sum(dtype=np.uint64)) ^ int(hi - lo)
                yield mix(np.array([whole], dtype=np.uint64) * PLACE[63:])
            else:
                yield np.zeros(0, dtype=np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def shingle_sets(docs: DataFrame, k: int = 5, only: np.ndarray | None = None) -> DataFrame:
    """(doc_id, node, key, n, toks): set fingerprint, its first half, set size, counted shingles.

    With a bitmap (see _bitmap) only documents that it holds have rows, with all their shingles.
    """

    def each(batches):
        salts = mix(np.array([11, 12], dtype=np.uint64))
        for batch in batches:
            if only is not None:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((only[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            nodes, keys, sizes, toks, first = [], [], [], [], 0
            for s in _shingles(batch.column(1), k):
                both = [int(mix(s ^ salt).sum(dtype=np.uint64)) for salt in salts]
                nodes.append(both[0].to_bytes(8, "big") + both[1].to_bytes(8, "big") if len(s) else None)
                keys.append(both[0])
                sizes.append(len(s))
                toks.append(s if only is not None else s[(s & np.uint64(15)) < COUNTED])
                if len(sizes) == 500:
                    yield made(batch, first, nodes, keys, sizes, toks)
                    nodes, keys, sizes, toks, first = [], [], [], [], first + 500
            yield made(batch, first, nodes, keys, sizes, toks)

    def made(batch, first, nodes, keys, sizes, toks):
        keys = np.array(keys, dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), pa.array(nodes, pa.binary()), pa.array(keys), pa.array(sizes, pa.int32()), _lists(toks)], ["doc_id", "node", "key", "n", "toks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string"), _place()).mapInArrow(each, f"doc_id {kind}, node binary, key bigint, n int, toks array<bigint>")


#: Bits of the map of open documents: its size is fixed, whatever the corpus; it only saves work.
BITS = 1 << 23


def _place() -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("bigint")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """BITS bits in which those of the given doc_ids are set: at most BITS / 64 rows come to the driver."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = ids.select(_place().alias("place")).groupBy((F.col("place") / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def missing(n, threshold: Fraction):
    """How many of n shingles a linked partner may lack."""
    return n - -(-threshold.numerator * n // threshold.denominator)


def _order(count: int) -> int:
    """k of a frequency class: 1 for rare shingles, and one more for every eightfold count."""
    k, most = 1, FREQUENT
    while count > most:
        k, most = k + 1, 8 * most
    return k


def _combined(h: list[int], c: list[int], v: list[int], need: int, level: int) -> list[int]:
    """Entries of frequent shingles in order of frequency that count as `need`: see step 3 of the module's text.

    A shingle of weight v stands for v shingles; of those of a part the k - 1 heaviest do not count.
    """
    out = []
    orders = [_order(x) for x in c]
    for less in range(max(orders, default=0)):
        cover, held, spare = 0, {}, {}
        for x, order, weight in zip(h, orders, v, strict=True):
            k = max(1, order - less)
            parts = 1 if level <= WHOLE else max(1, round(0.75 * 2**level / (k + 2)))
            part = order, (x >> 8) % parts
            mates, heavy = held.setdefault(part, []), spare.setdefault(part, [])
            if k == 1:
                out.append(x)
            for group in combinations(mates, k - 1) if k > 1 else ():
                entry = level + 64 * less
                for y in sorted((*group, x)):
                    entry = (entry * int(PLACE[1]) + (y & (2**64 - 1))) * int(PLACE[2]) % 2**64
                    entry ^= entry >> 29
                out.append(entry)
            heapq.heappush(heavy, weight)
            cover += heapq.heappop(heavy) if len(heavy) > k - 1 else 0
            mates.append(x)
            if cover >= need:
                return out
    return out


def _entries(h: np.ndarray, c: np.ndarray, v: np.ndarray, need: int, levels: set[int]) -> np.ndarray:
    """Distinct index entries of shared shingles h with counts c and weights v, of which a linked partner lacks less than need."""
    if need <= 0:
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((h, c))
    h, c, v = h[order], c[order], v[order]
    rare = int(np.searchsorted(c, FREQUENT, side="right"))
    cover = np.cumsum(v[:rare])
    if rare and cover[-1] >= need:
        return h[: int(np.searchsorted(cover, need)) + 1]
    left = need - (int(cover[-1]) if rare else 0)
    found = {x % 2**64 for level in levels for x in _combined(h[rare:].tolist(), c[rare:].tolist(), v[rare:].tolist(), left, level)}
    return np.concatenate((h[:rare], np.fromiter(found, dtype=np.uint64, count=len(found)).view(np.int64)))


def _indexed(batch_of, kind: str):
    """A mapInArrow function that adds an entry to the columns before `shared`: a row for each entry of a node."""
    names = [x.split()[0] for x in kind.split(", ")]

    def each(batches):
        for batch in batches:
            keep = [batch.column(i) for i in range(len(names) - 1)]
            shared = batch.column(len(names) - 1)
            rest = [batch.column(i) for i in range(len(names), batch.num_columns)]
            found, held = [], 0
            for i in range(batch.num_rows):
                pairs = shared[i].values
                if pairs is None:
                    found.append(np.zeros(0, dtype=np.int64))
                else:
                    h, c = (pairs.field(x).to_numpy(zero_copy_only=False) for x in "hc")
                    v = pairs.field("v").to_numpy(zero_copy_only=False) if pairs.type.num_fields > 2 else np.ones(len(h), dtype=np.int64)
                    found.append(_entries(h, c, v, *batch_of([x[i].as_py() for x in rest])))
                held += len(found[-1])
                if held > 1 << 20 or i == batch.num_rows - 1:
                    at = pa.array(np.repeat(np.arange(i + 1 - len(found), i + 1), [len(x) for x in found]))
                    yield pa.RecordBatch.from_arrays([*[x.take(at) for x in keep], pa.array(np.concatenate(found))], names)
                    found, held = [], 0

    return each


def index_entries(nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, n, p, entry) of nodes (node, n, p, shared: [(c, h)]); p: shingles that no other node has."""

    def need(row):
        n, p = row
        least = -(-threshold.numerator * n // threshold.denominator)
        return missing(n, threshold) - p + 1, {n.bit_length(), least.bit_length()}

    kind = "node binary, n int, p int, entry bigint"
    return nodes.select("node", "n", "p", "shared", F.col("n").alias("n_"), F.col("p").alias("p_")).mapInArrow(_indexed(need, kind), kind)


def counted(sets: DataFrame) -> DataFrame:
    """sets (node, n, toks) with shared: the (c, h) of their shingles that occur in c > 1 nodes, null without any."""
    flat = sets.select("node", F.explode("toks").alias("h"))
    # Written, so that either side of the join has a shuffle of its own and a hot shingle's partition can be split.
    often = stored(flat.groupBy("h").agg(F.count("*").cast("int").alias("c")).where("c > 1"), "whole-often")
    shared = flat.join(often, "h").groupBy("node").agg(F.collect_list(F.struct("c", "h")).alias("shared"))
    return sets.join(shared, "node", "left")


def _marks() -> list[F.Column]:
    """128 bits of the set of nodes of a group."""
    return [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"mark{i}") for i in range(2)]


def classed(rows: DataFrame) -> DataFrame:
    """rows (gid, node, .., d) with shared: (c, h, v) of the classes of d's shingles.

    The shingles that the same c > 1 nodes of a group have in d are one class: h is the least of them, v their number.
    A section that many letters have is one class, however long it is.
    """
    flat = rows.select("gid", "node", F.explode("d").alias("h"))
    often = flat.groupBy("gid", "h").agg(F.count("*").cast("int").alias("c"), *_marks()).where("c > 1")
    heads = stored(often.groupBy("gid", "c", "mark0", "mark1").agg(F.min("h").alias("h"), F.count("*").cast("int").alias("v")).select("gid", "h", "c", "v"), "classes")
    shared = flat.join(heads, ["gid", "h"]).groupBy("gid", "node").agg(F.collect_list(F.struct("c", "h", "v")).alias("shared"))
    return rows.join(shared, ["gid", "node"], "left")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes that link, from whole shingle sets (node, n, toks)."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", both.alias("both"))
        .where(threshold.denominator * F.col("both") >= threshold.numerator * (F.col("na") + F.col("nb") - F.col("both")))
        .select("a", "b")
    )


def _may_link(x: str, y: str, t: Fraction) -> F.Column:
    """Bounds by size and by private shingles: (1 + t) |A - B| + (1 + t) |B - A| <= (1 - t) (na + nb) for linked sets."""
    num, den = t.numerator, t.denominator
    col = lambda name: F.col(f"{x}{name}") + F.col(f"{y}{name}")
    return (num * F.greatest(f"{x}n", f"{y}n") <= den * F.least(f"{x}n", f"{y}n")) & ((den + num) * col("p") <= (den - num) * col("n"))


def open_nodes(rows: DataFrame, docs: DataFrame, k: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(node, n, p, shared) of the nodes that may have links, and (node, n, toks) with their whole sets."""
    num, den = t.numerator, t.denominator
    # A set of m shingles links with another one only if m/(m+1) >= t.
    linkable = rows.where((F.col("n") > 0) & (den * F.col("n") >= num * (F.col("n") + 1)))
    flat = linkable.select("key", F.explode("toks").alias("h"))
    often = stored(flat.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "often")
    hits = flat.join(often, "h").groupBy("key").agg(F.collect_set(F.struct("c", "h")).alias("hits"))
    sizes = linkable.groupBy("node").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.first(F.size("toks")).alias("counted"), F.min("doc_id").alias("doc_id"), F.count("*").alias("m"))
    lacking = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den))
    # The m documents of a node count each of its shingles m times; one that counts more is shared with another node.
    left = sizes.join(hits, "key", "left").withColumn("shared", F.coalesce(F.size(F.filter("hits", lambda x: x["c"] > F.col("m"))), F.lit(0)))
    left = stored(left.where(F.col("counted") - F.col("shared") <= lacking + 1).select("node", "doc_id"), "open")
    # Whole sets of the open nodes, from one document of each.
    sets = shingle_sets(docs, k, _bitmap(left)).select("node", "n", "toks").join(left.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = stored(sets, "whole")
    nodes = counted(sets).select("node", "n", (F.col("n") - F.coalesce(F.size("shared"), F.lit(0))).alias("p"), "shared")
    return nodes.where(F.col("p") <= lacking), sets


def differences(large: DataFrame, sets: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(a, b), pairs that may link among nodes held against a hub, and (gid, hub, node, n, comp), the entries still large.

    large: (gid, hub, node, comp), a hub for each gid.  With d(x) the shingles in which x and its hub differ, x and y
    link if and only if 2 (1 + t) |d(x) & d(y)| >= e(x) + e(y), e(x) = (1 + t) |d(x)| - (1 - t) |x|.  x is linked with
    the hub where e(x) <= (1 - t) |hub|; two such nodes are in one component, so one of a
    pair has a greater e and the bound is positive.  A pair meets in the band of its lesser e, where the least e of
    the band's own nodes gives the bound.  An entry with over FREQUENT nodes,
    but under 1/SHRINK of its group's, is a group with a hub of its own.
    """
    num, den = t.numerator, t.denominator
    both, apart = den + num, den - num
    of = lambda name: sets.select(F.col("node").alias(name), F.col("n").cast("bigint").alias(f"{name}_n"), F.col("toks").alias(f"{name}_toks"))
    rows = large.join(of("hub"), "hub").join(of("node"), "node")
    d = F.concat(F.array_except("node_toks", "hub_toks"), F.array_except("hub_toks", "node_toks"))
    rows = stored(rows.select("gid", "node", "comp", F.col("node_n").alias("n"), F.col("hub_n").alias("nh"), d.alias("d")), "differences")
    rows = classed(rows).withColumn("w", F.coalesce(F.aggregate("shared", F.lit(0), lambda s, x: s + x["v"]), F.lit(0)))
    rows = rows.withColumn("e", both * F.size("d").cast("bigint") - apart * F.col("n")).withColumn("edge", apart * F.col("nh"))
    ratio = F.col("e") / (den * F.col("nh"))
    rows = rows.withColumn("band", F.floor(BANDS * F.when(ratio <= 4, ratio).otherwise(4 + F.log(ratio / 4)))).withColumn("far", F.col("e") > F.col("edge"))
    rows = stored(rows.select("gid", "node", "n", "comp", "w", "e", "edge", "band", "far", F.coalesce(F.size("shared"), F.lit(0)).alias("classes"), "shared"), "differences")

    # A group has few bands: even and, for texts far longer than the hub, logarithmic.
    bands = rows.groupBy("gid", "band").agg(F.min("e").alias("low"), F.max("w").alias("most"), F.max("classes").alias("widest"))
    bands = bands.groupBy("gid").agg(F.collect_list(F.struct("band", "low", "most")).alias("bands"), F.max("widest").alias("widest"))
    least = F.greatest(F.lit(1), F.ceil((F.col("e") + F.greatest("at.low", F.when(F.col("far"), F.col("at.low")).otherwise(F.col("edge") + 1))) / (2 * both)))
    own = F.col("at.band") == F.col("band")
    met = rows.join(stored(bands, "bands"), "gid").withColumn("at", F.explode("bands")).where(own | (F.col("far") & (F.col("at.band") < F.col("band"))))
    met = met.withColumn("least", least).where("least <= w and least <= at.most or band = at.band and least <= w")
    met = met.select("gid", "node", "n", "comp", "w", "e", "edge", F.col("at.band").alias("band"), "shared", (F.col("w") - F.col("least") + 1).cast("int").alias("need"), "widest")
    kind = "gid binary, node binary, n bigint, comp binary, w int, e bigint, edge bigint, band bigint, entry bigint"
    found = stored(met.mapInArrow(_indexed(lambda r: (r[0], {r[1].bit_length()}), kind), kind), "differences")

    key = ["gid", "band", "entry"]
    sizes = rows.groupBy("gid").agg(F.count("*").alias("parent"))
    several = found.groupBy(*key).agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node"), "node")).getField("node").alias("next"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.col("e") > F.col("edge")).alias("far"), *_marks())
    several = several.where("lo <> hi and far").groupBy("gid", "m", "mark0", "mark1", "next").agg(F.min(F.struct("band", "entry")).alias("one"))
    several = stored(several.join(sizes, "gid").select("gid", "one.*", "m", "next", F.expr(f"m > {FREQUENT} and {SHRINK} * m < parent").alias("deeper")), "several")
    x = found.join(several.where("not deeper").select(*key), key, "left_semi").alias("x")
    y = found.alias("y")
    # The bound once more for this pair, with what either shares with any other node.
    close = 2 * both * F.least("x.w", "y.w") >= F.col("x.e") + F.col("y.e")
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in key])
    pairs = x.join(y, same & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & (F.greatest("x.e", "y.e") > F.col("x.edge")) & close)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    name = F.unhex(F.md5(F.concat("gid", F.encode(F.concat_ws(",", "band", "entry"), "utf-8"))))
    again = found.join(several.where("deeper").select(*key, "next"), key).select(name.alias("gid"), F.col("next").alias("hub"), "node", "n", "comp")
    return pairs, stored(again, "again")


def jaccard_groups(docs: DataFrame, k: int = 5, threshold: float | str = "0.8") -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of every document, and (node, comp) of the nodes that have a link."""
    t = Fraction(str(threshold))
    rows = stored(shingle_sets(docs, k), "sets")
    nodes, sets = open_nodes(rows, docs, k, t)
    entries = stored(index_entries(nodes, t), "entries")
    rows = rows.select("doc_id", "node", "n")

    # Entries with the same nodes become one.
    heads = entries.groupBy("entry").agg(F.min(F.struct("p", "node", "n")).alias("hub"), F.count("*").alias("m"), *_marks()).where("m > 1")
    heads = stored(heads.groupBy("m", "mark0", "mark1").agg(F.min(F.struct("entry", "hub")).alias("one")).select("one.*", "m"), "heads")
    groups = stored(entries.join(heads, "entry"), "groups")
    found = None

    def linked(pairs: DataFrame) -> None:
        """Adds the pairs that link to the components found so far."""
        nonlocal found
        links = stored(verified(pairs, sets, t), "links")
        if found is None or not links.isEmpty():
            stars = found.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")) if found else links.limit(0)
            found = stored(components(links.union(stars)), "components")

    def mixed(groups: DataFrame, key: str = "entry") -> DataFrame:
        """The groups that still hold several components, with the component of each node."""
        labelled = groups.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = stored(labelled.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(key), "mixed")
        return stored(labelled.join(several, key, "left_semi"), "mixed")

    def spokes(groups: DataFrame, hub: str) -> DataFrame:
        to = [F.col(f"{hub}.{c}").alias(f"hub_{c}") for c in ("node", "n", "p")]
        met = groups.select("node", "n", "p", *to).distinct().where((F.col("node") != F.col("hub_node")) & _may_link("", "hub_", t))
        return met.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()

    linked(spokes(groups, "hub"))
    left = mixed(groups)
    large = left.where(F.col("m") > FREQUENT)
    if not large.isEmpty():
        # Large entries get a second hub, of those that are not in the first one's component.
        own = large.where("node = hub.node").select("entry", F.col("comp").alias("first"))
        other = large.join(own, "entry").where("comp <> first").groupBy("entry").agg(F.min(F.struct("p", "node", "n", "comp")).alias("next"))
        linked(spokes(large.join(stored(other, "hubs"), "entry").where("comp <> next.comp"), "next"))
        left = mixed(left.drop("comp"))
        large = left.where(F.col("m") > FREQUENT).select(F.col("hub.node").alias("gid"), F.col("hub.node").alias("hub"), "node", "comp").where("node <> hub").distinct()
        while not large.isEmpty():
            pairs, again = differences(large, sets, t)
            linked(pairs)
            if again.isEmpty():
                break
            again = again.where("node <> hub")
            linked(again.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
            large = mixed(again.drop("comp"), "gid")
    small = left.where(F.col("m") <= FREQUENT)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x.", "y.", t))
    linked(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    return rows, found


def jaccard_components(docs: DataFrame, k: int = 5, threshold: float | str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; see the module's text for the defined results."""
    rows, found = jaccard_groups(docs, k, threshold)
    labelled = rows.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Written, so that the join below has a shuffle on either side and a hot component's partition can be split.
    least = stored(labelled.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = labelled.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float | str = "0.8") -> DataFrame:
    """The documents, one of each group of near copies: the one with the least doc_id.

    Rows that repeat the kept one, doc_id and all, are the same document and stay with it;
    so do texts without words and rows without a doc_id.
    """
    comps = jaccard_components(docs, k, threshold).where("component_id <> doc_id and n_shingles > 0").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(comps, docs["doc_id"] == comps["_gone"], "left_anti")
