"""Mixing sources to target weights by capped water-filling.

Weights 3, 1, 2, repeating, go to the sources in code-point order, null last.  A source
whose proportional share of the budget exceeds `epochs` times its size is clamped there
and the excess goes to the others by weight, until none is above.

A target of q times a source's size takes every document floor(q) times, and a seeded
draw of documents once more until the fraction is met.  The draw orders documents by a
hash.  Documents with over 1/`large` of their source's words are drawn first, to the fraction
of their own sum, or further where the small ones could not make up the rest: of `tries` seeded orders, in each of
which a document that would exceed the goal is left out, the one that comes nearest.  Small ones then meet what is left of the
target.  So a source with small documents enough misses its target by at
most half of one of them, another by at most half the least large one that any order leaves.  Sums over 4096 hash
bins of each source tell which bins are taken whole; the one bin at the edge is cut into 4096
finer ones, and so on for LEVELS levels, so that only a 2^-36th of a source's hashes is ordered one by one.

Defined results: a null or blank text has size 0, takes no part in the draw and is taken floor(q) times;
an empty table gives an empty result; equal rows are drawn as separate documents with
the same hash; when all sizes are 0 all targets are 0.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Times that the bin at the edge is cut into 4096.
LEVELS = 3


def words(text: str | Column) -> Column:
    """Number of words: maximal runs of other characters than space and \\x09-\\x0D."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source, however many there are."""
    # Sources are ranked where they lie in ranges of code points: only the ranges' counts meet in one task.
    ranged = sizes.withColumn("last", F.col("source").isNull()).withColumn("code", F.encode("source", "utf-8")).repartitionByRange("last", "code").sortWithinPartitions("last", "code")
    ranged = stored(ranged.select("source", "source_size", F.monotonically_increasing_id().alias("at")), "ranged")
    part = F.shiftrightunsigned("at", 33)
    counts = ranged.groupBy(part.alias("part")).count()
    first = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("first"))
    rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = ranged.join(first, part == F.col("part")).select("source", "source_size", F.get(kinds, F.pmod(rank, F.lit(len(weights))).cast("int")).alias("weight"))
    s = stored(s.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("at", F.col("cap") / F.col("weight")), "sources")
    # Water level: sources that it would fill beyond their cap are clamped, and the rest of the budget raises it for the others.
    budget, level = None, -1.0
    while True:
        held, free, total = s.agg(F.sum(F.when(F.col("at") <= level, F.col("cap")).otherwise(0.0)), F.sum(F.when(F.col("at") > level, F.col("weight")).otherwise(0.0)), F.sum("source_size")).first()
        budget = float(total or 0) * float(share)
        if not free or (risen := max(level, (budget - held) / free)) == level:
            break
        level = risen
    target = F.col("cap") if not free else F.least("cap", F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def chosen(large: DataFrame, tries: int) -> DataFrame:
    """(l_of, taken, taken_sum) of large (source, place, size, goal): the large documents of each source that are drawn.

    They are walked in `tries` seeded orders, each taking what still fits into the goal;
    at the end the least of the others is added if that comes nearer.  The order that comes nearest
    counts, the first of equals, so the distance is at most half the least document left.
    """
    pairs = F.collect_list(F.struct(F.col("size").cast("double").alias("size"), "place"))
    held = large.groupBy("source").agg(F.array_sort(pairs).alias("all"), F.first("goal").alias("goal"))
    none = F.lit(None).cast("struct<size:double,place:bigint>")
    goal = F.col("goal")

    def walk(seed: Column, first: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
        """Folds step(acc, x, fits) over the documents x in the order of a seed, with acc.sum, what is taken, and acc.least, the least of the others."""

        def next_one(acc: Column, y: Column) -> Column:
            fits = acc["sum"] + y["x"]["size"] <= goal
            rest = [F.when(fits, acc["sum"] + y["x"]["size"]).otherwise(acc["sum"]).alias("sum"), F.when(fits, acc["least"]).otherwise(F.least(acc["least"], y["x"])).alias("least")]
            return F.struct(*rest, step(acc, y["x"], fits).alias("taken"))

        order = F.array_sort(F.transform("all", lambda x: F.struct(F.xxhash64(x["place"], seed).alias("h"), x.alias("x"))))
        return F.aggregate(order, F.struct(F.lit(0.0).alias("sum"), none.alias("least"), first.alias("taken")), next_one)

    nearer = lambda acc: F.coalesce(acc["sum"] + acc["least"]["size"] - goal < goal - acc["sum"], F.lit(False))
    missed = lambda acc: F.when(nearer(acc), acc["sum"] + acc["least"]["size"] - goal).otherwise(goal - acc["sum"])
    tried = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: F.struct(missed(walk(i, F.lit(0), lambda acc, x, fits: acc["taken"])).alias("miss"), i.alias("i")))
    # Each step is a column of its own, read from rows, so that no fold is repeated where its result is used.
    best = stored(held.select("source", "all", "goal", F.array_min(tried)["i"].alias("seed")), "best")
    kept = lambda acc, x, fits: F.when(fits, F.array_append(acc["taken"], x["place"])).otherwise(acc["taken"])
    walked = stored(best.select("source", "goal", walk(F.col("seed"), F.expr("cast(array() as array<bigint>)"), kept).alias("w")), "walked")
    w = F.col("w")
    taken = F.when(nearer(w), F.array_append("w.taken", F.col("w.least.place"))).otherwise(F.col("w.taken"))
    return walked.select(F.col("source").alias("l_of"), taken.alias("taken"), (F.col("w.sum") + F.when(nearer(w), F.col("w.least.size")).otherwise(0.0)).alias("taken_sum"))


def planned(docs: DataFrame, weights: tuple[float, ...], share: float, epochs: float, seed: int, large: int, tries: int, keep: list[str]) -> DataFrame:
    """One row a document: row (struct of the columns to keep), source, size, source_size, target, copies."""
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    d = docs.select(F.struct(*keep).alias("row"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), draw.alias("draw"))
    if keep == ["doc_id"]:
        d = slim = stored(d, "sizes")
    else:
        slim = stored(d.drop("row"), "sizes")
    t = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("whole", F.least(F.floor(ratio + F.lit(1e-12)), F.lit(int(epochs))))
    t = stored(t.withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumnRenamed("source", "of"), "targets")
    of = F.col("source").eqNullSafe(F.col("of"))
    is_large = F.col("size") * large > F.col("source_size")
    #: The draw in signed order, so that bins and documents are in one order.
    place = F.col("draw").bitwiseXOR(F.lit(-(2**63)))
    bin_of = lambda level: F.shiftrightunsigned("draw", 64 - 12 * level)

    def with_last(goal: F.Column, rows: DataFrame, name: str) -> DataFrame:
        """t with the last place of each source that brings its sum nearer to the goal: equal places are taken together."""
        sums = rows.groupBy("source", place.alias("place")).agg(F.sum("size").alias("size"), F.first(goal).alias("goal"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("place"))
        last = sums.withColumn("run", run).where(F.col("run") - F.col("size") / 2 <= F.col("goal")).groupBy(F.col("source").alias("l_of")).agg(F.max("place").alias(name), F.max("run").alias(f"{name}_sum"))
        return stored(t.join(last, F.col("of").eqNullSafe(F.col("l_of")), "left").drop("l_of"), "targets")

    # Large documents come first, so that what they miss or exceed is made up by small ones.  A source has fewer than `large` of them.
    every = slim.where("size > 0").join(t, of)
    sums = every.groupBy("source").agg(F.sum(F.when(is_large, F.col("size")).otherwise(0)).alias("large_sum"), F.sum("size").alias("whole_sum"), F.first("extra").alias("extra"), F.first("source_size").alias("source_size"))
    # Their share of the draw, or more where the small ones cannot hold the rest.
    goal = F.greatest(F.col("extra") * F.col("large_sum") / F.col("source_size"), F.col("extra") - (F.col("whole_sum") - F.col("large_sum")))
    goals = stored(sums.where("large_sum > 0").select(F.col("source").alias("g_of"), goal.alias("goal")), "goals")
    big = every.where(is_large).groupBy("source", place.alias("place")).agg(F.sum("size").alias("size")).join(goals, F.col("source").eqNullSafe(F.col("g_of")))
    drawn_large = chosen(big, tries)
    t = stored(t.join(drawn_large, F.col("of").eqNullSafe(F.col("l_of")), "left").drop("l_of"), "targets")
    t = t.withColumn("rest", F.greatest(F.lit(0.0), F.col("extra") - F.coalesce("taken_sum", F.lit(0.0)))).withColumn("edge", F.struct(F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("before")))

    # Bins before the edge bin are taken whole; a source that takes nothing or everything has no edge.
    small = lambda: slim.where("size > 0").join(t, of).where(~is_large)
    for level in range(1, LEVELS + 1):
        inner = small().where("edge is not null") if level == 1 else small().where(bin_of(level - 1) == F.col("edge.bin"))
        bins = inner.groupBy("source", bin_of(level).alias("bin")).agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"), F.first("edge.before").alias("start"))
        bins = bins.withColumn("before", F.col("start") + F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
        at_edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest"))
        edges = bins.groupBy(F.col("source").alias("e_of")).agg(F.min(F.when(at_edge, F.struct("bin", "before"))).alias("edge"))
        t = stored(t.drop("edge").join(edges, F.col("of").eqNullSafe(F.col("e_of")), "left").drop("e_of"), "targets")
        if level == 1:
            t = t.withColumn("all_small", F.col("edge").isNull() & (F.col("rest") > 0))
    t = with_last(F.col("rest") - F.col("edge.before"), small().where(bin_of(LEVELS) == F.col("edge.bin")), "last_small")

    # One row a source now tells every document's copies; the documents are not shuffled.
    drawn = F.col("all_small") | (bin_of(LEVELS) < F.col("edge.bin")) | ((bin_of(LEVELS) == F.col("edge.bin")) & (place <= F.col("last_small")))
    extra = (F.col("size") > 0) & (F.col("whole") < F.ceil(F.lit(float(epochs)))) & F.when(is_large, F.array_contains("taken", place)).otherwise(drawn)
    copies = (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")).cast("int")
    return d.join(t, of).select("row", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 7, large: int = 200, tries: int = 64) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, size, source_size, target, copies (how often the mix takes it)."""
    plan = planned(docs, weights, share, epochs, seed, large, tries, ["doc_id"])
    return plan.select("row.doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 7, large: int = 200, tries: int = 64) -> DataFrame:
    """The mixed corpus: the rows of docs with all their columns, each as often as the mix takes it."""
    plan = planned(docs, weights, share, epochs, seed, large, tries, docs.columns)
    return plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
