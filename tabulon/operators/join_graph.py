"""Join graph: path search for many table pairs at once, plans, and their application.

edges: src_table, dst_table, on ('SRC.a = DST.b'), join_type, cardinality, cost,
constraint_name; a null cost is 1.0, a null join type INNER JOIN.  Edges are walked either
way and keep their stored direction in a path.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import iteration
from .iteration import side, stored


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, edge): every edge from either end, with cost and join type filled in."""
    e = edges.withColumn("cost", F.coalesce("cost", F.lit(1.0))).withColumn("join_type", F.coalesce("join_type", F.lit("INNER JOIN")))
    e = e.select("src_table", "dst_table", F.struct("src_table", "dst_table", "on", "join_type", "cardinality", "cost").alias("edge"))
    forth = e.select(F.col("src_table").alias("a"), F.col("dst_table").alias("b"), "edge")
    back = e.select(F.col("dst_table").alias("a"), F.col("src_table").alias("b"), "edge")
    return forth.unionByName(back)


def paths(edges: DataFrame, pairs: DataFrame, by: str = "cost", max_hops: int | None = None) -> DataFrame:
    """(base, target, cost, hops, nodes, edges): the best path of each pair (base, target) that is connected.

    by 'cost' gives the cheapest and ignores max_hops unless it is given, by 'hops' the
    shortest; ties go by cost, hops, then the node sequence.  Costs are not negative.  All bases relax together, one
    join and one aggregate a round, until nothing improves; a round's rows are numbers alone.  Dead ends that
    hold neither the base nor one of its targets are not entered.  Then each
    node gets its predecessor, and the wanted paths are unrolled together by doubled steps, log(hops) rounds.
    Where tables times bases are many, nothing is broadcast.
    """
    steps = both_ways(edges).where("a <> b")
    # Of parallel edges the cheapest is walked.
    steps = steps.groupBy("a", "b").agg(F.min(F.struct(F.col("edge.cost").alias("c"), F.col("edge.on").alias("o"), F.col("edge").alias("edge"))).getField("edge").alias("edge"))
    steps = stored(steps.select("a", "b", F.col("edge.cost").alias("step"), "edge"), "steps")
    pairs = stored(pairs.select("base", "target").distinct(), "pairs")
    tables = steps.select("a").distinct().count()
    reach = tables * pairs.select("base").distinct().count()
    best = _distances(steps, pairs.select("base").distinct(), by, max_hops, reach, *_dead_ends(steps, pairs, tables, reach))
    wanted = pairs.join(side(best.withColumnRenamed("node", "target"), reach), ["base", "target"])
    wanted = stored(wanted, "wanted")
    back = _predecessors(best, steps, reach)

    rows = wanted.select("base", "target", F.col("target").alias("node"), F.col("hops").alias("pos"))
    jumps = [back]
    for _ in range(1, (wanted.agg(F.max("hops")).first()[0] or 0).bit_length()):
        on = jumps[-1].select("base", F.col("node").alias("prev"), F.col("prev").alias("further"))
        jumps.append(stored(jumps[-1].join(side(on, reach), ["base", "prev"]).select("base", "node", F.col("further").alias("prev")), "jumps"))
    for k, jump in reversed([*enumerate(jumps)]):
        # From every row a step of 2^k back: each place of a path arises once, by the binary digits of its distance from the end.
        more = rows.where(F.col("pos") >= 1 << k).join(side(jump, reach), ["base", "node"]).select("base", "target", F.col("prev").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))
        # Each step reads the rows twice, so a plan of all steps would double with each.
        rows = stored(rows.unionByName(more), "rows")
    edge = steps.select(F.col("a").alias("prev"), F.col("b").alias("node"), "edge")
    walked = rows.join(side(back, reach), ["base", "node"], "left").join(side(edge, reach), ["prev", "node"], "left")
    packed = walked.groupBy("base", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "edge"))).alias("p"))
    lists = packed.select("base", "target", F.transform("p", lambda x: x["node"]).alias("nodes"), F.transform(F.filter("p", lambda x: x["pos"] > 0), lambda x: x["edge"]).alias("edges"))
    return pairs.join(side(wanted, reach), ["base", "target"]).join(side(lists, reach), ["base", "target"]).select("base", "target", "cost", "hops", "nodes", "edges")


#: Rounds in which dead ends are cut off, each the ends that the last one left, and the least tables of a graph where that is tried.
CUTS, LARGE = 32, 256


def _dead_ends(steps: DataFrame, pairs: DataFrame, before: int, reach: int) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """(node) in a dead end, and (base, node) of those on the way from a base or one of its targets to where the dead ends begin.

    A node with one neighbour is a dead end, and so is one that has one neighbour left when those are cut off.
    A path enters a dead end only if it starts or ends there, so a base's search needs none but those of its own and of
    its targets.  What is not cut off after CUTS rounds stays open to all, as in graphs without dead ends.
    before: the tables of the graph; reach: them times the bases.
    """
    left, cut = steps.select("a", "b"), None
    if before < LARGE:
        return None, None
    for k in range(CUTS):
        ends = left.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
        # Of two that have only each other, the lesser stays.
        mutual = ends.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("mutual"))
        ends = ends.join(side(mutual, reach), ["a", "b"], "left").where("mutual is null or a > b")
        ends = stored(ends.select(F.col("a").alias("node"), F.col("b").alias("up"), F.lit(k).alias("cut")), "ends")
        n = ends.count()
        if n == 0 and cut is None:
            return None, None
        cut = ends if cut is None else cut.unionByName(ends)
        if n * 64 < before:
            break
        before, gone = before - n, side(ends.select("node"), n)
        left = stored(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "left")
    # Each node's way out, by doubled steps.
    ways = stored(cut.select("node", F.array("up").alias("way")), "ways")
    for _ in range(k.bit_length()):
        further = ways.select(F.col("node").alias("last"), F.col("way").alias("further"))
        joined = ways.withColumn("last", F.element_at("way", -1)).join(side(further, reach), "last", "left")
        ways = stored(joined.select("node", F.when(F.col("further").isNull(), F.col("way")).otherwise(F.concat("way", "further")).alias("way")), "ways")
    ends = pairs.select("base", F.col("target").alias("node")).unionByName(pairs.select("base", F.col("base").alias("node"))).distinct()
    own = ends.join(side(ways, reach), "node").select("base", F.explode(F.concat(F.array("node"), "way")).alias("node")).distinct()
    return ways.select("node"), stored(own, "own")


def connected(edges: DataFrame) -> DataFrame:
    """(table_name, component): the tables of the graph; those that edges connect have the same component, the least of their names."""
    links = stored(both_ways(edges).select("a", "b").distinct(), "links")
    n = links.count()
    labels = stored(links.groupBy(F.col("a").alias("table_name")).agg(F.least("table_name", F.min("b")).alias("component")), "components")
    while True:
        near = links.join(side(labels.withColumnRenamed("table_name", "b"), n), "b").groupBy(F.col("a").alias("table_name")).agg(F.min("component").alias("near"))
        least = labels.join(side(near, n), "table_name").select("table_name", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # The label of the label: long chains are halved.
        on = least.select(F.col("table_name").alias("component"), F.col("component").alias("further"))
        labels = stored(least.join(side(on, n), "component").select("table_name", F.least("component", "further").alias("component"), "was"), "components")
        if labels.where("component <> was").isEmpty():
            return labels.select("table_name", "component")
        labels = labels.select("table_name", "component")


def _distances(steps: DataFrame, bases: DataFrame, by: str, max_hops: int | None, reach: int, ends: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """(base, node, cost, hops) of every node that a base reaches; of the nodes in `ends` only those that `own` (base, node) gives it.  reach: the tables of the graph times the bases."""
    start = F.struct(F.lit(0.0).alias("key"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(0).alias("round"))
    open_steps = steps
    if ends is not None:
        open_steps = stored(steps.select("a", "b", "step").join(side(ends.select(F.col("node").alias("b"), F.lit(True).alias("dead")), reach), "b", "left").select("a", "b", "step", F.coalesce("dead", F.lit(False)).alias("dead")), "open")
    best, n = stored(bases.select("base", F.col("base").alias("node"), start.alias("p")), "paths"), 0
    while not (fresh := best.where(F.col("p.round") == n)).isEmpty():
        n += 1
        if n % 64 == 0 and n > steps.select("a").distinct().count():
            raise ValueError("a cycle of edges has a negative cost")
        walked = fresh if max_hops is None else fresh.where(F.col("p.hops") < max_hops)
        walked = walked.join(side(open_steps, reach), F.col("node") == F.col("a"))
        if own is not None:
            walked = walked.join(side(own.select("base", F.col("node").alias("b"), F.lit(True).alias("mine")), reach), ["base", "b"], "left").where("not dead or mine")
        cost, hops = F.col("p.cost") + F.col("step"), F.col("p.hops") + 1
        key = cost if by == "cost" else hops.cast("double")
        found = walked.select("base", F.col("b").alias("node"), F.struct(key.alias("key"), cost.alias("cost"), hops.alias("hops"), F.lit(n).alias("round")).alias("p"))
        # Key, cost, hops, then the round: what is as good as before is not fresh.
        best = stored(best.unionByName(found).groupBy("base", "node").agg(F.min("p").alias("p")), "paths")
    return best.select("base", "node", F.col("p.cost").alias("cost"), F.col("p.hops").alias("hops"))


def _predecessors(best: DataFrame, steps: DataFrame, reach: int) -> DataFrame:
    """(base, node, prev): the node before each node on its best path; of equal ones that of the least node sequence.

    Sequences of equal length are compared by their ranks, one length after the other, up to the last
    length at which a node has several predecessors.
    """
    ends = best.select("base", F.col("node").alias("b"), F.col("cost").alias("end_cost"), F.col("hops").alias("end_hops"))
    met = best.join(side(steps, reach), F.col("node") == F.col("a")).join(side(ends, reach), ["base", "b"])
    tight = met.where((F.col("cost") + F.col("step") == F.col("end_cost")) & (F.col("hops") + 1 == F.col("end_hops")))
    tight = stored(tight.select("base", F.col("b").alias("node"), F.col("a").alias("prev"), F.col("end_hops").alias("hops")), "tight")
    last = tight.groupBy("base", "node").agg(F.max("hops").alias("hops"), F.count("*").alias("n")).where("n > 1").agg(F.max("hops")).first()[0] or 0
    out = tight.where(F.col("hops") > last).select("base", "node", "prev")
    ranks = None
    for length in range(1, last + 1):
        level = tight.where(F.col("hops") == length)
        level = level.withColumn("rank", F.lit(0)) if ranks is None else level.join(side(ranks.select("base", F.col("node").alias("prev"), "rank"), reach), ["base", "prev"])
        first = level.groupBy("base", "node").agg(F.min(F.struct("rank", "prev")).alias("first"))
        rank = F.row_number().over(Window.partitionBy("base").orderBy("first.rank", "node"))
        ranks = stored(first.select("base", "node", F.col("first.prev").alias("prev"), rank.alias("rank")), "ranks")
        out = out.unionByName(ranks.select("base", "node", "prev"))
    return stored(out, "back") if last else out


def find_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 5, strategy: str = "cost") -> DataFrame:
    """Cheapest paths, or the shortest ones of at most max_hops edges.  The search runs when this is called, a round at a time."""
    return paths(edges, pairs, "cost") if strategy == "cost" else paths(edges, pairs, "hops", max_hops)


def path_steps(found: DataFrame) -> DataFrame:
    """One row for each edge of a path, with its place."""
    return found.select("base", "target", F.posexplode("edges").alias("pos", "e")).select("base", "target", "pos", "e.*")


def plans(found: DataFrame, key: tuple[str, ...] = ("src_table", "dst_table", "on")) -> DataFrame:
    """(base, edges, targets, total_cost, max_hops): the union of a base's paths, each edge once, in order of first appearance.

    Paths without an edge make no plan.  Total cost is over the distinct edges.
    """
    steps = path_steps(found)
    order = Window.partitionBy("base", *key).orderBy("target", "pos")
    once = steps.withColumn("n", F.row_number().over(order)).where("n = 1")
    columns = ("src_table", "dst_table", "on", "join_type", "cardinality", "cost")
    packed = F.array_sort(F.collect_list(F.struct("target", "pos", *columns)))
    edges = once.groupBy("base").agg(packed.alias("edges"), F.sum("cost").alias("total_cost"))
    reach = found.where("hops > 0").groupBy("base").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.max("hops").alias("max_hops"))
    trimmed = F.transform("edges", lambda e: F.struct(*[e[c].alias(c) for c in columns]))
    return edges.join(reach, "base").select("base", trimmed.alias("edges"), "targets", "total_cost", "max_hops")


def joined_targets(edges: DataFrame, asked: DataFrame, max_hops: int = 5) -> DataFrame:
    """asked (query_id, base, others, ...), one row each, with targets and edges: the targets in order, edges of their paths once for each (src_table, dst_table).

    others: array of (at, target) in order, null like an empty one.  A path is searched once, whichever questions ask for it.
    Targets that cannot be reached stay, without edges; edges is null if there are none.  Paths of up to SENT edges
    go to the rows that ask, which are not shuffled; more are met by a row for each target.
    """
    wanted = asked.select("query_id", "base", F.explode("others").alias("x")).select("query_id", "base", "x.at", "x.target")
    found = find_paths(edges, wanted.select("base", "target").distinct(), max_hops).where("hops > 0")
    found = stored(found.select("base", "target", "edges"), "found")
    if (found.agg(F.sum(F.size("edges"))).first()[0] or 0) <= iteration.SENT:
        ways = found.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("target", "edges"))).alias("_ways"))
        met = asked.join(F.broadcast(ways), "base", "left").withColumn("_met", F.transform("others", lambda x: F.try_element_at("_ways", x["target"]))).drop("_ways")
    else:
        each = wanted.join(found.hint("merge"), ["base", "target"], "left")
        packed = each.groupBy("query_id", "base").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target", "edges"))), lambda x: x["edges"]).alias("_met"))
        met = asked.join(packed, ["query_id", "base"], "left")
    # array_distinct keeps the first of each; paths of one search walk one edge between two tables.
    joined = F.array_distinct(F.flatten(F.filter("_met", lambda e: e.isNotNull())))
    return met.select(*asked.columns, F.transform("others", lambda x: x["target"]).alias("targets"), F.when(F.size(joined) > 0, joined).alias("edges"))


def base_plans(edges: DataFrame, bases: DataFrame, tables: DataFrame, max_hops: int = 5) -> DataFrame:
    """(query_id, base, targets, edges): a plan of every base (query_id, base) with all other tables (query_id, table_name, place) of its question; bases without edges have none."""
    every = tables.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), F.col("table_name").alias("target")))).alias("every"))
    others = F.filter("every", lambda x: x["target"] != F.col("base"))
    asked = stored(bases.join(every, "query_id").select("query_id", "base", others.alias("others")), "asked")
    return joined_targets(edges, asked, max_hops).where("edges is not null").select("query_id", "base", "targets", "edges")


def merged_edges(plan_rows: DataFrame, key: tuple[str, ...] = ("src_table", "dst_table", "on")) -> DataFrame:
    """The distinct edges of all plans, in order of base and place: (ordinal, ...)."""
    e = plan_rows.select("base", F.posexplode("edges").alias("pos", "e")).select("base", "pos", "e.*")
    once = e.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("base", "pos"))).where("n = 1").drop("n")
    return once


def complexity(plan_rows: DataFrame) -> DataFrame:
    """(edges, max_hops, total_cost, complexity) over all plans: up to 2 edges simple, up to 5 medium."""
    out = plan_rows.agg(F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("edges"), F.coalesce(F.max("max_hops"), F.lit(0)).alias("max_hops"), F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"))
    return out.withColumn("complexity", F.when(F.col("edges") <= 2, "simple").when(F.col("edges") <= 5, "medium").otherwise("complex"))


def plan_errors():
    """Array of what is wrong with a plan row (base, edges)."""
    missing = lambda f: F.when(F.exists("edges", lambda e: F.coalesce(e[f], F.lit("")) == ""), F.lit(f"an edge lacks {f}"))
    return F.array_compact(F.array(
        F.when(F.coalesce("base", F.lit("")) == "", F.lit("base is missing")), F.when(F.col("edges").isNull(), F.lit("edges are missing")),
        missing("src_table"), missing("dst_table"), missing("on"),
    ))


def plan_text(plan_rows: DataFrame, most: int = 3) -> DataFrame:
    """(base, text) of the first plans by base."""
    line = lambda e: F.concat_ws(" ", e["join_type"], e["src_table"], F.lit("->"), e["dst_table"], F.lit("ON"), e["on"])
    head = F.concat(F.lit("base "), "base", F.lit(", cost "), F.regexp_replace(F.col("total_cost").cast("string"), r"\.0$", ""))
    return plan_rows.orderBy("base").limit(most).select("base", F.concat_ws("\n", head, F.array_join(F.transform("edges", line), "\n")).alias("text"))


def exists(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, found) for wanted ids."""
    known = nodes.select("id", F.lit(True).alias("found")).distinct()
    return wanted.join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def neighbours(edges: DataFrame, wanted: DataFrame, direction: str = "both") -> DataFrame:
    """(id, neighbour), one hop 'out', 'in' or 'both'."""
    out = edges.select(F.col("src_table").alias("id"), F.col("dst_table").alias("neighbour"))
    back = edges.select(F.col("dst_table").alias("id"), F.col("src_table").alias("neighbour"))
    every = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return every.join(wanted.select("id").distinct(), "id", "left_semi").distinct()


def statistics(edges: DataFrame) -> DataFrame:
    """(tables, relationships): an edge counts once for each of its ends."""
    return both_ways(edges).agg(F.countDistinct("a").alias("tables"), F.count("*").alias("relationships"))


def apply_plan(base: str, edges: list[dict], tables: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """The base joined along a plan's edges, and the edges that fan rows out.

    An edge is used once one end is joined.  A N:1 edge walked from its 1 side, or a 1:N
    edge from its 1 side's start, repeats rows, so sums over it need pre-aggregation.
    """
    out, joined, left, fan = tables[base], {base}, list(edges), []
    while left:
        edge = next((e for e in left if (e["src_table"] in joined) != (e["dst_table"] in joined)), None)
        if edge is None:
            # What remains links tables that are joined already, or is not connected with the base.
            loose = [e for e in left if e["src_table"] not in joined and e["dst_table"] not in joined]
            if loose:
                raise ValueError(f"not connected with {base}: {loose}")
            break
        left.remove(edge)
        forward = edge["src_table"] in joined
        new = edge["dst_table"] if forward else edge["src_table"]
        condition = F.expr(re.sub(r"\b(?:SRC|DST)\.", "", edge["on"]))
        how = {"LEFT JOIN": "left", "RIGHT JOIN": "right", "FULL JOIN": "full"}.get((edge.get("join_type") or "INNER JOIN").upper(), "inner")
        out = out.join(tables[new], condition, how)
        joined.add(new)
        if (edge.get("cardinality") or "N:1") == ("1:N" if forward else "N:1") or edge.get("cardinality") == "N:M":
            fan.append(f"{edge['src_table']} -> {edge['dst_table']}")
    return out, fan
