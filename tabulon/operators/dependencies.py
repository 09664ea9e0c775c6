"""Dependency graphs of sub-queries, for many questions at once.

sub: query_id, sub_query_id, query, status, dependencies ARRAY<STRING>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iteration import stored


def graph(sub: DataFrame) -> DataFrame:
    """(query_id, source, target): dependency -> dependent."""
    return sub.select("query_id", F.explode("dependencies").alias("source"), F.col("sub_query_id").alias("target"))


def levels(sub: DataFrame) -> DataFrame:
    """(query_id, sub_query_id, level): the round in which a sub-query can run, null if it never can.

    A sub-query with one dependency runs in the round after it, so chains of such ones are
    skipped by doubling their steps: a chain of n takes log n rounds.  What is left are those with none
    or several dependencies.  Of these each round resolves all whose dependencies are resolved and writes
    only the others.  What is never resolved holds or awaits a cycle, or waits for an id that does not exist.
    """
    nodes = sub.select("query_id", "sub_query_id").distinct()
    edges = graph(sub).distinct()
    edges = stored(edges.join(edges.groupBy("query_id", "target").agg(F.count("*").cast("int").alias("n")), ["query_id", "target"]), "edges")
    chained = _chains(edges.where("n = 1").select("query_id", F.col("target").alias("sub_query_id"), F.col("source").alias("root"), F.lit(1).alias("steps")))

    free = nodes.join(edges.select("query_id", F.col("target").alias("sub_query_id")).distinct(), ["query_id", "sub_query_id"], "left_anti").withColumn("level", F.lit(0))
    root = chained.withColumnRenamed("sub_query_id", "source")
    # Sub-queries with several dependencies wait for the roots of these.
    waits = edges.where("n > 1").join(root, ["query_id", "source"], "left")
    waits = waits.select("query_id", F.col("target").alias("sub_query_id"), F.coalesce("root", F.when(F.col("steps").isNull(), F.col("source"))).alias("root"), F.coalesce("steps", F.lit(0)).alias("steps"), F.lit(None).cast("int").alias("at"))
    waits, new = stored(waits, "waits"), stored(free, "levels")
    done = new
    while not new.isEmpty():
        filled = waits.join(new.select("query_id", F.col("sub_query_id").alias("root"), F.col("level").alias("found")), ["query_id", "root"], "left")
        filled = stored(filled.select("query_id", "sub_query_id", "root", "steps", F.coalesce("at", F.col("found") + F.col("steps") + 1).alias("at")), "waits")
        new = filled.groupBy("query_id", "sub_query_id").agg(F.max("at").alias("level"), F.bool_and(F.col("at").isNotNull()).alias("whole")).where("whole").drop("whole")
        new = stored(new, "levels")
        waits = filled.join(new.select("query_id", "sub_query_id"), ["query_id", "sub_query_id"], "left_anti")
        done = done.unionByName(new)
    after = chained.join(done.withColumnRenamed("sub_query_id", "root"), ["query_id", "root"]).select("query_id", "sub_query_id", (F.col("level") + F.col("steps")).alias("level"))
    return nodes.join(done.unionByName(after), ["query_id", "sub_query_id"], "left")


def _chains(steps: DataFrame) -> DataFrame:
    """(query_id, sub_query_id, root, steps): where each chain of steps ends and after how many; a null root for those that lead into a cycle."""
    jumps, most, reach = stored(steps, "chains"), 0, 1
    while True:
        on = jumps.select("query_id", F.col("sub_query_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        on = jumps.join(on, ["query_id", "root"], "left").withColumn("goes_on", F.col("more").isNotNull())
        doubled = stored(on.select("query_id", "sub_query_id", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "goes_on"), "chains")
        if doubled.where("goes_on").isEmpty():
            return jumps
        most = most or jumps.groupBy("query_id").count().agg(F.max("count")).first()[0]
        if reach > most:
            # More steps than sub-queries: what still goes on is in a cycle or leads into one.
            return doubled.select("query_id", "sub_query_id", F.when(~F.col("goes_on"), F.col("root")).alias("root"), "steps")
        jumps, reach = doubled.drop("goes_on"), 2 * reach


def cyclic(sub: DataFrame) -> DataFrame:
    """(query_id, has_cycle); dependencies on ids that do not exist are no cycle, a self-loop is one."""
    nodes = sub.select("query_id", "sub_query_id")
    known = sub.select("query_id", "sub_query_id", F.explode_outer("dependencies").alias("d")).join(nodes.select("query_id", F.col("sub_query_id").alias("d"), F.lit(True).alias("known")), ["query_id", "d"], "left")
    kept = known.groupBy("query_id", "sub_query_id").agg(F.collect_set(F.when(F.col("known"), F.col("d"))).alias("dependencies"))
    return levels(kept).groupBy("query_id").agg(F.bool_or(F.col("level").isNull()).alias("has_cycle"))


def with_status(sub: DataFrame) -> DataFrame:
    return sub.withColumn("status", F.coalesce("status", F.lit("pending")))


def ready(sub: DataFrame) -> DataFrame:
    """(query_id, sub_query_id): pending ones whose dependencies are all completed."""
    sub = with_status(sub)
    state = sub.select("query_id", F.col("sub_query_id").alias("source"), F.col("status").alias("of"))
    waits = graph(sub).join(state, ["query_id", "source"], "left").where("coalesce(of, '') <> 'completed'").select("query_id", F.col("target").alias("sub_query_id"))
    return sub.where("status = 'pending'").select("query_id", "sub_query_id").join(waits, ["query_id", "sub_query_id"], "left_anti")


def with_results(sub: DataFrame, results: DataFrame) -> DataFrame:
    """Sub-queries with a map id -> (question, result) of the dependencies that have results, marked in_progress."""
    r = results.select("query_id", F.col("sub_query_id").alias("source"), F.struct("question", "result").alias("r"))
    maps = graph(sub).join(r, ["query_id", "source"]).groupBy("query_id", F.col("target").alias("sub_query_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "r")))).alias("dependency_results"))
    return sub.join(maps, ["query_id", "sub_query_id"], "left").withColumn("status", F.lit("in_progress"))


def status_counts(sub: DataFrame) -> DataFrame:
    s = F.col("status")
    return with_status(sub).groupBy("query_id").agg(F.count("*").alias("total"), *[F.count_if(s == v).alias(v) for v in ("pending", "in_progress", "completed", "failed")])


def stop_rule(sub: DataFrame, rounds: DataFrame, max_rounds: int = 5) -> DataFrame:
    """(query_id, action, round) in this order: all done, rounds used up, some pending and none of them ready, next round.

    rounds: (query_id, round).
    """
    can = ready(sub).groupBy("query_id").agg(F.count("*").alias("ready"))
    out = status_counts(sub).join(rounds, "query_id").join(can, "query_id", "left")
    done = F.col("completed") + F.col("failed") == F.col("total")
    action = F.when(done, "stop").when(F.col("round") >= max_rounds, "fail_rounds").when((F.col("pending") > 0) & (F.coalesce("ready", F.lit(0)) == 0), "fail_deadlock").otherwise("continue")
    return out.select("query_id", action.alias("action"), F.when(action == "continue", F.col("round") + 1).otherwise(F.col("round")).alias("round"))


#: What is said of sub-queries that the stop rule ends.
ENDED = {"fail_rounds": "超过最大轮次 {rounds}，强制终止", "fail_deadlock": "依赖环或孤立子查询，无法继续推进"}


def stopped(sub: DataFrame, rounds: DataFrame, max_rounds: int = 5) -> DataFrame:
    """sub with the status and error that the stop rule gives: used-up rounds fail all that is not done, a deadlock all that is pending."""
    out = with_status(sub).join(stop_rule(sub, rounds, max_rounds).select("query_id", "action"), "query_id", "left")
    over = (F.col("action") == "fail_rounds") & F.col("status").isin("pending", "in_progress")
    stuck = (F.col("action") == "fail_deadlock") & (F.col("status") == "pending")
    error = F.col("error") if "error" in sub.columns else F.lit(None).cast("string")
    error = F.when(over, ENDED["fail_rounds"].format(rounds=max_rounds)).when(stuck, ENDED["fail_deadlock"]).otherwise(error)
    return out.withColumn("error", error).withColumn("status", F.when(over | stuck, "failed").otherwise(F.col("status"))).drop("action")


def shaped(plans: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """plans (query_id, sub_queries ARRAY<STRUCT<id, query, dependencies>>) -> the first `most`, ids prefixed; fewer than `least` is an error."""
    pre = lambda x: F.concat("query_id", F.lit("_"), x)
    cut = F.slice("sub_queries", 1, most)
    out = F.transform(cut, lambda s: F.struct(pre(s["id"]).alias("sub_query_id"), s["query"].alias("query"), F.transform(s["dependencies"], pre).alias("dependencies")))
    return plans.select("query_id", F.when(F.size("sub_queries") >= least, out).alias("sub_queries"), F.when(F.size("sub_queries") < least, "too few sub-queries").alias("error"))


def final_queries(sub: DataFrame) -> DataFrame:
    """(query_id, sub_query_id) that depend on all others of their question."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return sub.withColumn("_n", n).where((F.size("dependencies") == F.col("_n") - 1) & (F.col("_n") > 1)).select("query_id", "sub_query_id")


def combined(sub: DataFrame) -> DataFrame:
    """(query_id, kind, results, n): the one result, the final query's, or all in order of id; sub has a result column."""
    total = sub.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("sub_query_id", "result"))).alias("every"))
    last = final_queries(sub).join(sub, ["query_id", "sub_query_id"]).groupBy("query_id").agg(F.min(F.struct("sub_query_id", "result")).alias("last"))
    out = total.join(last, "query_id", "left")
    kind = F.when(F.col("n") == 1, "single").when(F.col("last").isNotNull(), "final").otherwise("all")
    results = F.when(kind == "final", F.array("last.result")).otherwise(F.transform("every", lambda x: x["result"]))
    return out.select("query_id", kind.alias("kind"), results.alias("results"), F.size(results).alias("n"))
