"""Queries of the join graph and of dependency graphs, on graphs that the tables give.

The join graph links each nation with the suppliers' nations that it buys from most; the
dependency graphs link the turns of a conversation.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dependencies as D
from ..operators import join_graph as J
from ..operators import questions as Q
from ..sources.tables import table
from .registry import query

_TRADE = """trade AS (SELECT c.n_name AS src_table, s.n_name AS dst_table, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation c ON c.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey WHERE c.n_name <> s.n_name GROUP BY ALL),
    edges AS (SELECT src_table, dst_table, 'SRC.k = DST.k' AS "on", CAST(1 + n % 3 AS DOUBLE) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY src_table ORDER BY n DESC, dst_table) AS r FROM trade) WHERE r <= 2),
    both_ways AS (SELECT src_table AS a, dst_table AS b, cost FROM edges UNION ALL SELECT dst_table, src_table, cost FROM edges),
    steps AS (SELECT a, b, min(cost) AS cost FROM both_ways GROUP BY ALL)"""
_WALK = """walk AS (SELECT a AS base, a AS node, CAST(0 AS DOUBLE) AS cost, 0 AS hops, [a] AS nodes FROM (SELECT DISTINCT a FROM steps)
    UNION ALL SELECT base, b, walk.cost + steps.cost, hops + 1, list_append(nodes, b) FROM walk JOIN steps ON walk.node = steps.a WHERE NOT list_contains(nodes, b) AND hops < {hops}),
    best AS (SELECT base, node AS target, cost, hops, nodes FROM (SELECT *, row_number() OVER (PARTITION BY base, node ORDER BY {order}, nodes) AS r FROM walk) WHERE r = 1 AND base < node)"""


def _edges(spark, d) -> DataFrame:
    nation = table(spark, d, "nation")
    named = lambda k, name: nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(name))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    trade = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    trade = trade.where("c_nationkey <> s_nationkey").join(named("c_nationkey", "src_table"), "c_nationkey").join(named("s_nationkey", "dst_table"), "s_nationkey")
    order = Window.partitionBy("src_table").orderBy(F.desc("n"), "dst_table")
    top = trade.withColumn("r", F.row_number().over(order)).where("r <= 2")
    return top.select("src_table", "dst_table", F.lit("SRC.k = DST.k").alias("on"), F.lit(None).cast("string").alias("join_type"), F.lit("N:1").alias("cardinality"), (F.lit(1.0) + F.col("n") % 3).alias("cost"))


def _pairs(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    # 25 nations a side: the pairs that ask, not a product of data.
    return n.select(F.col("n_name").alias("base")).join(n.select(F.col("n_name").alias("target")), F.col("base") < F.col("target"))


def _nodes():
    return F.array_join("nodes", ">").alias("nodes")


@query(f"WITH RECURSIVE {_TRADE}, {_WALK.format(hops=7, order='cost, hops')} SELECT base, target, CAST(cost AS DOUBLE) AS cost, hops, array_to_string(nodes, '>') AS nodes FROM best")
def j_cheapest(spark, d):
    return J.paths(_edges(spark, d), _pairs(spark, d)).select("base", "target", "cost", "hops", _nodes())


@query(f"WITH RECURSIVE {_TRADE}, {_WALK.format(hops=3, order='hops, cost')} SELECT base, target, CAST(cost AS DOUBLE) AS cost, hops, array_to_string(nodes, '>') AS nodes FROM best")
def j_fewest_hops(spark, d):
    return J.paths(_edges(spark, d), _pairs(spark, d), "hops", 3).select("base", "target", "cost", "hops", _nodes())


_FROM_ZERO = """chosen AS (SELECT base, target, hops, nodes FROM best),
    walked AS (SELECT base, target, i, nodes[i] AS a, nodes[i + 1] AS b FROM (SELECT *, unnest(range(1, len(nodes))) AS i FROM chosen)),
    directed AS (SELECT base, target, i - 1 AS pos, src_table, dst_table, edges.cost FROM walked JOIN edges ON (src_table = a AND dst_table = b) OR (src_table = b AND dst_table = a) QUALIFY row_number() OVER (PARTITION BY base, target, i ORDER BY edges.cost, src_table) = 1),
    once AS (SELECT base, src_table, dst_table, any_value(cost) AS cost FROM directed GROUP BY ALL)"""


def _plans(spark, d):
    return J.plans(J.find_paths(_edges(spark, d), _pairs(spark, d)))


@query(f"""WITH RECURSIVE {_TRADE}, {_WALK.format(hops=7, order='cost, hops')}, {_FROM_ZERO}
    SELECT o.base, n AS edges, CAST(total AS DOUBLE) AS total_cost, max_hops, targets FROM (SELECT base, count(*) AS n, sum(cost) AS total FROM once GROUP BY 1) o
    JOIN (SELECT base, max(hops) AS max_hops, count(*) AS targets FROM chosen GROUP BY 1) c USING (base)""")
def j_plans(spark, d):
    return _plans(spark, d).select("base", F.size("edges").alias("edges"), "total_cost", "max_hops", F.size("targets").alias("targets"))


@query(f"""WITH RECURSIVE {_TRADE}, {_WALK.format(hops=7, order='cost, hops')}, {_FROM_ZERO} SELECT base, target, CAST(pos AS INT) AS pos, src_table, dst_table, cost FROM directed""")
def j_path_steps(spark, d):
    found = J.find_paths(_edges(spark, d), _pairs(spark, d))
    return J.path_steps(found).select("base", "target", "pos", "src_table", "dst_table", "cost")


@query(f"""WITH RECURSIVE {_TRADE}, {_WALK.format(hops=7, order='cost, hops')}, {_FROM_ZERO} SELECT DISTINCT src_table, dst_table FROM once""")
def j_merged_edges(spark, d):
    return J.merged_edges(_plans(spark, d)).select("src_table", "dst_table")


@query(f"""WITH RECURSIVE {_TRADE}, {_WALK.format(hops=7, order='cost, hops')}, {_FROM_ZERO}
    SELECT count(*) AS edges, (SELECT max(hops) FROM chosen) AS max_hops, CAST(sum(cost) AS DOUBLE) AS total_cost, CASE WHEN count(*) <= 2 THEN 'simple' WHEN count(*) <= 5 THEN 'medium' ELSE 'complex' END AS complexity FROM once""")
def j_complexity(spark, d):
    return J.complexity(_plans(spark, d))


@query(f"""WITH RECURSIVE {_TRADE}, {_WALK.format(hops=7, order='cost, hops')}, {_FROM_ZERO}, placed AS (SELECT base, src_table, dst_table, any_value(cost) AS cost, min((target, pos)) AS first FROM directed GROUP BY base, src_table, dst_table)
    SELECT base, 'base ' || base || ', cost ' || CAST(sum(cost) AS INT) || chr(10) || string_agg('INNER JOIN ' || src_table || ' -> ' || dst_table || ' ON SRC.k = DST.k', chr(10) ORDER BY first) AS text FROM placed GROUP BY base ORDER BY base LIMIT 3""")
def j_plan_text(spark, d):
    return J.plan_text(_plans(spark, d))


@query(f"""WITH {_TRADE} SELECT id, neighbour FROM (SELECT src_table AS id, dst_table AS neighbour FROM edges UNION SELECT dst_table, src_table FROM edges)""")
def j_neighbours(spark, d):
    return J.neighbours(_edges(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("id")))


@query(f"""WITH {_TRADE} SELECT count(DISTINCT a) AS tables, count(*) AS relationships FROM both_ways""")
def j_statistics(spark, d):
    return J.statistics(_edges(spark, d))


@query(f"""WITH {_TRADE} SELECT p_name AS id, count(b.a) > 0 AS found FROM (SELECT DISTINCT p_name FROM part UNION SELECT n_name FROM nation) LEFT JOIN (SELECT DISTINCT a FROM both_ways) b ON a = p_name GROUP BY 1""")
def j_exists(spark, d):
    nodes = J.both_ways(_edges(spark, d)).select(F.col("a").alias("id"))
    wanted = table(spark, d, "part").select(F.col("p_name").alias("id")).union(table(spark, d, "nation").select("n_name")).distinct()
    return J.exists(nodes, wanted)


@query("""SELECT l_orderkey AS base, count(*) FILTER (l_returnflag = 'A') > 0 AS lacks_src, count(*) FILTER (l_linestatus = 'F') > 0 AS lacks_on FROM lineitem GROUP BY 1""")
def j_plan_errors(spark, d):
    edge = F.struct(F.when(F.col("l_returnflag") != "A", "s").alias("src_table"), F.lit("d").alias("dst_table"), F.when(F.col("l_linestatus") != "F", "c").alias("on"))
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("base")).agg(F.collect_list(edge).alias("edges")).withColumn("errors", J.plan_errors())
    has = lambda what: F.array_contains("errors", f"an edge lacks {what}")
    return found.select(F.col("base").cast("bigint").alias("base"), has("src_table").alias("lacks_src"), has("on").alias("lacks_on"))


#: The foreign keys of the star schema.
FOREIGN_KEYS = (
    ("lineitem", "orders", "SRC.l_orderkey = DST.o_orderkey", 1.0),
    ("lineitem", "part", "SRC.l_partkey = DST.p_partkey", 1.0),
    ("lineitem", "supplier", "SRC.l_suppkey = DST.s_suppkey", 1.0),
    ("orders", "customer", "SRC.o_custkey = DST.c_custkey", 1.0),
    ("customer", "nation", "SRC.c_nationkey = DST.n_nationkey", 1.0),
    ("supplier", "nation", "SRC.s_nationkey = DST.n_nationkey", 5.0),
    ("nation", "region", "SRC.n_regionkey = DST.r_regionkey", 1.0),
)


def revenue_by_nation(spark, d, joined_by: list[dict]) -> DataFrame:
    """Top 10 nations by revenue of 1996 with growth against 1995, over a join plan."""
    names = ["lineitem", *{e["dst_table"] for e in joined_by}]
    wide, fan = J.apply_plan("lineitem", joined_by, {n: table(spark, d, n) for n in names})
    assert not fan
    start, end = F.lit("1995-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp")
    wide = wide.where(Q.in_period(F.col("o_orderdate"), start, end)).withColumn("period", Q.grain_of(F.col("o_orderdate"), "year"))
    price = F.expr("cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(4,2)))")
    yearly = Q.plain_agg(wide, ["n_name", "period"], revenue=F.sum(price).cast("double"))
    now = Q.year_over_year(yearly, "period", "revenue", ["n_name"]).where(F.year("period") == 1996)
    return Q.top_n(now.select("n_name", "revenue", "previous", "growth"), "revenue", 10, ["n_name"])


@query("""WITH y AS (SELECT n_name, year(o_orderdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL)
    SELECT a.n_name, a.revenue, b.revenue AS previous, (a.revenue - b.revenue) / nullif(b.revenue, 0) AS growth FROM y a LEFT JOIN y b ON a.n_name = b.n_name AND b.y = 1995
    WHERE a.y = 1996 ORDER BY a.revenue DESC, a.n_name LIMIT 10""")
def j_apply(spark, d):
    edges = spark.createDataFrame([(a, b, on, None, "N:1", c) for a, b, on, c in FOREIGN_KEYS], "src_table string, dst_table string, `on` string, join_type string, cardinality string, cost double")
    pair = spark.createDataFrame([("lineitem", "nation")], "base string, target string")
    # The path of one pair: a handful of edges of the schema, not of the data.
    steps = [r.asDict() for r in J.path_steps(J.paths(edges, pair)).orderBy("pos").collect()]
    return revenue_by_nation(spark, d, steps)


#: Turns as sub-queries: each needs the one before it and the third before it; in every seventh conversation the first needs the last.
_SUB = """t AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    dep AS (SELECT conv_id, turn, turn - 1 AS needs FROM t WHERE turn > 0 UNION SELECT conv_id, turn, turn - 3 FROM t WHERE turn >= 3 UNION SELECT conv_id, turn, last FROM t WHERE conv_id % 7 = 0 AND turn = 0)"""


def _sub(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    sid = lambda c: F.concat(F.col("conv_id"), F.lit("_"), c)
    needs = F.array_compact(F.array(F.when(F.col("turn") > 0, sid(F.col("turn") - 1)), F.when(F.col("turn") >= 3, sid(F.col("turn") - 3)), F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0), sid(F.col("last")))))
    status = F.when(F.col("turn") < F.col("conv_id") % 5, "completed").when(F.col("turn") % 4 == 3, "failed").when(F.col("conv_id") % 3 == 1, "in_progress").when(F.col("turn") % 2 == 0, "pending")
    return t.select(F.col("conv_id").alias("query_id"), sid(F.col("turn")).alias("sub_query_id"), F.col("text").alias("query"), status.alias("status"), needs.alias("dependencies"), "turn")


@query(f"WITH {_SUB} SELECT conv_id AS query_id, conv_id || '_' || needs AS source, conv_id || '_' || turn AS target FROM dep")
def d_edges(spark, d):
    return D.graph(_sub(spark, d))


@query("SELECT conv_id AS query_id, conv_id % 7 = 0 AS has_cycle FROM conversations GROUP BY 1, 2")
def d_cyclic(spark, d):
    return D.cyclic(_sub(spark, d))


@query("SELECT conv_id AS query_id, conv_id || '_' || turn AS sub_query_id, CASE WHEN conv_id % 7 <> 0 THEN CAST(turn AS INT) END AS level FROM conversations")
def d_levels(spark, d):
    return D.levels(_sub(spark, d))


_STATUS = f"""{_SUB}, st AS (SELECT *, CASE WHEN turn < conv_id % 5 THEN 'completed' WHEN turn % 4 = 3 THEN 'failed' WHEN conv_id % 3 = 1 THEN 'in_progress' ELSE 'pending' END AS status FROM t),
    rd AS (SELECT conv_id, turn FROM st WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM dep LEFT JOIN st s ON s.conv_id = dep.conv_id AND s.turn = dep.needs
    WHERE dep.conv_id = st.conv_id AND dep.turn = st.turn AND coalesce(s.status, '') <> 'completed'))"""


@query(f"WITH {_STATUS} SELECT conv_id AS query_id, conv_id || '_' || turn AS sub_query_id FROM rd")
def d_ready(spark, d):
    return D.ready(_sub(spark, d))


@query(f"WITH {_STATUS} SELECT conv_id AS query_id, count(*) AS total, count_if(status = 'pending') AS pending, count_if(status = 'in_progress') AS in_progress, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed FROM st GROUP BY 1")
def d_status(spark, d):
    return D.status_counts(_sub(spark, d))


@query(f"""WITH {_STATUS}, c AS (SELECT conv_id, bool_and(status IN ('completed', 'failed')) AS done, count_if(status = 'pending') AS pending, conv_id % 7 AS round FROM st GROUP BY ALL),
    a AS (SELECT c.*, CASE WHEN done THEN 'stop' WHEN round >= 5 THEN 'fail_rounds' WHEN pending > 0 AND conv_id NOT IN (SELECT conv_id FROM rd) THEN 'fail_deadlock' ELSE 'continue' END AS action FROM c)
    SELECT conv_id AS query_id, action, round + CAST(action = 'continue' AS INT) AS round FROM a""")
def d_stop_rule(spark, d):
    sub = _sub(spark, d)
    return D.stop_rule(sub, sub.select("query_id", (F.col("query_id") % 7).alias("round")).distinct())


@query(f"""WITH {_STATUS}, c AS (SELECT conv_id, bool_and(status IN ('completed', 'failed')) AS done, count_if(status = 'pending') AS pending, conv_id % 7 AS round FROM st GROUP BY ALL),
    a AS (SELECT c.*, CASE WHEN done THEN 'stop' WHEN round >= 5 THEN 'fail_rounds' WHEN pending > 0 AND conv_id NOT IN (SELECT conv_id FROM rd) THEN 'fail_deadlock' ELSE 'continue' END AS action FROM c),
    f AS (SELECT conv_id, turn, status, action = 'fail_rounds' AND status IN ('pending', 'in_progress') AS late, action = 'fail_deadlock' AND status = 'pending' AS stuck FROM st JOIN a USING (conv_id))
    SELECT conv_id AS query_id, conv_id || '_' || turn AS sub_query_id, CASE WHEN late OR stuck THEN 'failed' ELSE status END AS status, CASE WHEN late THEN '超过最大轮次 5，强制终止' WHEN stuck THEN '依赖环或孤立子查询，无法继续推进' END AS error FROM f""")
def d_stopped(spark, d):
    sub = _sub(spark, d)
    return D.stopped(sub, sub.select("query_id", (F.col("query_id") % 7).alias("round")).distinct()).select("query_id", "sub_query_id", "status", "error")


@query(f"""WITH {_SUB} SELECT c.conv_id AS query_id, c.conv_id || '_' || c.turn AS sub_query_id, coalesce(string_agg(dep.conv_id || '_' || needs || ':' || length(n.text), ',' ORDER BY dep.conv_id || '_' || needs), '') AS got
    FROM conversations c LEFT JOIN dep ON dep.conv_id = c.conv_id AND dep.turn = c.turn AND needs % 2 = 0 LEFT JOIN conversations n ON n.conv_id = dep.conv_id AND n.turn = needs GROUP BY ALL""")
def d_results(spark, d):
    sub = _sub(spark, d)
    results = sub.where("turn % 2 = 0").select("query_id", "sub_query_id", F.col("query").alias("question"), F.length("query").alias("result"))
    out = D.with_results(sub, results)
    got = F.array_join(F.transform(F.map_entries("dependency_results"), lambda e: F.concat_ws(":", e["key"], e["value"]["result"])), ",")
    return out.select("query_id", "sub_query_id", F.coalesce(got, F.lit("")).alias("got"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id AS query_id, CASE WHEN n >= 2 THEN least(n, 5) END AS kept, CASE WHEN n < 2 THEN 'too few sub-queries' END AS error,
    CASE WHEN n >= 2 THEN conv_id || '_' || (least(n, 5) - 1) END AS last_id FROM c""")
def d_shaped(spark, d):
    t = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("query"), F.array(F.lit("0")).alias("dependencies"))))
    plans = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(t.alias("sub_queries"))
    out = D.shaped(plans)
    size = F.when(F.col("sub_queries").isNotNull(), F.size("sub_queries"))
    return out.select("query_id", size.cast("bigint").alias("kept"), "error", F.element_at("sub_queries", -1)["sub_query_id"].alias("last_id"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1)
    SELECT conv_id AS query_id, CASE WHEN n = 1 THEN 'single' WHEN conv_id % 2 = 0 THEN 'final' ELSE 'all' END AS kind, CASE WHEN n = 1 OR conv_id % 2 = 0 THEN 1 ELSE n END AS n FROM c""")
def d_combined(spark, d):
    t = table(spark, d, "conversations").withColumn("every", F.collect_list("turn").over(Window.partitionBy("conv_id"))).withColumn("last", F.array_max("every"))
    others = F.transform(F.filter("every", lambda x: x != F.col("turn")), lambda x: x.cast("string"))
    final = (F.col("turn") == F.col("last")) & (F.col("conv_id") % 2 == 0)
    sub = t.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("sub_query_id"), F.length("text").alias("result"), F.when(final, others).otherwise(F.array().cast("array<string>")).alias("dependencies"))
    return D.combined(sub).select("query_id", "kind", F.col("n").cast("bigint").alias("n"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id AS query_id, CAST(last AS VARCHAR) AS sub_query_id FROM c WHERE n > 1""")
def d_final(spark, d):
    t = table(spark, d, "conversations").withColumn("every", F.collect_list(F.col("turn").cast("string")).over(Window.partitionBy("conv_id"))).withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    others = F.array_except("every", F.array(F.col("turn").cast("string")))
    deps = F.when(F.col("turn") == F.col("last"), others).otherwise(F.slice(others, 1, F.size(others) - 1))
    sub = t.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("sub_query_id"), deps.alias("dependencies"))
    return D.final_queries(sub)
