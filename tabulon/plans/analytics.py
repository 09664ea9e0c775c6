"""Queries of the analytical question operators over the star schema."""

from pyspark.sql import functions as F

from ..operators import questions as Q
from ..sources.tables import table
from .registry import query

PRICE = "cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(4,2)))"


def money(name):
    return F.col(name).cast("decimal(15,2)")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS sum_qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
    min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS lines FROM lineitem GROUP BY ALL""")
def a_plain_agg(spark, d):
    return Q.plain_agg(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"],
        sum_qty=F.sum(money("l_quantity")).cast("double"), revenue=F.sum(F.expr(PRICE)).cast("double"), min_tax=F.min("l_tax"), max_tax=F.max("l_tax"), lines=F.count("*"),
    )


@query("""SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1
    ORDER BY spent DESC, o_custkey LIMIT 10""")
def a_topn(spark, d):
    return Q.top_n(Q.plain_agg(table(spark, d, "orders"), ["o_custkey"], spent=F.sum(money("o_totalprice")).cast("double")), "spent", 10, ["o_custkey"])


@query("""SELECT c_mktsegment, n_name, n, rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC) AS rank,
    dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC) AS place
    FROM (SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""")
def a_rank(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ranked = Q.rank_by(Q.plain_agg(c, ["c_mktsegment", "n_name"], n=F.count("*")), "n", ["c_mktsegment"])
    return Q.rank_by(ranked.withColumnRenamed("rank", "first_rank"), "n", ["c_mktsegment"], dense=True).withColumnsRenamed({"rank": "place", "first_rank": "rank"})


_PERIODS = """WITH p AS (SELECT date_trunc('{grain}', o_orderdate) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total FROM orders GROUP BY 1)
    SELECT CAST(a.period AS TIMESTAMP) AS period, a.total, b.total AS previous, (a.total - b.total) / nullif(b.total, 0) AS growth
    FROM p a LEFT JOIN p b ON CAST(b.period AS TIMESTAMP) = CAST(a.period AS TIMESTAMP) - INTERVAL {step}"""


def _periods(spark, d, grain):
    o = table(spark, d, "orders").withColumn("period", Q.grain_of(F.col("o_orderdate"), grain))
    return Q.plain_agg(o, ["period"], total=F.sum(money("o_totalprice")).cast("double"))


@query(_PERIODS.format(grain="year", step="1 year"))
def a_yoy(spark, d):
    return Q.year_over_year(_periods(spark, d, "year"), "period", "total")


@query(_PERIODS.format(grain="month", step="1 month"))
def a_mom(spark, d):
    return Q.month_over_month(_periods(spark, d, "month"), "period", "total")


@query("""SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def a_grain(spark, d):
    e = table(spark, d, "events").withColumn("week", Q.grain_of(F.col("ts"), "week")).withColumn("hour", Q.grain_of(F.col("ts"), "hour"))
    return Q.plain_agg(e, ["week", "hour", "event_type"], n=F.count("*"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def a_half_open(spark, d):
    start, end = F.lit("1996-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp")
    return Q.plain_agg(table(spark, d, "orders").where(Q.in_period(F.col("o_orderdate"), start, end)), ["o_orderpriority"], n=F.count("*"))


@query("""SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-04-01' AND o_orderdate < TIMESTAMP '1996-10-01' GROUP BY 1""")
def a_full_period(spark, d):
    start, end = Q.full_period(F.lit("1996-05-17").cast("timestamp"), F.lit("1996-09-30").cast("timestamp"), "quarter")
    return Q.plain_agg(table(spark, d, "orders").where(Q.in_period(F.col("o_orderdate"), start, end)), ["o_orderstatus"], n=F.count("*"))


@query("""WITH s AS (SELECT o_custkey, sum(CASE WHEN year(o_orderdate) = 1995 THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS base,
    sum(CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS current FROM orders GROUP BY 1)
    SELECT o_custkey, CAST(base AS DOUBLE) AS base, CAST(current AS DOUBLE) AS current,
    (CAST(current AS DOUBLE) - CAST(base AS DOUBLE)) / nullif(CAST(base AS DOUBLE), 0) AS growth FROM s""")
def a_growth(spark, d):
    year = F.year("o_orderdate")
    out = Q.growth_between(table(spark, d, "orders"), ["o_custkey"], money("o_totalprice"), year == 1995, year == 1996)
    return out.withColumn("base", F.col("base").cast("double")).withColumn("current", F.col("current").cast("double"))


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 15)""")
def a_dependent(spark, d):
    first = Q.plain_agg(table(spark, d, "orders"), ["o_custkey"], n=F.count("*")).where("n >= 15").withColumnRenamed("o_custkey", "c_custkey")
    return Q.dependent(table(spark, d, "customer"), first, ["c_custkey"]).select("c_custkey", "c_name", "c_mktsegment")


@query("""WITH f AS (SELECT p_brand AS v, CASE WHEN count(*) % 2 = 0 THEN 0.9 ELSE 0.6 END AS score FROM part GROUP BY 1)
    SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT v FROM f WHERE score >= 0.8) OR EXISTS (SELECT 1 FROM f WHERE score < 0.8 AND contains(p_brand, v))""")
def a_predicates(spark, d):
    parts = table(spark, d, "part")
    filters = parts.groupBy(F.col("p_brand").alias("value")).agg(F.when(F.count("*") % 2 == 0, 0.9).otherwise(0.6).alias("score"))
    return Q.matching(parts, filters, "p_brand").select("p_partkey", "p_brand")


_UNION = """WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000)
    SELECT c_mktsegment AS label, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN big ON c_custkey = o_custkey GROUP BY 1
    UNION SELECT r_name AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""


@query(_UNION)
def a_sql_surface(spark, d):
    for name in ("orders", "customer", "nation", "region"):
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(_UNION)
