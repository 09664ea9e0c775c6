"""Queries of fuzzy matching; parts whose key is divisible by 50 ask, against all values."""

from pyspark.sql import functions as F

from ..functions.text import norm_text, trigram_similarity
from ..operators import matching as M
from ..sources.tables import table
from .registry import query

_NORM = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"
_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _index(spark, d):
    names = [("public.part", table(spark, d, "part"), "p_name", "p_partkey"), ("nation", table(spark, d, "nation"), "n_name", "n_nationkey"), ("region", table(spark, d, "region"), "r_name", "r_regionkey"), ("supplier", table(spark, d, "supplier"), "s_name", "s_suppkey")]
    return M.value_index(names)


_INDEX = f"""ix AS (SELECT DISTINCT * FROM (
    SELECT 'public.part' AS dim_table, 'p_name' AS dim_col, 'p_partkey' AS key_col, CAST(p_partkey AS VARCHAR) AS key_value, p_name AS value_text FROM part
    UNION ALL SELECT 'nation', 'n_name', 'n_nationkey', CAST(n_nationkey AS VARCHAR), n_name FROM nation
    UNION ALL SELECT 'region', 'r_name', 'r_regionkey', CAST(r_regionkey AS VARCHAR), r_name FROM region
    UNION ALL SELECT 'supplier', 's_name', 's_suppkey', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)),
    dims AS (SELECT *, {_NORM.format("value_text")} AS value_norm FROM ix)"""
#: Terms that ask: part names with a letter doubled.
_TERMS = "asks AS (SELECT p_partkey AS query_id, p_name || substr(p_name, length(p_name), 1) AS query_value FROM part WHERE p_partkey % 50 = 0)"


def _terms(spark, d):
    p = table(spark, d, "part").where("p_partkey % 50 = 0")
    return p.select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.substring("p_name", -1, 1)).alias("query_value"))


@query(f"SELECT value_norm, count(*) AS n FROM (SELECT {_NORM.format("lower(p_name || ' ' || p_brand || ' (É' || p_type || ')')")} AS value_norm FROM part) GROUP BY 1")
def f_norm(spark, d):
    text = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" (É"), "p_type", F.lit(")"))
    return table(spark, d, "part").groupBy(norm_text(text).alias("value_norm")).agg(F.count("*").alias("n"))


@query(f"WITH {_INDEX} SELECT * FROM dims")
def f_value_index(spark, d):
    return _index(spark, d)


@query(f"""SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS similarity
    FROM (SELECT p_partkey, {_TRI.format('p_name')} AS a, {_TRI.format('p_brand || p_type')} AS b FROM part)""")
def f_trigram_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(trigram_similarity(F.col("p_name"), F.concat("p_brand", "p_type")), 9).alias("similarity"))


_SIMILAR = f"""q AS (SELECT query_id, query_value, lower(query_value) AS q, {_TRI.format('query_value')} AS g FROM asks),
    v AS (SELECT *, {_TRI.format('value_norm')} AS h FROM dims),
    hits AS (SELECT query_id, query_value, value_text AS matched_text, dim_table, dim_col, key_col, key_value,
    len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS score FROM q, v WHERE score > 0.3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, dim_table, dim_col, matched_text, key_value) AS rank FROM hits)"""


@query(f"WITH {_INDEX}, {_TERMS}, {_SIMILAR} SELECT query_id, query_value, matched_text, dim_table, dim_col, key_col, key_value, round(score, 9) AS score, rank FROM ranked WHERE rank <= 5")
def f_similarity_topk(spark, d):
    return M.look_up(_terms(spark, d), _index(spark, d), 5, method="similarity").withColumn("score", F.round("score", 9))


#: Word similarity of the candidates: over all extents i to j of the asked text's trigrams, in order and with repeats.
_WORDED = f"""q AS (SELECT query_id, query_value, {_NORM.format('query_value')} AS q, {_TRI.format('q')} AS g, list_transform(range(1, length(q) + 2), lambda i: substr('  ' || q || ' ', i, 3)) AS y FROM asks),
    v AS (SELECT *, {_TRI.format('value_norm')} AS h FROM dims),
    cand AS (SELECT q, value_norm, any_value(y) AS y, any_value(h) AS h FROM q, v WHERE len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) > 0.3 GROUP BY ALL),
    ext AS (SELECT q, value_norm, len(h) AS n, i, unnest(range(i, len(y) + 1)) AS j, y, h FROM (SELECT *, unnest(range(1, len(y) + 1)) AS i FROM cand)),
    step AS (SELECT q, value_norm, n, i, j, list_contains(h, y[j]) AND NOT list_contains(y[i:j - 1], y[j]) AS held, NOT list_contains(y[i:j - 1], y[j]) AS fresh FROM ext),
    run AS (SELECT q, value_norm, n, count_if(held) OVER w AS shared, count_if(fresh) OVER w AS every FROM step WINDOW w AS (PARTITION BY q, value_norm, i ORDER BY j)),
    score AS (SELECT q, value_norm, max(shared / (n + every - shared)) AS score FROM run GROUP BY ALL),
    hits AS (SELECT query_id, query_value, value_text AS matched_text, dim_table, dim_col, key_col, key_value, score FROM q JOIN score USING (q) JOIN dims USING (value_norm)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, dim_table, dim_col, matched_text, key_value) AS rank FROM hits)"""


@query(f"WITH {_INDEX}, {_TERMS}, {_WORDED} SELECT query_id, query_value, matched_text, dim_table, dim_col, key_col, key_value, round(score, 9) AS score, rank FROM ranked WHERE rank <= 5")
def f_word_topk(spark, d):
    return M.look_up(_terms(spark, d), _index(spark, d), 5).withColumn("score", F.round("score", 9))


@query(f"""WITH {_INDEX}, {_TERMS}, {_SIMILAR}, good AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM ranked WHERE rank <= 6 AND score >= 0.45)
    SELECT query_id, matched_text, key_value, round(score, 9) AS score, r AS rank FROM good WHERE r <= 3""")
def f_min_score(spark, d):
    out = M.look_up(_terms(spark, d), _index(spark, d), 3, method="similarity", min_score=0.45)
    return out.select("query_id", "matched_text", "key_value", F.round("score", 9).alias("score"), "rank")


#: Matches that the order lines stand for: the order asks, its lines are the hits.
_MATCHES = """m AS (SELECT l_orderkey AS query_id, CAST(l_suppkey % 4 AS INT) AS source_index, CAST(l_partkey AS VARCHAR) AS matched_text, 'dim' || (l_suppkey % 2) AS dim_table,
    'c' || (l_partkey % 2) AS dim_col, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS key_value, l_discount * 10 AS score,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem)"""


def _matches(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 4).cast("int").alias("source_index"), F.col("l_partkey").cast("string").alias("matched_text"),
        F.concat(F.lit("dim"), F.col("l_suppkey") % 2).alias("dim_table"), F.concat(F.lit("c"), F.col("l_partkey") % 2).alias("dim_col"),
        F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("key_value"), (F.col("l_discount") * 10).alias("score"),
        F.row_number().over(order).alias("ordinal"),
    )


@query(f"WITH {_MATCHES} SELECT query_id, source_index, matched_text, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_index ORDER BY score DESC, ordinal) AS n FROM m WHERE score >= 0.2) WHERE n = 1")
def f_best(spark, d):
    return M.best(M.at_least(_matches(spark, d), 0.2)).select("query_id", "source_index", "matched_text", "ordinal")


@query(f"""WITH {_MATCHES} SELECT query_id, source_index, string_agg(matched_text, ',' ORDER BY ordinal) AS texts FROM m GROUP BY ALL""")
def f_by_source(spark, d):
    out = M.by_source(_matches(spark, d))
    return out.select("query_id", "source_index", F.array_join(F.transform("matches", lambda x: x["matched_text"]), ",").alias("texts"))


@query(f"WITH {_MATCHES} SELECT query_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY query_id, dim_table, dim_col, coalesce(nullif(key_value, ''), matched_text) ORDER BY score DESC, ordinal) AS n FROM m) WHERE n = 1")
def f_deduplicate(spark, d):
    return M.deduplicate(_matches(spark, d)).select("query_id", "ordinal")


@query("""SELECT conv_id AS query_id, CAST(turn AS INT) AS source_index, text FROM conversations WHERE role = 'user' AND trim(text) <> ''""")
def f_dimension_values(spark, d):
    return M.dimension_values(_parsed(spark, d))


def _parsed(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # A place for every turn number, so that a dimension's place is its turn.
    last = F.element_at("turns", -1)["turn"]
    at = lambda i: F.get(F.filter("turns", lambda t: t["turn"] == i), F.lit(0))
    dims = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.struct(at(i)["text"].alias("text"), F.when(at(i)["role"] == "user", "value").otherwise("column").alias("role"), F.lit("").alias("evidence")))
    return c.select("query_id", F.struct(dims.alias("dimensions")).alias("parse_result"))


@query(f"""WITH {_MATCHES}, b AS (SELECT query_id, source_index, matched_text, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_index ORDER BY score DESC, ordinal) AS n FROM m) WHERE n = 1),
    dim AS (SELECT o_orderkey AS query_id, CAST(i AS INT) AS source_index, 't' || i AS text, CASE WHEN i < 3 THEN 'value' ELSE 'column' END AS role FROM orders, (SELECT unnest(range(4)) AS i))
    SELECT query_id, string_agg(CASE WHEN role = 'value' THEN 'value=' || CASE WHEN score >= 0.4 THEN matched_text ELSE text END ELSE 'column=' || text END, ',' ORDER BY source_index) AS filters
    FROM dim LEFT JOIN b USING (query_id, source_index) GROUP BY 1""")
def f_filters(spark, d):
    dims = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("source_index"))
    dims = dims.withColumn("text", F.concat(F.lit("t"), "source_index")).withColumn("role", F.when(F.col("source_index") < 3, "value").otherwise("column"))
    return M.effective_filters(dims, _matches(spark, d)).select("query_id", F.array_join("filters", ",").alias("filters"))


@query(f"""WITH {_MATCHES} SELECT predicate, band, count(*) AS n FROM (SELECT CASE WHEN key_value <> '' THEN dim_table || '.k=''' || key_value || '''' ELSE dim_table || '.' || dim_col || ' LIKE ''%' || matched_text || '%''' END AS predicate,
    CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM m) GROUP BY ALL""")
def f_predicates(spark, d):
    predicate, band = M.suggested_predicate()
    m = _matches(spark, d).withColumn("key_col", F.lit("k"))
    return m.select(predicate.alias("predicate"), band.alias("band")).groupBy("predicate", "band").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 7 = 0 THEN 'dim_table is missing;' ELSE '' END || CASE WHEN l_quantity / 40 > 1 THEN 'score is outside 0..1;' ELSE '' END AS errors FROM lineitem""")
def f_match_errors(spark, d):
    m = table(spark, d, "lineitem").withColumn("dim_table", F.when(F.col("l_suppkey") % 7 != 0, "t")).withColumn("score", F.col("l_quantity") / 40)
    m = m.withColumn("query_value", F.lit("q")).withColumn("matched_text", F.lit("m")).withColumn("dim_col", F.lit("c"))
    joined = F.array_join(F.transform(M.match_errors(), lambda x: F.concat(x, F.lit(";"))), "")
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", joined.alias("errors"))


@query(f"WITH {_MATCHES} SELECT query_id, 'public.' || dim_table AS table_name, min(ordinal) AS ordinal FROM m GROUP BY ALL")
def f_qualified(spark, d):
    return M.qualified_tables(_matches(spark, d))


@query("""SELECT c.conv_id AS query_id, c.turn, (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = c.role) AS source_index FROM conversations c""")
def f_with_source(spark, d):
    c = table(spark, d, "conversations")
    dims = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("source_index"), F.col("role").alias("text"))
    hits = c.select(F.col("conv_id").alias("query_id"), "turn", F.col("role").alias("query_value"))
    return M.with_source(hits, dims).select("query_id", "turn", "source_index")
