"""Queries of conversations, SQL audits and operational tables."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import conversations as C
from ..operators import operations as O
from ..operators import sql_audit as S
from ..operators.iteration import scratch, stored
from ..sources.tables import table
from .registry import query

#: A conversation's user turns with the turn that follows each; threads of one user every ten conversations.
_TURNS = r"""tt AS (SELECT conv_id, turn, text, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
    turns AS (SELECT 'user' || (conv_id % 10) || ':' || strftime(TIMESTAMP '2024-01-01' + INTERVAL (conv_id) HOUR, '%Y%m%dT%H%M%S') || '000Z' AS thread_id, 'q' || turn AS query_id,
    text AS question, CASE WHEN next_role = 'assistant' THEN answer ELSE '' END AS answer, turn % 3 <> 2 AS success, turn FROM tt WHERE role = 'user')"""


def _turns(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w)).where("role = 'user'")
    made = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("conv_id").cast("int"))
    at = made + F.make_interval(mins=F.col("turn").cast("int"))
    return t.select(
        C.thread_id(F.concat(F.lit("user"), F.col("conv_id") % 10), made).alias("thread_id"), F.concat(F.lit("q"), "turn").alias("query_id"), F.col("text").alias("question"),
        F.when(F.col("next_role") == "assistant", F.col("answer")).otherwise("").alias("answer"), (F.col("turn") % 3 != 2).alias("success"), at.alias("created_at"), at.alias("updated_at"), "turn",
    )


_STRIP = r"regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')"
_CUT = "CASE WHEN length({0}) > 40 THEN left({0}, 37) || '...' ELSE {0} END"


@query(f"""WITH {_TURNS}, n AS (SELECT * REPLACE ({_STRIP.format('question')} AS question, {_STRIP.format('answer')} AS answer), row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC, query_id DESC) AS r FROM turns),
    good AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) AS g FROM n WHERE r <= 6 AND success AND question <> '' AND answer <> '')
    SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS place, {_CUT.format('question')} AS question, {_CUT.format('answer')} AS answer FROM good WHERE g <= 3""")
def s_recent_turns(spark, d):
    return C.recent_turns(_turns(spark, d), 3, 40)


@query(f"""WITH {_TURNS}, th AS (SELECT split_part(thread_id, ':', 1) AS user_id, thread_id, arg_min(question, turn) AS first_question FROM turns GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY thread_id DESC) AS place FROM th) WHERE place <= 5""")
def s_sessions(spark, d):
    return C.recent_sessions(_turns(spark, d))


_IDS = r"""ids AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bad user!' WHEN 1 THEN 'u_' || user_id ELSE 'user' || user_id END AS user_id,
    CASE event_id % 5 WHEN 0 THEN 'bad user!' WHEN 1 THEN 'u_' || user_id ELSE 'user' || user_id END || ':' || strftime(ts, '%Y%m%dT%H%M%S') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Z' END AS thread_id, ts FROM events)"""


def _ids(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    user = F.when(F.col("event_id") % 5 == 0, "bad user!").when(F.col("event_id") % 5 == 1, F.concat(F.lit("u_"), "user_id")).otherwise(F.concat(F.lit("user"), "user_id"))
    e = e.withColumn("user_id", user)
    end = F.when(F.col("event_id") % 7 == 0, "").otherwise("Z")
    return e.select("event_id", "user_id", F.concat("user_id", F.lit(":"), F.date_format("ts", "yyyyMMdd'T'HHmmssSSS"), end).alias("thread_id"), "ts")


_OK = "regexp_full_match(thread_id, '[A-Za-z0-9_-]{1,64}:[0-9]{8}T[0-9]{9}Z')"


@query(f"""WITH {_IDS} SELECT event_id, {_OK} AS valid, CASE WHEN {_OK} THEN split_part(thread_id, ':', 1) ELSE 'guest' END AS user, CASE WHEN {_OK} THEN CAST(date_trunc('millisecond', ts) AS TIMESTAMP) END AS at,
    CASE WHEN event_id % 5 = 0 THEN 'guest' ELSE user_id END AS safe FROM ids""")
def s_thread_ids(spark, d):
    t = F.col("thread_id")
    return _ids(spark, d).select("event_id", C.valid_thread(t).alias("valid"), C.thread_user(t).alias("user"), C.thread_time(t).alias("at"), C.safe_user(F.col("user_id")).alias("safe"))


@query(f"""WITH {_IDS} SELECT event_id, CASE WHEN {_OK} THEN thread_id END AS thread_id, CASE WHEN {_OK} THEN 'q' || event_id END AS query_id FROM ids""")
def s_store_keys(spark, d):
    thread, q = C.parse_store_key(F.concat("thread_id", F.lit("#q"), "event_id"))
    return _ids(spark, d).select("event_id", thread.alias("thread_id"), q.alias("query_id"))


@query(f"""WITH {_IDS}, moved AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 = 0 THEN 'other' || substr(thread_id, strpos(thread_id, ':')) ELSE thread_id END AS thread_id FROM ids)
    SELECT event_id, CASE WHEN {_OK} THEN thread_id ELSE CASE WHEN event_id % 5 = 0 THEN 'guest' ELSE user_id END || ':' || strftime(ts, '%Y%m%dT%H%M%S') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' END AS thread_id,
    CASE WHEN {_OK} THEN split_part(thread_id, ':', 1) WHEN event_id % 5 = 0 THEN 'guest' ELSE user_id END AS user_id, {_OK} AND split_part(thread_id, ':', 1) <> user_id AS mismatch FROM moved""")
def s_reconciled(spark, d):
    thread, user, mismatch = C.reconciled(F.col("thread_id"), F.col("user_id"), F.col("ts"))
    other = F.concat(F.lit("other"), F.expr("substr(thread_id, instr(thread_id, ':'))"))
    return _ids(spark, d).withColumn("thread_id", F.when(F.col("event_id") % 11 == 0, other).otherwise(F.col("thread_id"))).select("event_id", thread.alias("thread_id"), user.alias("user_id"), mismatch.alias("mismatch"))


@query("SELECT doc_id, CASE WHEN length(text) > 30 THEN left(text, 27) || '...' ELSE coalesce(text, '') END AS text FROM documents")
def s_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", C.truncate_text(F.col("text"), 30).alias("text"))


@query(f"""WITH {_TURNS} SELECT thread_id, string_agg(n || '. Q: ' || question || chr(10) || '   A: ' || answer, chr(10) ORDER BY turn) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS n FROM turns WHERE trim(question) <> '' AND trim(answer) <> '') GROUP BY 1""")
def s_history_text(spark, d):
    t = _turns(spark, d).select("thread_id", F.col("turn").alias("place"), "question", "answer")
    return C.history_text(t)


@query("SELECT user_id AS thread_id, event_type AS query_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY ALL")
def s_turn_rows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("query_id"), "event_id", F.col("props").alias("question"), F.lit("a").alias("answer"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return C.turn_rows(e).select("thread_id", "query_id", "event_id")


def _event_turns(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("query_id"), "event_id", F.col("props").alias("question"), F.lit("a").alias("answer"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


@query("""WITH one AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events WHERE event_id % 3 <> 0 GROUP BY ALL), two AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events WHERE event_id % 3 <> 1 GROUP BY ALL)
    SELECT user_id AS thread_id, event_type AS query_id, CASE WHEN one.ts IS NULL OR two.ts >= one.ts THEN two.event_id ELSE one.event_id END AS event_id, coalesce(one.ts, two.ts) AS created_at, greatest(one.ts, two.ts) AS updated_at,
        strftime(coalesce(one.ts, two.ts), '%Y-%m-%d') AS day FROM one FULL JOIN two USING (user_id, event_type)""")
def s_upserted_turns(spark, d):
    """Two runs whose keys overlap, into one table."""
    folder, turns = scratch(spark, "turns"), _event_turns(spark, d)
    for part in ("event_id % 3 <> 0", "event_id % 3 <> 1"):
        C.write_turns(turns.where(part), folder)
    return C.stored_turns(spark, folder).select("thread_id", "query_id", "event_id", "created_at", "updated_at", F.col("day").cast("string").alias("day"))


@query("""WITH t AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY ALL)
    SELECT user_id AS thread_id, event_type AS query_id, event_id FROM t WHERE ts >= (SELECT date_trunc('day', quantile_disc(ts, 0.5)) + INTERVAL 10 HOUR FROM t)""")
def s_retention(spark, d):
    """Days before the middle one go, and the morning of that day."""
    folder = scratch(spark, "turns")
    C.write_turns(_event_turns(spark, d), folder)
    turns = C.stored_turns(spark, folder)
    n = turns.count()
    middle = turns.groupBy("created_at").count().withColumn("run", F.sum("count").over(Window.orderBy("created_at"))).where(F.col("run") >= F.ceil(F.lit(n * 0.5))).agg(F.date_trunc("day", F.min("created_at")).alias("at")).select(F.date_format("at", "yyyy-MM-dd")).first()[0]
    C.retain(spark, folder, datetime.fromisoformat(middle) + timedelta(days=90, hours=10), 90)
    return C.stored_turns(spark, folder).select("thread_id", "query_id", "event_id")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def s_succeeded_retained(spark, d):
    e = table(spark, d, "events").withColumn("query_id", F.col("user_id")).withColumn("created_at", F.col("ts"))
    log = e.select("query_id", ((F.col("event_type") == "purchase") & (F.col("value") > 90)).alias("success"))
    return C.retained(C.succeeded(e, log), F.lit("2024-04-19").cast("timestamp"), 90).groupBy("user_id").agg(F.count("*").alias("n"))


#: SQL text that the events stand for.
_TEXT = r"""sqls AS (SELECT event_id, user_id, event_type, CASE event_id % 10 WHEN 0 THEN 'SELECT * FROM ' || event_type || ' JOIN u' || user_id || ' ON 1 = 1' WHEN 1 THEN 'with a as (select 1) select * from a' WHEN 2 THEN 'DROP TABLE ' || event_type
    WHEN 3 THEN 'SELECT created_at, deleted_flag FROM ' || event_type WHEN 4 THEN 'SELECT 1; SELECT 2' WHEN 5 THEN 'SELECT 1 -- note' WHEN 6 THEN 'select 1 /* x */ from t; ' WHEN 7 THEN '  ' WHEN 8 THEN 'with d as (update t set x = 1) insert into x select * from ' || event_type || ' truncate' ELSE 'SELECT ''update'' FROM s.' || event_type END AS sql FROM events)"""


def _texts(spark, d) -> DataFrame:
    e, k, t = table(spark, d, "events"), F.col("event_id") % 10, F.col("event_type")
    sql = (
        F.when(k == 0, F.concat(F.lit("SELECT * FROM "), t, F.lit(" JOIN u"), "user_id", F.lit(" ON 1 = 1"))).when(k == 1, "with a as (select 1) select * from a").when(k == 2, F.concat(F.lit("DROP TABLE "), t))
        .when(k == 3, F.concat(F.lit("SELECT created_at, deleted_flag FROM "), t)).when(k == 4, "SELECT 1; SELECT 2").when(k == 5, "SELECT 1 -- note").when(k == 6, "select 1 /* x */ from t; ").when(k == 7, "  ")
        .when(k == 8, F.concat(F.lit("with d as (update t set x = 1) insert into x select * from "), t, F.lit(" truncate"))).otherwise(F.concat(F.lit("SELECT 'update' FROM s."), t))
    )
    return e.select("event_id", "user_id", "event_type", "value", sql.alias("sql"))


_VERDICT = f"""{_TEXT}, a AS (SELECT *, len(list_filter(string_split(sql, ';'), lambda s: trim(s) <> '')) AS n FROM sqls),
    b AS (SELECT *, CASE WHEN n = 0 THEN ['no statement'] WHEN n > 1 THEN ['more than one statement'] ELSE [] END AS syn,
    list_concat(list_concat(CASE WHEN regexp_extract(upper(sql), '^\\s*(\\w+)', 1) IN ('DROP','DELETE','INSERT','UPDATE','TRUNCATE','ALTER','CREATE','GRANT','REVOKE','EXECUTE','EXEC') THEN ['statement type ' || regexp_extract(upper(sql), '^\\s*(\\w+)', 1)] ELSE [] END,
    list_transform(list_filter(['DROP','DELETE','TRUNCATE','ALTER','CREATE','INSERT','UPDATE','GRANT','REVOKE','EXEC','EXECUTE'], lambda w: regexp_matches(upper(sql), '\\b' || w || '\\b')), lambda w: 'forbidden word ' || w)),
    CASE WHEN contains(sql, '--') OR contains(sql, '/*') THEN ['comment'] ELSE [] END) AS sec FROM a),
    v AS (SELECT *, CASE WHEN len(syn) > 0 THEN 'syntax' WHEN len(sec) > 0 THEN 'security' ELSE 'all_passed' END AS layer, CASE WHEN len(syn) > 0 THEN syn ELSE sec END AS errors FROM b)"""


@query(f"WITH {_VERDICT} SELECT event_id, layer, layer = 'all_passed' AS valid, array_to_string(errors, '|') AS errors FROM v")
def q_verdict(spark, d):
    return S.verdict(_texts(spark, d)).select("event_id", "layer", "valid", F.array_join("errors", "|").alias("errors"))


@query(f"""WITH {_VERDICT}, x AS (SELECT *, layer = 'all_passed' AND user_id % 3 = 0 AS lost FROM v)
    SELECT event_id, CASE WHEN lost THEN 'semantic' ELSE layer END AS layer, CASE WHEN lost THEN 'no such table' ELSE array_to_string(errors, '|') END AS errors, CASE WHEN layer <> 'all_passed' THEN '' WHEN user_id % 2 = 0 THEN 'sequential scan' ELSE 'about 200000 rows' END AS warnings FROM x""")
def q_layers(spark, d):
    t = _texts(spark, d).withColumn("plan", F.when(F.col("user_id") % 2 == 0, "Seq Scan on t").otherwise("Index Scan (rows=200000)")).withColumn("plan_error", F.when(F.col("user_id") % 3 == 0, "no such table"))
    return S.verdict(t, plan="plan", plan_error="plan_error").select("event_id", "layer", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query(f"""WITH {_VERDICT} SELECT event_id, CASE WHEN layer <> 'all_passed' THEN 'validation_' || layer || '_failed' END AS error_type, CASE WHEN layer <> 'all_passed' THEN errors[1] END AS message,
    CASE WHEN layer = 'all_passed' THEN 'valid' ELSE 'failed at ' || layer || ': ' || array_to_string(errors, '; ') END AS summary FROM v""")
def q_error_types(spark, d):
    v = S.verdict(_texts(spark, d))
    kind, message = S.error_type(F.col("layer"), F.col("errors"))
    return v.select("event_id", kind.alias("error_type"), message.alias("message"), S.summary(F.col("valid"), F.col("layer"), F.col("errors")).alias("summary"))


@query(f"""WITH {_TEXT} SELECT name, count(*) AS n FROM (SELECT unnest(CASE event_id % 10 WHEN 0 THEN [event_type, 'u' || user_id] WHEN 1 THEN ['a'] WHEN 6 THEN ['t'] WHEN 9 THEN ['s.' || event_type] WHEN 3 THEN [event_type] WHEN 8 THEN [event_type] ELSE [] END) AS name FROM sqls) GROUP BY 1""")
def q_tables_used(spark, d):
    return _texts(spark, d).select(F.explode(S.tables_used(F.col("sql"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


#: Statements with literals, comments and nested queries: text (% stands for the event's type), number of statements, tables.
_SHAPES = (
    ("SELECT ';' AS x", 1, ""), ("SELECT 'it''s; from a' FROM %;", 1, "%"), ("SELECT 1 FROM %; SELECT 2 FROM u", 2, "%,u"), ("SELECT 1; -- done; from b", 1, ""), ("SELECT 1 FROM % /* ; from c */ JOIN s.t ON true", 1, "%,s.t"),
    ('SELECT "a;b" FROM "my %"', 1, '"my %"'), ("SELECT extract(year FROM ts) FROM %", 1, "%"), ("SELECT * FROM a, % AS x, (SELECT 1 FROM c WHERE d IN (SELECT e FROM f)) g, h WHERE i = 'from z'", 1, "a,%,c,f,h"),
    ("WITH d AS (SELECT * FROM %) SELECT trim(both ' ' from x) FROM d ORDER BY a, b", 1, "%,d"), ("SELECT a IS DISTINCT FROM b FROM %", 1, "%"), ("SELECT 1 FROM generate_series(1, 2) g JOIN (% JOIN b ON 1 = 1) ON true", 1, "%,b"),
    ("SELECT (1; 2); ;", 2, ""), ("", 0, ""),
)


@query(f"""SELECT event_id, CAST({list(x[1] for x in _SHAPES)}[event_id % {len(_SHAPES)} + 1] AS INT) AS statements, replace({list(x[2] for x in _SHAPES)}[event_id % {len(_SHAPES)} + 1], '%', event_type) AS tables FROM events""")
def q_shapes(spark, d):
    text = F.replace(F.get(F.array(*[F.lit(x[0]) for x in _SHAPES]), (F.col("event_id") % len(_SHAPES)).cast("int")), F.lit("%"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.statements(text).alias("statements"), F.array_join(S.tables_used(text), ",").alias("tables"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'sequential scan;' ELSE '' END || CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 1 THEN 'nested loop;' ELSE '' END ||
    CASE WHEN l_partkey * 100 > 100000 THEN 'about ' || l_partkey * 100 || ' rows;' ELSE '' END AS warnings FROM lineitem""")
def q_plan_warnings(spark, d):
    plan = F.concat(F.when(F.col("l_returnflag") == "A", "Seq Scan on t").otherwise("Index Scan"), F.when(F.col("l_linestatus") == "F", " Nested Loop").otherwise(""), F.lit(" (rows="), F.col("l_partkey") * 100, F.lit(" width=4)"))
    sql = F.when(F.col("l_linenumber") % 2 == 1, "select 1").otherwise("select 1 from a join b")
    found = F.array_join(F.transform(S.plan_warnings(plan, sql), lambda x: F.concat(x, F.lit(";"))), "")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found.alias("warnings"))


@query("""SELECT event_id, ['table_not_found', 'column_not_found', 'column_not_found', 'table_not_found', 'out_of_range', 'out_of_range', 'connection_error', 'connection_error', 'permission_error', 'permission_error', 'unknown_error', 'unknown_error'][event_id % 12 + 1] AS kind, event_id % 12 < 6 AS recoverable FROM events""")
def q_classified(spark, d):
    said = ('Table "{}" does not exist', 'relation "{}" does not exist', "Unknown column {}", "unknown table {}", "{} is OUT OF RANGE", "invalid date: {}", "Connection to {} lost", "{} timeout", "permission denied for {}", "Access denied: {}", "denied {}", "{}!")
    message = F.element_at(F.array(*[F.format_string(s.replace("{}", "%s"), F.col("event_type")) for s in said]), (F.col("event_id") % 12 + 1).cast("int"))
    kind, mends = S.classified(message)
    return table(spark, d, "events").select("event_id", kind.alias("kind"), mends.alias("recoverable"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_custkey % 5 = 0 THEN 'fail' WHEN o_orderkey % 4 < 3 THEN 'retry' ELSE 'fail' END AS outcome, o_orderstatus = 'F' AS success,
    CASE WHEN o_orderstatus <> 'F' THEN 'error at ' || CASE WHEN o_custkey % 5 = 0 THEN 'generation' ELSE 'validation' END || ' after ' || (o_orderkey % 4) || ' tries: ' || o_orderpriority END AS summary FROM orders""")
def q_outcomes(spark, d):
    step = F.when(F.col("o_custkey") % 5 == 0, "generation").otherwise("validation")
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "select 1").alias("validated_sql"), step.alias("failed_step"), (F.col("o_orderkey") % 4).cast("int").alias("iteration"), F.lit(None).cast("string").alias("error_type"), F.col("o_orderpriority").alias("error"))
    return S.output(o).select("o_orderkey", S.outcome(F.col("validated_sql"), F.col("failed_step"), F.col("iteration")).alias("outcome"), "success", "summary")


@query("SELECT l_orderkey, max(l_linenumber) AS iteration, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def q_latest(spark, d):
    return S.latest(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("iteration"), "l_partkey"), ["l_orderkey"])


@query("SELECT least(count(*), 10000) AS n FROM lineitem")
def q_capped(spark, d):
    return S.capped(table(spark, d, "lineitem")).agg(F.count("*").alias("n"))


@query()
def q_execution_log(spark, d):
    """Runs one counting statement for each table: timings differ, so there is no SQL for the result."""
    names = ("lineitem", "orders", "customer", "no_such_table")
    for n in names[:3]:
        table(spark, d, n).createOrReplaceTempView(n)
    return S.execute_all(spark, [f"SELECT * FROM {n}" for n in names])


def _views(spark, d, *names):
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)


@query("""SELECT 'SELECT * FROM lineitem' AS sql, true AS success, count(*) AS row_count, 1 AS runs FROM lineitem UNION ALL SELECT 'SELECT * FROM orders WHERE o_custkey % 2 = 0', true, count(*), 1 FROM orders WHERE o_custkey % 2 = 0
    UNION ALL SELECT 'SELECT no_column FROM orders', false, 0, 1 UNION ALL SELECT 'SELECT DISTINCT c_nationkey FROM customer', true, count(DISTINCT c_nationkey), 2 FROM customer""")
def q_resumed(spark, d):
    """Two runs into one log: the second executes only the statement that the first did not have."""
    _views(spark, d, "lineitem", "orders", "customer")
    asked, log = ["SELECT * FROM lineitem", "SELECT * FROM orders WHERE o_custkey % 2 = 0", "SELECT no_column FROM orders"], scratch(spark, "log")
    S.resume(spark, asked, log, pool="audit")
    S.resume(spark, [*asked, "SELECT DISTINCT c_nationkey FROM customer"], log)
    return S.logged(spark, log).select("sql", "success", "row_count", F.dense_rank().over(Window.orderBy("run")).alias("runs"))


@query("""SELECT 'SELECT * FROM orders WHERE o_orderkey % 7 = 5' AS sql, 'scan of orders' AS warnings, count(*) AS row_count FROM orders WHERE o_orderkey % 7 = 5 UNION ALL SELECT 'SELECT DISTINCT l_partkey FROM lineitem', 'scan of lineitem', count(DISTINCT l_partkey) FROM lineitem
    UNION ALL SELECT 'SELECT 1 FROM customer c JOIN supplier s ON c.c_acctbal < s.s_acctbal', 'loop over pairs;scan of customer;scan of supplier', NULL""")
def q_spark_plans(spark, d):
    """Statements with what their optimised plans warn of; those that would loop over pairs are not run."""
    _views(spark, d, "lineitem", "orders", "customer", "supplier")
    asked = ["SELECT * FROM orders WHERE o_orderkey % 7 = 5", "SELECT DISTINCT l_partkey FROM lineitem", "SELECT 1 FROM customer c JOIN supplier s ON c.c_acctbal < s.s_acctbal"]
    warned = S.spark_plan_warnings(F.col("plan"), rows=1 << 62)
    plans = stored(spark.createDataFrame([(q, S.plan_text(spark, q)) for q in asked], "sql string, plan string").withColumn("warnings", warned), "plans")
    run = S.execute_all(spark, [r.sql for r in plans.where(~F.array_contains("warnings", "loop over pairs")).select("sql").collect()])
    short = F.transform("warnings", lambda w: F.regexp_replace(w, r"scan of \S*/(\w+)\.parquet", "scan of $1"))
    return plans.join(run.select("sql", "row_count"), "sql", "left").select("sql", F.array_join(F.array_sort(short), ";").alias("warnings"), "row_count")


@query("SELECT count(*) AS total, count(x) AS present, count(*) - count(x) AS missing, count_if(x = '') AS blank FROM (SELECT CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN '' ELSE event_type END AS x FROM events)")
def o_completeness(spark, d):
    k = F.col("event_id") % 9
    return O.completeness(table(spark, d, "events").withColumn("x", F.when(k == 1, "").when(k > 1, F.col("event_type"))), "x")


@query('SELECT user_id, count(*) AS "rows" FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20')
def o_top_groups(spark, d):
    return O.top_groups(table(spark, d, "events"), ["user_id"])


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10")
def o_latest(spark, d):
    return O.latest(table(spark, d, "events"), F.col("event_type") == "error", ["ts", "event_id"]).select("event_id", "ts", "value")


@query("""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS query_id, min(ts) FILTER (event_type = 'view') AS view_at, min(ts) FILTER (event_type = 'click') AS click_at, min(ts) FILTER (event_type = 'purchase') AS purchase_at FROM events GROUP BY 1)
    SELECT *, (epoch_us(click_at) - epoch_us(view_at)) / 1000000 AS click_s, (epoch_us(purchase_at) - epoch_us(click_at)) / 1000000 AS purchase_s FROM f""")
def o_stage_durations(spark, d):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" - INFO - ["), "user_id", F.lit("] "), "event_type", F.lit(" done"))
    return O.stage_durations(table(spark, d, "events").select(line.alias("value")), ["view", "click", "purchase"])


@query("SELECT event_type AS route, count(*) AS requests, count_if(value < 80) AS successes, count_if(value >= 80) AS failures, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS mean_s FROM events GROUP BY 1")
def o_metrics(spark, d):
    out = O.request_metrics(table(spark, d, "events"), "event_type", F.col("value") < 80, F.col("value").cast("decimal(18,2)"))
    return out.withColumn("mean_s", F.round(F.col("mean_s").cast("double"), 6))


@query("SELECT 'slow ' || event_type AS reason, count(*) AS n FROM events WHERE value >= 80 GROUP BY 1")
def o_fallbacks(spark, d):
    return O.fallbacks(table(spark, d, "events"), F.when(F.col("value") >= 80, F.concat(F.lit("slow "), "event_type")))


@query("""SELECT l_orderkey AS query_id, CASE WHEN count(*) = 1 THEN 'select ' || min(l_partkey) END AS sql, count(*) AS sub_queries, count_if(l_returnflag = 'R') AS successes, CAST(sum(l_quantity) AS DOUBLE) AS total_ms FROM lineitem GROUP BY 1""")
def o_final_records(spark, d):
    s = F.struct(F.col("l_linenumber").alias("id"), F.concat(F.lit("select "), "l_partkey").alias("validated_sql"), (F.col("l_returnflag") == "R").alias("success"), F.col("l_quantity").alias("ms"))
    out = O.final_records(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_list(s).alias("sub_queries")))
    return out.withColumn("sub_queries", F.col("sub_queries").cast("bigint")).withColumn("successes", F.col("successes").cast("bigint"))


@query("""WITH n AS (SELECT l_orderkey AS query_id, coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS n FROM lineitem GROUP BY 1) SELECT query_id, CASE n WHEN 0 THEN 'no rows' WHEN 1 THEN 'one row' ELSE n || ' rows' END AS summary FROM n""")
def o_template_summary(spark, d):
    return O.template_summary(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") == "R").alias("success"), F.col("l_linenumber").alias("row_count")))


@query("""SELECT user_id AS query_id, CASE WHEN bool_or(value > 99.5) THEN 'generation_error' WHEN count_if(event_type <> 'view') = 0 THEN 'no_result' WHEN count_if(event_type = 'purchase') = 0 THEN 'all_failed' ELSE 'succeeded' END AS scenario,
    coalesce(string_agg('e' || event_id, '; ' ORDER BY event_id) FILTER (event_type = 'error'), '') AS failed FROM events GROUP BY 1""")
def o_scenarios(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("query_id"), (F.col("value") <= 99.5).alias("generated"), F.when(F.col("event_type") != "view", F.col("event_type") == "purchase").alias("success"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id")).alias("error"))
    return O.scenarios(e, "event_id")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'Something broke' WHEN 'click' THEN 'Clicked' ELSE 'Please try again' END AS message, event_id % 11 IN (4, 10) AS retryable FROM events""")
def o_messages(spark, d):
    known = spark.createDataFrame([("error", "Something broke"), ("click", "Clicked")], "error_type string, message string")
    e = table(spark, d, "events").withColumn("error_type", F.col("event_type"))
    said = ("HTTP 400", "status_code=400", "Bad Request", "invalid request", "4000 rows, invalid api key", "InvalidRequestError", "error 401", "status_code=401", "Authentication failed", "Unauthorized", "temporary failure")
    text = F.get(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 11).cast("int"))
    return O.messages(e, known, "Please try again").select("event_id", "message", O.retryable(text).alias("retryable"))


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(value) OVER w AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def o_running_average(spark, d):
    return O.running_average(table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)")), ["user_id"], ["ts", "event_id"], "value").select("event_id", "running")
