"""Audits of tables of SQL text, plan text and attempts; and execution with a log row."""

from __future__ import annotations

import re
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Statement types that may run, and words that may not occur.
ALLOWED = ("SELECT", "WITH", "UNKNOWN")
FORBIDDEN = ("DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE", "GRANT", "REVOKE", "EXEC", "EXECUTE")


#: Token runs of SQL text: literals, comments (those to the end of a line with it), names with their parts, marks; all else is skipped.
_LITERAL = r"'(?:[^'\\]++|\\'|\\|'')*'"
_LINE = r"(?:--|# )[^\r\n]*(?:\r\n|\r|\n|$)"
_BLOCK = r"/\*[\s\S]*?\*/"
_PART = r'(?:"(?:[^"]|"")+"|`[^`]+`|[\p{L}_][\p{L}\p{N}_$]*)'
_SHAPE = rf"{_LITERAL}|{_LINE}|{_BLOCK}|\"[^\"]*\"|`[^`]*`|[();]|\s++|[^\s'\"`();#/-]++|."
_NAMES = rf"{_LITERAL}|{_LINE}|{_BLOCK}|[0-9][\w.]*|{_PART}(?:\s*\.\s*{_PART})*|[(),;]"
#: Words that end a list of tables, and those that stand between FROM or JOIN and a table.
_ENDS = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH", "UNION", "EXCEPT", "INTERSECT", "WINDOW", "QUALIFY", "RETURNING", "SET", "VALUES", "SELECT")
_BETWEEN = ("LATERAL", "ONLY")


def statements(sql: Column) -> Column:
    """Number of statements: what semicolons end, and what follows the last one.

    Semicolons in literals, quoted names, comments and parentheses end nothing.  Blanks after the last
    semicolon are no statement, nor is a comment to the end of the same line.
    """

    def step(acc: Column, t: Column) -> Column:
        ends = (t == ";") & (acc["depth"] <= 0)
        blank, line = F.trim(F.translate(t, "\n\r\t\f", "    ")) == "", t.rlike(r"^(--|# )")
        fresh = F.when(ends, True).otherwise(acc["fresh"] & ~t.rlike(r"^\s*[\r\n]"))
        counts = ~blank & ~(line & acc["fresh"])
        return F.struct(
            (acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"), (acc["n"] + ends.cast("int")).alias("n"),
            F.when(ends, False).otherwise(acc["open"] | counts).alias("open"), fresh.alias("fresh"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("open"), F.lit(False).alias("fresh"))
    text = F.coalesce(sql, F.lit(""))
    folded = F.aggregate(F.regexp_extract_all(text, F.lit(_SHAPE), F.lit(0)), start, step, lambda acc: acc["n"] + acc["open"].cast("int"))
    # Without a semicolon there is nothing to fold.
    return F.when(text.contains(";"), folded).otherwise(text.rlike(r"\S").cast("int"))


def syntax_errors(sql: Column) -> Column:
    said = lambda n: F.array_compact(F.array(F.when(n == 0, F.lit("no statement")), F.when(n > 1, F.lit("more than one statement"))))
    # A transform of one element, so that the number is computed once.
    return F.get(F.transform(F.array(statements(sql)), said), F.lit(0))


def security_errors(sql: Column) -> Column:
    """All violations: type, forbidden words (also inside literals), comments."""
    up = F.upper(sql)
    first = F.regexp_extract(up, r"^\s*(\w+)", 1)
    known = F.when(first.isin(*ALLOWED, *FORBIDDEN), first).otherwise("UNKNOWN")
    words = F.filter(F.array(*[F.when(up.rlike(rf"\b{w}\b"), F.lit(f"forbidden word {w}")) for w in FORBIDDEN]), lambda x: x.isNotNull())
    kind = F.array_compact(F.array(F.when(~known.isin(*ALLOWED), F.concat(F.lit("statement type "), known))))
    comments = F.array_compact(F.array(F.when(sql.contains("--") | sql.contains("/*"), F.lit("comment"))))
    return F.concat(kind, words, comments)


def plan_warnings(plan: Column, sql: Column, rows: int = 100_000) -> Column:
    """Sequential scans, nested loops without JOIN in the SQL, and a first row estimate over `rows`."""
    up = F.upper(plan)
    first = F.regexp_extract(plan, r"rows=(\d+)", 1).try_cast("bigint")
    return F.array_compact(F.array(
        F.when(up.contains("SEQ SCAN"), F.lit("sequential scan")), F.when(up.contains("NESTED LOOP") & ~F.upper(sql).contains("JOIN"), F.lit("nested loop")),
        F.when(first > rows, F.concat(F.lit("about "), first, F.lit(" rows"))),
    ))


def plan_text(spark: SparkSession, sql: str) -> str:
    """The optimised plan of a statement with its estimates, and the physical one, without running it."""
    return "".join(r[0] for mode in ("COST", "FORMATTED") for r in spark.sql(f"EXPLAIN {mode} {sql}").collect())


def plan_estimate(plan: Column) -> tuple[Column, Column]:
    """(rows, bytes) that the optimiser expects at the top of a plan_text; null where it does not say."""
    size = F.regexp_extract(plan, r"Statistics\(sizeInBytes=([0-9.]+) ([KMGTPE]?i?B)", 1).try_cast("double")
    unit = F.regexp_extract(plan, r"Statistics\(sizeInBytes=[0-9.]+ ([KMGTPE]?)i?B", 1)
    rows = F.regexp_extract(plan, r"Statistics\([^)]*rowCount=([0-9.E+]+)", 1).try_cast("double")
    return rows, size * F.pow(F.lit(1024.0), F.instr(F.lit("KMGTPE"), unit) * (unit != "").cast("int"))


def spark_plan_warnings(plan: Column, rows: int = 100_000) -> Column:
    """Of a plan_text: joins over all pairs, scans that no partition filter narrows, and an estimate of over `rows` rows."""
    pairs = F.when(plan.rlike("CartesianProduct|BroadcastNestedLoopJoin"), F.lit("loop over pairs"))
    # A scan's block ends with a blank line; its location is in brackets.
    scans = F.regexp_extract_all(plan, F.lit(r"(?s)\n\(\d+\) Scan [^\n]+\n((?:[^\n]+\n)+)"), F.lit(1))
    whole = F.filter(scans, lambda x: ~x.rlike("PartitionFilters: \\[[^\\]]"))
    named = F.transform(whole, lambda x: F.concat(F.lit("scan of "), F.regexp_extract(x, r"Location: \w+ ?\[([^\],]*)", 1)))
    estimate, _ = plan_estimate(plan)
    many = F.when(estimate > rows, F.concat(F.lit("about "), estimate.cast("bigint"), F.lit(" rows")))
    return F.array_compact(F.concat(F.array(pairs), F.array_distinct(named), F.array(many)))


def tables_used(sql: Column) -> Column:
    """Names after FROM and JOIN, those of lists too, in order; quoted names keep their quotes.

    Literals and comments hold none.  FROM counts at the top and in parentheses that begin a query or
    a join, not among a function's arguments (extract(year FROM t)) nor in IS DISTINCT FROM.  Functions
    in the place of a table are none.
    """
    open_, shut, comma = (lambda t, mark=mark: t == mark for mark in "(),")

    def step(acc: Column, t: Column) -> Column:
        up, skip = F.upper(t), t.rlike(r"^(--|# |/\*)")
        levels = acc["levels"]
        # What the innermost parentheses hold: a query, a list of tables, arguments, or nothing yet.
        level = F.element_at(levels, -1)
        begins = F.when(level == "new", F.when(up.isin("SELECT", "WITH", "FROM"), "query").otherwise("args")).otherwise(level)
        names = acc["names"]
        # A name that parentheses follow is a function.
        called = open_(t) & acc["named"]
        names = F.when(called, F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names)
        source = (begins != "args") & (up.isin("FROM", "JOIN") & (acc["before"] != "DISTINCT"))
        more = comma(t) & F.element_at(acc["lists"], -1)
        word = t.rlike(r'^["`\p{L}_]')
        is_table = acc["expect"] & word & ~up.isin(*_BETWEEN, *_ENDS, "FROM", "JOIN")
        expect = source | more | (acc["expect"] & up.isin(*_BETWEEN))
        pushed = F.array_append(F.slice(levels, 1, F.size(levels) - 1), begins)
        set_level = F.when(open_(t), F.array_append(pushed, F.when(acc["expect"], "tables").otherwise("new"))).when(shut(t) & (F.size(levels) > 1), F.slice(levels, 1, F.size(levels) - 1)).otherwise(pushed)
        listed = F.when(source, True).when(up.isin(*_ENDS), False).otherwise(F.element_at(acc["lists"], -1))
        same = F.array_append(F.slice(acc["lists"], 1, F.size(acc["lists"]) - 1), listed)
        lists = F.when(open_(t), F.array_append(same, acc["expect"])).when(shut(t) & (F.size(levels) > 1), F.slice(acc["lists"], 1, F.size(acc["lists"]) - 1)).otherwise(same)
        # A table's place stays open across parentheses that hold tables.
        expect = expect | (open_(t) & acc["expect"])
        new = F.struct(
            set_level.alias("levels"), lists.alias("lists"), expect.alias("expect"), is_table.alias("named"), up.alias("before"),
            F.when(is_table, F.array_append(names, F.regexp_replace(t, r"\s*\.\s*", "."))).otherwise(names).alias("names"),
        )
        return F.when(skip, acc).otherwise(new)

    none = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("query")).alias("levels"), F.array(F.lit(False)).alias("lists"), F.lit(False).alias("expect"), F.lit(False).alias("named"), F.lit("").alias("before"), none.alias("names"))
    return F.aggregate(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(_NAMES), F.lit(0)), start, step, lambda acc: acc["names"])


def verdict(df: DataFrame, sql: str = "sql", syntax: bool = True, security: bool = True, plan: str | None = None, plan_error: str | None = None) -> DataFrame:
    """df with errors, warnings, layer (the first that failed, else 'all_passed') and valid; later layers are not looked at.

    The semantic layer reads what EXPLAIN said: the columns plan and plan_error (see
    explain_error).  Its warnings come with every row that reaches it.
    """
    none = F.array().cast("array<string>")
    a, b = syntax_errors(F.col(sql)) if syntax else none, security_errors(F.col(sql)) if security else none
    c = F.array_compact(F.array(F.col(plan_error))) if plan_error else none
    out = df.withColumn("_a", a).withColumn("_b", b).withColumn("_c", c)
    layer = F.when(F.size("_a") > 0, "syntax").when(F.size("_b") > 0, "security").when(F.size("_c") > 0, "semantic").otherwise("all_passed")
    out = out.withColumn("layer", layer)
    out = out.withColumn("errors", F.when(F.col("layer") == "syntax", F.col("_a")).when(F.col("layer") == "security", F.col("_b")).otherwise(F.col("_c")))
    warned = plan_warnings(F.coalesce(plan, F.lit("")), F.col(sql)) if plan else none
    out = out.withColumn("warnings", F.when(F.col("layer").isin("semantic", "all_passed"), warned).otherwise(none))
    return out.withColumn("valid", F.col("layer") == "all_passed").drop("_a", "_b", "_c")


def error_type(layer: Column, errors: Column) -> tuple[Column, Column]:
    """(type, message) of a failed verdict; null if it passed."""
    failed = layer != "all_passed"
    return F.when(failed, F.concat(F.lit("validation_"), layer, F.lit("_failed"))), F.when(failed, F.get(errors, F.lit(0)))


def summary(valid: Column, layer: Column, errors: Column) -> Column:
    return F.when(valid, F.lit("valid")).otherwise(F.concat(F.lit("failed at "), layer, F.lit(": "), F.array_join(errors, "; ")))


def latest(history: DataFrame, key: list[str]) -> DataFrame:
    """The row of the last iteration for each key."""
    rest = [c for c in history.columns if c not in key]
    return history.groupBy(*key).agg(F.max(F.struct("iteration", *[c for c in rest if c != "iteration"])).alias("r")).select(*key, "r.*")


def classified(message: Column) -> tuple[Column, Column]:
    """(class, recoverable) of an error message."""
    m = F.lower(message)
    has = lambda *xs: F.greatest(*[m.contains(x) for x in xs], F.lit(False))
    kind = (
        F.when(has("does not exist", "unknown"), F.when(has("table"), "table_not_found").otherwise("column_not_found")).when(has("out of range", "invalid date"), "out_of_range")
        .when(has("connection", "timeout"), "connection_error").when(has("permission denied", "access denied"), "permission_error").otherwise("unknown_error")
    )
    return kind, kind.isin("table_not_found", "column_not_found", "out_of_range")


def capped(df: DataFrame, rows: int = 10_000) -> DataFrame:
    return df.limit(rows)


def outcome(validated: Column, failed_step: Column, iteration: Column, most: int = 3) -> Column:
    """success, fail or retry of an attempt."""
    return F.when(validated.isNotNull(), "success").when(failed_step.isin("retrieval", "generation"), "fail").when(iteration < most, "retry").otherwise("fail")


def output(df: DataFrame) -> DataFrame:
    """Attempts with success and one-line error; a success masks older errors."""
    ok = F.col("validated_sql").isNotNull()
    line = F.format_string("%s at %s after %d tries: %s", F.coalesce("error_type", F.lit("error")), F.coalesce("failed_step", F.lit("?")), "iteration", F.coalesce("error", F.lit("")))
    return df.withColumn("success", ok).withColumn("summary", F.when(~ok, line))


def table_columns(spark: SparkSession, name: str) -> DataFrame:
    """(ordinal, column_name, data_type) of a catalogued table; empty if there is none."""
    fields = spark.table(name).schema.fields if spark.catalog.tableExists(name) else []
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields, 1)], "ordinal int, column_name string, data_type string")


def explain_error(spark: SparkSession, sql: str) -> str | None:
    """What the analyser says against a statement, without running it."""
    try:
        text = spark.sql("EXPLAIN " + sql).first()[0]
    except PySparkException as e:
        return str(e).splitlines()[0]
    # EXPLAIN prints an analysis error in place of a plan.
    lines = [line for line in text.splitlines() if line.strip() and not line.startswith("==")]
    failed = text.startswith("Error occurred") or (lines and re.match(r"[\w.]*Exception|\[[A-Z_]+", lines[0]))
    return " ".join(lines) if failed else None


def execute(spark: SparkSession, sql: str, timeout: float = 30.0, most: int = 0, pool: str | None = None) -> dict:
    """Runs one statement under a tag and returns its log row: success, columns, row_count, rows, began_ms, execution_time_ms, error.

    The result stays in Spark; its count and at most `most` rows, as JSON, come back.  After `timeout`
    seconds the tag's jobs are cancelled.  `pool` is the scheduler pool of the jobs.
    """
    from threading import Timer

    tag = f"sql-{time.monotonic_ns()}"
    began = time.time()
    row = {"sql": sql, "success": False, "columns": [], "row_count": 0, "rows": [], "error": None, "began_ms": began * 1000}
    timer = Timer(timeout, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    timer.start()
    spark.sparkContext.addJobTag(tag)
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool or before)
    try:
        df = spark.sql(sql)
        row |= {"columns": df.columns, "row_count": df.count(), "rows": [r[0] for r in df.limit(most).select(F.to_json(F.struct("*"))).collect()] if most else []}
        row["success"] = True
    except Exception as e:  # every failure becomes a log row
        row["error"] = str(e).splitlines()[0]
    finally:
        spark.sparkContext.removeJobTag(tag)
        # Workers are used again: the next statement's pool is its own.
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)
        timer.cancel()
    return row | {"execution_time_ms": (time.time() - began) * 1000}


def pending(statements: DataFrame, log: DataFrame) -> DataFrame:
    """The statements (sql, ...) that the log (sql, ...) does not have yet."""
    return statements.join(log.select("sql").distinct(), "sql", "left_anti")


def execute_all(spark: SparkSession, statements: list[str], done: set[str] = frozenset(), workers: int = 3, **options) -> DataFrame:
    """Log rows of the statements that are not done yet; a few independent jobs run side by side."""
    todo = [s for s in statements if s not in done]
    with ThreadPoolExecutor(workers) as runners:
        rows = list(runners.map(lambda s: execute(spark, s, **options), todo))
    return spark.createDataFrame(rows, "sql string, success boolean, columns array<string>, row_count bigint, rows array<string>, error string, began_ms double, execution_time_ms double")


_LOG = "sql string, success boolean, columns array<string>, row_count bigint, rows array<string>, error string, began_ms double, execution_time_ms double, run string"


def logged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log that `resume` writes; none if it is not there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(_LOG).parquet(path) if there else spark.createDataFrame([], _LOG)


def resume(spark: SparkSession, statements: list[str], path: str, workers: int = 3, again: bool = False, **options) -> int:
    """Executes the statements that the log at `path` does not have, and adds their rows to it; how many they were.

    Rows are written a group of `workers` statements at a time, so a run that dies loses one group at
    most and the next one goes on behind it.  With `again`, statements that failed are tried once more.
    Pools share executors only under spark.scheduler.mode FAIR, which is set when Spark starts.
    """
    done = logged(spark, path).where("success" if again else "true")
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(dict.fromkeys(statements))], "place int, sql string")
    todo = [r.sql for r in pending(asked, done).orderBy("place").collect()]
    run = f"{time.time():017.6f}"
    for a in range(0, len(todo), workers):
        rows = execute_all(spark, todo[a : a + workers], workers=workers, **options)
        rows.withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(path)
    return len(todo)


def parallelism(log: DataFrame) -> DataFrame:
    """(most): how many statements of a log (began_ms, execution_time_ms) ran at the same time at most."""
    edges = F.array(F.struct(F.col("began_ms").alias("at"), F.lit(1).alias("step")), F.struct((F.col("began_ms") + F.col("execution_time_ms")).alias("at"), F.lit(-1).alias("step")))
    steps = log.select(F.explode(edges).alias("e")).select("e.*")
    running = F.sum("step").over(Window.orderBy("at", "step"))
    return steps.select(running.alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
