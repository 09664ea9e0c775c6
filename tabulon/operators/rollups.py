"""Text roll-ups of a question's context, and cleaning of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_text


def _lines(df: DataFrame, line: Column, order: str, by: str = "query_id", sep: str = "\n") -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return df.groupBy(by).agg(F.array_join(F.transform(packed, lambda x: x["t"]), sep).alias("text"))


def card_lines(cards: DataFrame) -> DataFrame:
    """(query_id, text): '- table: card', line breaks of a card as blanks."""
    return _lines(cards, F.concat(F.lit("- "), "table_name", F.lit(": "), F.regexp_replace("text_raw", r"\s*\n\s*", " ")), "table_name")


def time_columns(cards: DataFrame) -> DataFrame:
    """(query_id, text): 'table.column' wherever a card hints at a time column."""
    return _lines(cards.where("time_col_hint <> ''"), F.concat("table_name", F.lit("."), "time_col_hint"), "table_name", sep=", ")


def by_category(cards: DataFrame) -> DataFrame:
    """(query_id, text): 'category: a, b', both levels sorted."""
    tables = cards.groupBy("query_id", "table_category").agg(F.array_join(F.array_sort(F.collect_set("table_name")), ", ").alias("tables"))
    return _lines(tables, F.concat("table_category", F.lit(": "), "tables"), "table_category")


def examples(hits: DataFrame, n: int = 2) -> DataFrame:
    """(query_id, text): the n best similar questions with similarity and SQL."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "object_id")
    top = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return _lines(top, F.format_string("%d. (%.2f) %s => %s", "place", "similarity", "question", "sql"), "place")


def dependency_results(results: DataFrame, n: int = 5, cell: int | None = None) -> DataFrame:
    """(query_id, text) of results (query_id, sub_query_id, rows ARRAY<STRING>): the first n rows, cells cut, and a note on the total."""
    cut = (lambda x: truncate_text(x, cell)) if cell else (lambda x: x)
    shown = F.array_join(F.transform(F.slice("rows", 1, n), cut), "\n")
    note = F.when(F.size("rows") > n, F.format_string("\n(%d rows in all)", F.size("rows"))).otherwise("")
    return _lines(results, F.concat("sub_query_id", F.lit(":\n"), shown, note), "sub_query_id")


def preview(results: DataFrame, columns: list[str], order: str, n: int = 10) -> DataFrame:
    """(query_id, text): header, a rule of 50 dashes and the first n rows of each result, '...' if there are n or more."""
    w = Window.partitionBy("query_id")
    rows = results.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("_all", F.count("*").over(w)).where(F.col("_n") <= n)
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    head = " | ".join(columns) + "\n" + "-" * 50 + "\n"
    body = _lines(rows, cells, "_n").withColumnRenamed("text", "body")
    more = rows.groupBy("query_id").agg((F.max("_all") >= n).alias("more"))
    return body.join(more, "query_id").select("query_id", F.concat(F.lit(head), "body", F.when(F.col("more"), "\n...").otherwise("")).alias("text"))


def clean_response(response: Column) -> Column:
    """A model's answer without its thinking and without code fences."""
    plain = F.regexp_replace(response, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(plain, r"```[A-Za-z]*", ""), F.lit(" \n\t\r"))


def plan_rows(responses: DataFrame) -> DataFrame:
    """(query_id, id, query, dependencies, error) of responses that hold a plan as JSON, in a code fence or bare; bad JSON is an error row."""
    body = F.regexp_extract("response", r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(body != "", body).otherwise(F.col("response"))
    parsed = F.from_json(text, "sub_queries array<struct<id:string,query:string,dependencies:array<string>>>")
    r = responses.select("query_id", parsed["sub_queries"].alias("s"))
    good = r.where("s is not null").select("query_id", F.explode("s").alias("s")).select("query_id", "s.*", F.lit(None).cast("string").alias("error"))
    bad = r.where("s is null").select("query_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("array<string>").alias("dependencies"), F.lit("no plan").alias("error"))
    return good.unionByName(bad)


#: The parsed question.
PARSE = (
    "struct<rewritten_query:string,keywords:array<string>,time:struct<start:string,end:string,grain_inferred:string,is_full_period:boolean>,"
    "metric:struct<text:string,is_aggregate_candidate:boolean>,dimensions:array<struct<text:string,role:string,evidence:string>>,intent:struct<task:string,topn:int>,signals:array<string>>"
)


def parsed_questions(responses: DataFrame) -> DataFrame:
    """(query_id, rewritten_query, parse_result, error): a blank rewrite gives the question itself; what is no JSON object is an error."""
    bad = ~F.coalesce(F.trim("response").startswith("{"), F.lit(False)) | F.try_parse_json("response").isNull()
    p = F.from_json("response", PARSE)
    return responses.select("query_id", F.coalesce(F.nullif(F.trim(p["rewritten_query"]), F.lit("")), F.col("question")).alias("rewritten_query"), F.when(~bad, p).alias("parse_result"), F.when(bad, "not a JSON object").alias("error"))


def complexity_label(response: Column, default: str = "complex", forced: str | None = None) -> tuple[Column, Column]:
    """(label, reason) of a classifier's answer; a forced label wins."""
    r = F.lower(F.coalesce(response, F.lit("")))
    label = F.lit(forced) if forced else F.when(r.contains("simple"), "simple").when(r.contains("complex"), "complex").otherwise(default)
    return label, F.left(F.coalesce(response, F.lit("")), F.lit(200))


def error_bullets(errors: Column) -> Column:
    return F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")


def hints(parsed: DataFrame) -> DataFrame:
    """(query_id, metric, filters): one line each."""
    metric = F.when(F.col("parse_result.metric.is_aggregate_candidate"), F.concat(F.lit("aggregate "), "parse_result.metric.text")).otherwise(F.col("parse_result.metric.text"))
    dims = F.array_join(F.transform("parse_result.dimensions", lambda d: F.concat(d["role"], F.lit("="), d["text"])), ", ")
    return parsed.select("query_id", metric.alias("metric"), dims.alias("filters"))
