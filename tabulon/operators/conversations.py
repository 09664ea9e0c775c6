"""Conversation and session tables.

turns: thread_id, query_id, user_id, question, answer, success, created_at, updated_at.
A thread id is user:YYYYMMDDTHHmmssSSSZ.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_text
from ..sources import keyed

#: Formats of user ids, thread ids and store keys.
USER = r"^[A-Za-z0-9_-]{1,64}$"
THREAD = r"^[A-Za-z0-9_-]{1,64}:[0-9]{8}T[0-9]{9}Z$"
GUEST = "guest"


def valid_user(user: Column) -> Column:
    return F.coalesce(user.rlike(USER), F.lit(False))


def safe_user(user: Column) -> Column:
    return F.when(valid_user(user), user).otherwise(F.lit(GUEST))


def valid_thread(thread: Column) -> Column:
    return F.coalesce(thread.rlike(THREAD), F.lit(False))


def thread_user(thread: Column) -> Column:
    return F.when(valid_thread(thread), F.split_part(thread, F.lit(":"), F.lit(1))).otherwise(F.lit(GUEST))


def thread_time(thread: Column) -> Column:
    """The thread's UTC time in milliseconds, null for an invalid id or date."""
    stamp = F.regexp_replace(F.split_part(thread, F.lit(":"), F.lit(2)), "Z$", "")
    return F.when(valid_thread(thread), F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmssSSS")))


def thread_id(user: Column, created_at: Column) -> Column:
    return F.concat(safe_user(user), F.lit(":"), F.date_format(created_at, "yyyyMMdd'T'HHmmssSSS"), F.lit("Z"))


def parse_store_key(key: Column) -> tuple[Column, Column]:
    """(thread_id, query_id) of thread#query; both null if the key is not of that form."""
    thread, query = F.regexp_extract(key, r"^([^#]*)#([^#]+)$", 1), F.regexp_extract(key, r"^([^#]*)#([^#]+)$", 2)
    good = valid_thread(thread) & (query != "")
    return F.when(good, thread), F.when(good, query)


def reconciled(thread: Column, user: Column, created_at: Column) -> tuple[Column, Column, Column]:
    """(thread_id, user_id, mismatch): a valid thread id wins over the user; else one is made from the user and time."""
    ok = valid_thread(thread)
    return F.when(ok, thread).otherwise(thread_id(user, created_at)), F.when(ok, thread_user(thread)).otherwise(safe_user(user)), ok & user.isNotNull() & (thread_user(thread) != user)


def turn_rows(turns: DataFrame, most: int = 10_000) -> DataFrame:
    """Turns as stored: texts cut, the latest row of each (thread_id, query_id) kept."""
    cut = turns.withColumn("question", truncate_text(F.col("question"), most)).withColumn("answer", truncate_text(F.col("answer"), most))
    order = Window.partitionBy("thread_id", "query_id").orderBy(F.desc("updated_at"), F.desc("created_at"))
    return cut.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def write_turns(turns: DataFrame, path: str) -> None:
    """Upserts turns by (thread_id, query_id) into a table partitioned by day, so that the number of folders does not grow with the users.

    Across runs one row of each key stays, that of the latest update; it keeps the time at which
    the key was first stored, and so its day.  Only the days of the written turns are rewritten.
    """
    new, old = turn_rows(turns), keyed.read(turns.sparkSession, path)
    if old is not None:
        known = old.select("thread_id", "query_id", F.struct(F.col("created_at").alias("at")).alias("_first"))
        new = new.join(known, ["thread_id", "query_id"], "left").withColumn("created_at", F.when(F.col("_first").isNotNull(), F.col("_first.at")).otherwise(F.col("created_at"))).drop("_first")
    keyed.upsert(path, new.withColumn("day", F.to_date("created_at")), ["thread_id", "query_id"], "day", ["updated_at"])


def stored_turns(spark: SparkSession, path: str) -> DataFrame:
    """The turns of a table that write_turns made."""
    return keyed.read(spark, path)


def retain(spark: SparkSession, path: str, now: datetime, days: int = 90) -> dict:
    """Removes turns created over `days` days ago from a table of write_turns.

    Days that are wholly past leave the table's list and are not read; the day in which
    the cut lies is rewritten alone.  Turns without a time stay.
    """
    cut = now - timedelta(days=days)
    stored_days = keyed.state(spark, path)["versions"]
    past = [d for d in stored_days if d[:1].isdigit() and d < cut.date().isoformat()]
    return keyed.drop(spark, path, past, [cut.date().isoformat()], F.col("created_at") >= F.lit(cut.isoformat(sep=" ")).cast("timestamp"))


def succeeded(turns: DataFrame, log: DataFrame) -> DataFrame:
    """Turns whose query has any successful execution in log (query_id, success)."""
    good = log.groupBy("query_id").agg(F.bool_or("success").alias("good")).where("good")
    return turns.join(good, "query_id", "left_semi")


def recent_turns(turns: DataFrame, n: int = 3, most: int = 200, exclude: Column | None = None, fetch_multiplier: int = 2) -> DataFrame:
    """(thread_id, place, question, answer): the last n good turns of each thread, oldest first.

    The newest n * fetch_multiplier rows are taken before failures, blanks and the excluded
    one are dropped, so many failures can hide older successes.  Questions and answers lose
    the white space around them.
    """
    newest = Window.partitionBy("thread_id").orderBy(F.desc("updated_at"), F.desc("query_id"))
    t = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n * fetch_multiplier)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    t = t.withColumn("question", bare("question")).withColumn("answer", bare("answer")).where(F.col("success") & (F.col("question") != "") & (F.col("answer") != ""))
    if exclude is not None:
        t = t.where(~exclude)
    t = t.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("updated_at", "query_id"))
    return t.select("thread_id", place.alias("place"), truncate_text(F.col("question"), most).alias("question"), truncate_text(F.col("answer"), most).alias("answer"))


def recent_sessions(turns: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, thread_id, first_question, place): the n greatest thread ids of each user, newest first."""
    threads = turns.groupBy(thread_user(F.col("thread_id")).alias("user_id"), "thread_id").agg(F.min(F.struct("created_at", "query_id", "question")).getField("question").alias("first_question"))
    order = Window.partitionBy("user_id").orderBy(F.desc("thread_id"))
    return threads.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def history_text(turns: DataFrame) -> DataFrame:
    """(thread_id, text): numbered 'Q:' and 'A:' lines in order of place; pairs with a blank side are skipped and not numbered."""
    kept = turns.where((F.trim("question") != "") & (F.trim("answer") != ""))
    packed = F.array_sort(F.collect_list(F.struct("place", "question", "answer")))
    lines = F.transform(packed, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Q: "), x["question"], F.lit("\n   A: "), x["answer"]))
    return kept.groupBy("thread_id").agg(F.array_join(lines, "\n").alias("text"))


def retained(turns: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return turns.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
