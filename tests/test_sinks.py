"""Keyed tables, retention, tenants, logs that are resumed, texts encoded once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabulon.operators import conversations, iteration, retrieval, sql_audit
from tabulon.sources import keyed, tables

KIND = "k int, g int, v string, at int"


def rows(spark, *values):
    return spark.createDataFrame([*values], KIND).withColumn("bucket", keyed.bucket(["k"], 4))


def test_upserts_keep_one_row_a_key(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert keyed.read(spark, folder) is None
    keyed.upsert(folder, rows(spark, (1, 0, "a", 1), (2, 0, "b", 1), (3, 0, None, 1), (1, 0, "a2", 5)), ["k"], "bucket", ["at"])
    # An older row loses, an equally new one wins, a null order is the least, several new ones meet.
    keyed.upsert(folder, rows(spark, (1, 0, "old", 4), (2, 0, "c", 1), (3, 0, "d", None), (4, 0, "e", 1), (4, 0, "f", 2)), ["k"], "bucket", ["at"])
    assert {(r.k, r.v) for r in keyed.read(spark, folder).collect()} == {(1, "a2"), (2, "c"), (3, None), (4, "f")}
    # Without an order the new row wins; columns are put into the table's order and types.
    keyed.upsert(folder, rows(spark, (1, 9, "new", 0)).select("at", "v", F.col("g").cast("bigint"), "k", "bucket"), ["k"], "bucket")
    assert {(r.k, r.g, r.v) for r in keyed.read(spark, folder).where("k = 1").collect()} == {(1, 9, "new")}
    assert keyed.versions(spark, folder) == [0, 1, 2]


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    folder = str(tmp_path / "t")
    keyed.upsert(folder, rows(spark, *[(i, 0, "x", 0) for i in range(40)]), ["k"], "bucket")
    before = keyed.state(spark, folder)["versions"]
    assert set(before) == {"0", "1", "2", "3"}
    one = rows(spark, (7, 0, "y", 0))
    keyed.upsert(folder, one, ["k"], "bucket")
    after, touched = keyed.state(spark, folder)["versions"], str(one.first().bucket)
    assert {b for b in before if before[b] != after[b]} == {touched}
    assert keyed.vacuum(spark, folder) == [f"bucket={touched}/version={before[touched]}"]
    assert keyed.read(spark, folder).count() == 40 and keyed.vacuum(spark, folder) == []


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    keyed.upsert(folder, rows(spark, (1, 0, "a", 0)), ["k"], "bucket")
    commit = keyed._commit
    monkeypatch.setattr(keyed, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        keyed.upsert(folder, rows(spark, (1, 0, "b", 0), (2, 0, "c", 0)), ["k"], "bucket")
    monkeypatch.setattr(keyed, "_commit", commit)
    assert [(r.k, r.v) for r in keyed.read(spark, folder).collect()] == [(1, "a")]
    # Of two runs that start from one list the second to end fails.
    now = keyed.state(spark, folder)
    monkeypatch.setattr(keyed, "state", lambda *a: now)
    keyed.upsert(folder, rows(spark, (1, 0, "first", 0)), ["k"], "bucket")
    with pytest.raises(Exception, match="(?i)exist"):
        keyed.upsert(folder, rows(spark, (1, 0, "second", 0)), ["k"], "bucket")
    monkeypatch.undo()
    assert [r.v for r in keyed.read(spark, folder).collect()] == ["first"]


def turns(spark, *values):
    t = spark.createDataFrame([(th, q, text, c, u) for th, q, text, c, u in values], "thread_id string, query_id string, question string, created_at string, updated_at string")
    return t.select("thread_id", "query_id", "question", F.lit("a").alias("answer"), F.col("created_at").cast("timestamp"), F.col("updated_at").cast("timestamp"))


def test_turns_are_upserted_across_runs(spark, tmp_path):
    """A turn that is written again, on another day, replaces its old row and keeps its first day."""
    path = str(tmp_path / "turns")
    conversations.write_turns(turns(spark, ("u:1", "q1", "one", "2024-01-01 10:00", "2024-01-01 10:00"), ("u:1", "q2", "two", "2024-01-02 10:00", "2024-01-02 10:00")), path)
    conversations.write_turns(turns(spark, ("u:1", "q1", "again", "2024-01-05 10:00", "2024-01-05 10:00"), ("u:1", "q2", "stale", "2024-01-01 09:00", "2024-01-01 09:00"), ("u:2", "q1", "new", None, "2024-01-05 10:00")), path)
    got = {(r.thread_id, r.query_id): (r.question, str(r.day)) for r in conversations.stored_turns(spark, path).collect()}
    assert got == {("u:1", "q1"): ("again", "2024-01-01"), ("u:1", "q2"): ("two", "2024-01-02"), ("u:2", "q1"): ("new", "None")}
    recent = conversations.recent_turns(conversations.stored_turns(spark, path).withColumn("success", F.lit(True)))
    assert recent.where("thread_id = 'u:1'").count() == 2


def test_retention_reads_the_edge_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "turns")
    conversations.write_turns(turns(spark, *[("u:1", f"q{d}{h}", "x", f"2024-01-0{d} {h}:00", f"2024-01-0{d} {h}:00") for d in (1, 2, 3, 4) for h in (10, 20)], ("u:1", "no", "x", None, None)), path)
    before, read, plain = keyed.state(spark, path)["versions"], [], keyed._read
    monkeypatch.setattr(keyed, "_read", lambda s, f, now, values=None: read.append(values) or plain(s, f, now, values))
    conversations.retain(spark, path, datetime(2024, 1, 13, 15), 10)
    assert read == [["2024-01-03"]]
    after = keyed.state(spark, path)["versions"]
    assert {d for d in after if after[d] == before.get(d)} == {"2024-01-04", "__HIVE_DEFAULT_PARTITION__"} and "2024-01-03" in after
    assert sorted(r.query_id for r in conversations.stored_turns(spark, path).collect()) == ["no", "q320", "q410", "q420"]
    assert {x.split("/")[0] for x in keyed.vacuum(spark, path)} == {"day=2024-01-01", "day=2024-01-02", "day=2024-01-03"}
    # A cut after all of a day's turns takes the day out; the same cut twice changes nothing.
    conversations.retain(spark, path, datetime(2024, 1, 13, 21), 10)
    n = keyed.versions(spark, path)
    conversations.retain(spark, path, datetime(2024, 1, 13, 21), 10)
    assert keyed.versions(spark, path) == n and "2024-01-03" not in keyed.state(spark, path)["versions"]


def test_a_tenant_reads_its_own_folder(spark, tmp_path):
    objects = spark.createDataFrame([(i, "ab"[i % 2], [float(i), 1.0]) for i in range(10)], "object_id int, db_name string, embedding array<double>")
    retrieval.write_store(objects, str(tmp_path / "store"))
    mine = retrieval.tenant(spark.read.parquet(str(tmp_path / "store")), "b")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(db_name" in plan
    assert {r[0].split("/")[-2] for r in mine.select(F.input_file_name()).collect()} == {"db_name=b"}
    assert {r.object_id for r in retrieval.top_k(objects.limit(1).withColumnRenamed("object_id", "query_id"), mine, 9).collect()} == {1, 3, 5, 7, 9}


def test_texts_of_pairs_are_encoded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    pairs = spark.createDataFrame([(i, "same", f"t{i % 3}") for i in range(50)] + [(50, "same", None), (51, " ", "same"), (52, "t1", "same")], "place int, left_text string, right_text string")
    got = {r.place: r.similarity for r in retrieval.text_pairs(pairs, encode).collect()}
    assert calls.value == 4 and len(got) == 53
    assert got[50] is None and got[51] is None and got[0] == got[52] == pytest.approx(9 / (17**0.5 * 5**0.5))


def test_a_second_run_executes_nothing(spark, tmp_path, monkeypatch):
    log, ran, execute = str(tmp_path / "log"), [], sql_audit.execute
    monkeypatch.setattr(sql_audit, "execute", lambda s, sql, **o: ran.append(sql) or execute(s, sql, **o))
    asked = ["SELECT id FROM range(5)", "SELECT broken", "SELECT id FROM range(5)", "SELECT 2 AS x", "SELECT 3 AS x"]
    assert sql_audit.logged(spark, log).count() == 0
    assert sql_audit.resume(spark, asked, log, workers=2, pool="p") == 4 and sql_audit.resume(spark, asked, log) == 0
    assert sorted(ran) == sorted(set(asked)) and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert sql_audit.resume(spark, asked, log, again=True) == 1 and ran[-1] == "SELECT broken"
    # A run that dies in its second group leaves the first one's rows, and the next run goes on behind it.
    more = [f"SELECT {i} AS y" for i in range(4)]
    monkeypatch.setattr(sql_audit, "execute", lambda s, sql, **o: (_ for _ in ()).throw(KeyboardInterrupt()) if sql == more[2] else execute(s, sql, **o))
    with pytest.raises(KeyboardInterrupt):
        sql_audit.resume(spark, more, log, workers=2)
    monkeypatch.setattr(sql_audit, "execute", execute)
    assert sql_audit.resume(spark, more, log, workers=2) == 2
    assert sql_audit.parallelism(sql_audit.logged(spark, log)).first().most >= 1


def test_pools_are_reset(spark):
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "mine")
    sql_audit.execute(spark, "SELECT 1", pool="other")
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "mine"
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)


def test_plan_warnings_of_spark(spark, tmp_path):
    spark.range(50).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(str(tmp_path / "parts"))
    spark.read.parquet(str(tmp_path / "parts")).createOrReplaceTempView("parts")
    plan = {q: sql_audit.plan_text(spark, q) for q in ("SELECT * FROM parts WHERE p = 1", "SELECT * FROM parts", "SELECT 1 FROM parts a JOIN parts b ON a.id < b.id", "SELECT * FROM range(1000000)")}
    df = spark.createDataFrame([*plan.items()], "sql string, plan string")
    got = {r[0]: r[1] for r in df.select("sql", sql_audit.spark_plan_warnings(F.col("plan"))).collect()}
    kinds = [[w.split(" of ")[0].split(" 1")[0] for w in got[q]] for q in plan]
    assert kinds == [[], ["scan"], ["loop over pairs" if w == "loop over pairs" else "scan" for w in got["SELECT 1 FROM parts a JOIN parts b ON a.id < b.id"]], ["about"]]
    assert "loop over pairs" in kinds[2]
    rows_, size = sql_audit.plan_estimate(F.col("plan"))
    assert df.where("sql LIKE '%range%'").select(rows_, size).first()[0] == 1e6


def test_scratch_belongs_to_its_session(spark):
    other = spark.newSession()
    path = iteration.scratch(other, "x")
    tables.write_report(spark.range(1), path)
    iteration.clear(spark)
    assert spark.read.json(path).count() == 1
    iteration.clear(other)


def test_jdbc_table_is_read_in_ranges(spark, monkeypatch):
    """The ranges and properties reach Spark's reader; no database is at hand."""
    seen = {}
    reader = type(spark.read)
    monkeypatch.setattr(reader, "jdbc", lambda self, url, name, **options: seen.update(url=url, name=name, **options) or "frame")
    assert tables.jdbc_table(spark, "jdbc:x", "t", "id", 1, 100, 4, {"user": "u"}) == "frame"
    assert seen == {"url": "jdbc:x", "name": "t", "column": "id", "lowerBound": 1, "upperBound": 100, "numPartitions": 4, "properties": {"user": "u"}}
    assert tables.table(spark, "/root/testdata/sf0.001", "region").columns == ["r_regionkey", "r_name"]
