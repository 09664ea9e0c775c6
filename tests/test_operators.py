"""Golden cases of single operators: ties, nulls, cycles, formats, formulas."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tabulon.functions import text as X
from tabulon.functions import vectors as V
from tabulon.operators import candidates, conversations, dependencies, iteration, join_graph, matching, operations, questions, retrieval, rollups, sql_audit
from tabulon.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_norm_text(spark):
    s = lambda x: X.norm_text(F.lit(x))
    got = one(spark, s("ＡＢｃ１２３"), s("京东 便利店（XX路店）"), s("São-Paulo"), s(None), s(""))
    assert list(got) == ["abc123", "京东便利店xx路店", "saopaulo", "", ""]


def test_trigrams(spark):
    sim = lambda a, b: X.trigram_similarity(F.lit(a), F.lit(b))
    got = one(spark, sim("word", "words"), sim("word", "word"), sim("", "x"), sim("", ""))
    assert list(got) == pytest.approx([4 / 7, 1.0, 0.0, 0.0])
    df = spark.createDataFrame([("word", "two words"), ("a", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(X.word_similarity("a", "b")).collect()] == pytest.approx([0.8, 0.0, 0.0])


def test_truncate(spark):
    t = lambda s, n: X.truncate_text(F.lit(s), n)
    assert list(one(spark, t("abcdef", 5), t("abcdef", 6), t("abcdef", 2), t("abc", 0), t(None, 5))) == ["ab...", "abcdef", "ab", "", ""]


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert list(one(spark, V.cosine_similarity(v(1, 0), v(1, 0)), V.cosine_similarity(v(0, 0), v(1, 0)), V.cosine_similarity(v(1, 0), v(-2, 0)))) == pytest.approx([1, 0, -1])
    with pytest.raises(Exception, match="norm zero"):
        one(spark, V.cosine_similarity(v(0, 0), v(1, 0), strict=True))


def test_top_k_threshold_before_clamp(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "object_id int, embedding array<float>")
    query = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.object_id, r.rank) for r in retrieval.top_k(query, corpus, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    low = retrieval.top_k(query, corpus, 10, threshold=-1.0, clamp=True).orderBy("rank").collect()
    assert [(r.object_id, r.similarity) for r in low] == [(1, 1.0), (3, 1.0), (4, 0.0), (2, 0.0)]
    assert retrieval.top_k(query.limit(0), corpus, 2).count() == 0


def _grams(text):
    return [p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]


def brute_word_similarity(a, b):
    """Best |A & E| / |A | E| over contiguous extents E of b's trigrams."""
    x, y = set(_grams(a or "")), _grams(b or "")
    extents = [set(y[i:j]) for i in range(len(y)) for j in range(i + 1, len(y) + 1)]
    return max((len(x & e) / len(x | e) for e in extents), default=0.0)


def test_word_similarity_is_brute_force(spark):
    rnd = random.Random(2)
    names = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    odd = [None, "", "--", "aaa", "aaaaaaaa a", "two words", "words two words", "São Paulo é", "京东 便利店", "x_y", "a b a b a b"]
    pairs = [(rnd.choice(names), rnd.choice(names) + rnd.choice(["", " small", "s"])) for _ in range(300)] + [(a, b) for a in odd for b in odd]
    spark.createDataFrame(pairs, "a string, b string").createOrReplaceTempView("word_pairs")
    X.register_functions(spark)
    got = spark.table("word_pairs").select("a", "b", X.word_similarity("a", "b").alias("w"), F.expr("word_similarity(a, b)").alias("s")).collect()
    assert all(r.w == r.s == pytest.approx(brute_word_similarity(r.a, r.b)) for r in got)


def test_prefix_join_loses_nothing_and_meets_little(spark):
    """Against all pairs; texts that share only frequent trigrams are no candidates."""
    rnd = random.Random(5)
    parts = ["".join(rnd.choices("abcdefghij", k=rnd.choice([3, 5, 8]))) for _ in range(120)]
    texts = ["market " + " ".join(rnd.choices(parts, k=rnd.choice([1, 2, 3]))) for _ in range(400)] + ["", "a", "ab", "market"]
    asked = [t[: rnd.randrange(1, len(t) + 1)] + rnd.choice(["", "x"]) for t in texts[:60]] + ["market", "a", ""]
    q, v = spark.createDataFrame([(t,) for t in asked], "q string"), spark.createDataFrame([(t,) for t in texts + texts[:50]], "v string")
    for least in (0.3, 0.6):
        want = {}
        for a in set(asked):
            for b in set(texts):
                x, y = set(_grams(a)), set(_grams(b))
                if x | y and len(x & y) / len(x | y) > least:
                    want[a, b] = len(x & y) / len(x | y)
        got = {(r.q, r.v): r.similarity for r in matching.similar_texts(q, v, least).collect()}
        assert got == pytest.approx(want)
        shared = sum(bool(set(_grams(a)) & set(_grams(b))) for a in set(asked) for b in set(texts))
        assert matching.candidate_pairs(q, v, least).count() <= (len(want) + shared // (4 if least == 0.3 else 20))


def test_look_up_word_similarity(spark):
    index = matching.value_index([("dim", spark.createDataFrame([(1, "Shenzhen City"), (2, "Shenzen"), (3, "Beijing"), (4, None)], "k int, v string"), "v", "k")])
    asks = spark.createDataFrame([("q", "shenzhen")], "query_id string, query_value string")
    got = matching.look_up(asks, index, 5).orderBy("rank").collect()
    brute = sorted((round(brute_word_similarity(v, "shenzhen"), 9) for v in ("shenzhencity", "shenzen")), reverse=True)
    assert [round(r.score, 9) for r in got] == brute and index.count() == 3


def test_best_ties_and_missing_scores(spark):
    m = spark.createDataFrame([("q", 0, 0.5, 2, "b"), ("q", 0, 0.5, 1, "a"), ("q", 1, None, 3, "c")], "query_id string, source_index int, score double, ordinal int, matched_text string")
    assert sorted(r.matched_text for r in matching.best(m).collect()) == ["a", "c"]
    assert matching.at_least(m, 0.1).count() == 2


EDGE = "src_table string, dst_table string, `on` string, join_type string, cardinality string, cost double"


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", "x", None, "N:1", 1.0), ("b", "c", "x", None, "N:1", None), ("a", "c", "x", None, "N:1", 5.0), ("a", "b", "y", None, "N:1", 3.0)], EDGE)
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "lone")], "base string, target string")
    cheap = {(r.base, r.target): (r.cost, r.nodes) for r in join_graph.paths(edges, pairs).collect()}
    assert cheap == {("a", "c"): (2.0, ["a", "b", "c"]), ("c", "a"): (2.0, ["c", "b", "a"])}
    short = {(r.base, r.target): r.hops for r in join_graph.paths(edges, pairs, "hops", 1).collect()}
    assert short == {("a", "c"): 1, ("c", "a"): 1}
    plan = join_graph.plans(join_graph.find_paths(edges, pairs)).orderBy("base").collect()
    assert [(p.base, len(p.edges), p.total_cost) for p in plan] == [("a", 2, 2.0), ("c", 2, 2.0)]
    text = join_graph.plan_text(join_graph.plans(join_graph.find_paths(edges, pairs))).orderBy("base").first().text
    assert text.startswith("base a, cost 2\nINNER JOIN a -> b ON x")
    bad = spark.createDataFrame([("", None)], "base string, edges array<struct<src_table:string,dst_table:string,on:string>>")
    assert bad.select(join_graph.plan_errors()).first()[0] == ["base is missing", "edges are missing"]


def test_apply_plan_reports_fan_out(spark):
    t = {"a": spark.createDataFrame([(1,), (2,)], "x int"), "b": spark.createDataFrame([(1, 7), (1, 8)], "y int, z int")}
    edge = {"src_table": "b", "dst_table": "a", "on": "SRC.y = DST.x", "join_type": "LEFT JOIN", "cardinality": "N:1"}
    df, fan = join_graph.apply_plan("a", [edge], t)
    assert df.count() == 3 and fan == ["b -> a"]
    with pytest.raises(ValueError, match="not connected"):
        join_graph.apply_plan("a", [{**edge, "src_table": "c", "dst_table": "d"}], t)


SUB = "query_id string, sub_query_id string, status string, dependencies array<string>"


@pytest.mark.parametrize(
    ("deps", "cycle", "levels"),
    [
        ({"a": [], "b": ["a"], "c": ["b"]}, False, {"a": 0, "b": 1, "c": 2}),
        ({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}, False, {"a": 0, "b": 1, "c": 1, "d": 2}),
        ({"a": ["b"], "b": ["a"], "c": []}, True, {"a": None, "b": None, "c": 0}),
        ({"a": ["a"]}, True, {"a": None}),
        ({"a": ["gone"]}, False, {"a": None}),
    ],
)
def test_dependency_graphs(spark, deps, cycle, levels):
    sub = spark.createDataFrame([("q", k, None, v) for k, v in deps.items()], SUB)
    assert dependencies.cyclic(sub).first().has_cycle is cycle
    assert {r.sub_query_id: r.level for r in dependencies.levels(sub).collect()} == levels


def test_stop_rule_order(spark):
    sub = spark.createDataFrame([("done", "a", "completed", []), ("late", "a", "pending", []), ("stuck", "a", "pending", ["b"]), ("stuck", "b", "failed", []), ("go", "a", None, [])], SUB)
    rounds = spark.createDataFrame([("done", 9), ("late", 5), ("stuck", 1), ("go", 1)], "query_id string, round int")
    assert {r.query_id: (r.action, r.round) for r in dependencies.stop_rule(sub, rounds).collect()} == {"done": ("stop", 9), "late": ("fail_rounds", 5), "stuck": ("fail_deadlock", 1), "go": ("continue", 2)}


def test_thread_ids(spark):
    ids = ["guest:20260305T183946997Z", "guest:20260305T183946997", "guest:20260305T1839469Z", "a#b:20260305T183946997Z", "x" * 65 + ":20260305T183946997Z", None]
    df = spark.createDataFrame([(i,) for i in ids], "t string").select(conversations.valid_thread(F.col("t")), conversations.thread_user(F.col("t")), conversations.thread_time(F.col("t")).cast("string"))
    got = df.collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False]
    assert got[0][2] == "2026-03-05 18:39:46.997" and got[1][1] == "guest"


def test_verdicts(spark):
    texts = ["SELECT 1", "with a as (select 1) select * from a", "drop table t", "SELECT created_at, deleted_flag FROM t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "", "   "]
    df = sql_audit.verdict(spark.createDataFrame([(t,) for t in texts], "sql string"))
    assert [r.layer for r in df.collect()] == ["all_passed", "all_passed", "security", "all_passed", "syntax", "security", "syntax", "syntax"]


def test_explain_and_execute(spark):
    assert sql_audit.explain_error(spark, "SELECT no_column FROM range(3)")
    assert sql_audit.explain_error(spark, "SELECT id FROM range(3)") is None
    log = {r.sql: r for r in sql_audit.execute_all(spark, ["SELECT id FROM range(3)", "SELECT nothing"], set()).collect()}
    assert log["SELECT id FROM range(3)"].row_count == 3 and not log["SELECT nothing"].success


def test_periods_do_not_skip_gaps(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE'2024-01-01', 10.0D), (DATE'2024-03-01', 30.0D), (DATE'2024-04-01', 0.0D), (DATE'2024-05-01', 5.0D) t(p, m)")
    got = {str(r.p): r.growth for r in questions.month_over_month(df, "p", "m").collect()}
    assert got == {"2024-01-01": None, "2024-03-01": None, "2024-04-01": -1.0, "2024-05-01": None}


def test_responses(spark):
    assert one(spark, rollups.clean_response(F.lit("<think>a\nb</think>\n```sql\nSELECT 1\n```")))[0] == "SELECT 1"
    retry = lambda m: operations.retryable(F.lit(m))
    assert list(one(spark, retry("HTTP 400 Bad Request"), retry("timed out"))) == [False, True]


def test_upsert_and_append_columns(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "s int, p int, v string")
    new = spark.createDataFrame([(2, 1, 9), (3, 1, 9)], "p int, s int, extra int")
    got = {(r.s, r.p): r.v for r in tables.upsert(old, new, ["s", "p"]).collect()}
    assert got == {(1, 1): "a", (1, 2): None, (1, 3): None}


def test_functions_in_sql(spark):
    X.register_functions(spark)
    texts = ["ＡＢｃ１２３", "京东 便利店（XX路店）", "São-Paulo's \\x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("o", F.lit("sao paulo"))
    got = df.selectExpr("norm_text(s) AS n", "trigrams(s) AS g", "trigram_similarity(s, o) AS t", "truncate_text(s, 5) AS c", "word_similarity(s, o) AS w").collect()
    want = df.select(X.norm_text(F.col("s")), X.trigrams(F.col("s")), X.trigram_similarity(F.col("s"), F.col("o")), X.truncate_text(F.col("s"), 5), X.word_similarity("s", "o")).collect()
    assert [tuple(r)[:2] + tuple(r)[3:] for r in got] == [tuple(r)[:2] + tuple(r)[3:] for r in want]
    assert got[2].t == pytest.approx(want[2][2])
    assert list(spark.sql("SELECT cosine_similarity(array(1D, 0D), array(2D, 2D)), cosine_similarity(array(0D), array(1D))").first()) == pytest.approx([0.5**0.5, 0.0])


CANDIDATES = "query_id string, `group` string, table_name string, place int, similarity double"


def test_one_dimension_is_enough(spark):
    rows = [
        ("alone", "dimension", "d1", 1, 0.1), ("two", "dimension", "d1", 1, 0.9), ("two", "dimension", "d2", 2, 0.8), ("time", "dimension", "d1", 1, 0.9), ("over", "dimension", "d1", 1, 0.80), ("over", "fact", "f1", 1, 0.70),
        ("gap", "dimension", "d1", 1, 0.75), ("gap", "fact", "f1", 1, 0.70), ("blind", "dimension", "d1", 1, None), ("blind", "fact", "f1", 1, None), ("bridge", "bridge", "b1", 1, 0.9), ("many", "dimension", "d1", 1, 0.9), ("many", "dimension", "d2", 2, 0.2), ("many", "fact", "f1", 1, 0.1),
    ]
    asked = spark.createDataFrame([(q, q == "time") for q in ("alone", "two", "time", "over", "gap", "blind", "bridge", "many", "none")], "query_id string, has_time boolean")
    got = {r.query_id: r.table_name for r in candidates.dimension_only(spark.createDataFrame(rows, CANDIDATES), asked).collect()}
    # 0.70 + 0.05 is not less than 0.75: the gap is strict.
    assert got == {"alone": "d1", "two": None, "time": None, "over": "d1", "gap": None, "blind": None, "bridge": None, "many": None, "none": None}


def test_question_plans(spark):
    edges = spark.createDataFrame([("f1", "d1", "x", None, "N:1", 1.0), ("d1", "d2", "x", None, "N:1", 1.0), ("f1", "b1", "x", None, "N:1", 1.0), ("d3", "d4", "x", None, "N:1", 1.0)], EDGE)
    rows = [
        ("facts", "fact", "f1", 2, 0.5), ("facts", "fact", "f0", 1, 0.4), ("facts", "dimension", "d1", 1, 0.3), ("facts", "dimension", "d2", 2, 0.9), ("facts", "bridge", "b1", 1, 0.9), ("one", "dimension", "d9", 1, 0.1),
        ("single", "fact", "f1", 1, 0.1), ("bridges", "bridge", "b1", 1, 0.9), ("dims", "dimension", "d1", 1, 0.2), ("dims", "dimension", "d2", 2, 0.2), ("dims", "dimension", "d4", 3, 0.9), ("tie", "fact", "f0", 2, 0.5), ("tie", "fact", "f1", 1, 0.5),
    ]
    asked = spark.createDataFrame([(q, False) for q in ("facts", "one", "single", "bridges", "dims", "tie")], "query_id string, has_time boolean")
    got = {r.query_id: (r.base, r.targets, [(e.src_table, e.dst_table) for e in r.edges]) for r in candidates.question_plans(spark.createDataFrame(rows, CANDIDATES), asked, edges).collect()}
    assert got == {
        "facts": ("f1", ["f0", "d1", "d2", "b1"], [("f1", "d1"), ("d1", "d2"), ("f1", "b1")]), "one": ("d9", [], []), "single": ("f1", [], []),
        "dims": ("d1", ["d2", "d4"], [("d1", "d2")]), "tie": ("f1", ["f0"], []),
    }


def test_a_running_question_is_no_deadlock(spark):
    sub = spark.createDataFrame([("run", "a", "in_progress", []), ("run", "b", "pending", ["a"]), ("busy", "a", "in_progress", []), ("late", "a", "in_progress", [])], SUB)
    rounds = spark.createDataFrame([("run", 1), ("busy", 1), ("late", 9)], "query_id string, round int")
    assert {r.query_id: r.action for r in dependencies.stop_rule(sub, rounds).collect()} == {"run": "fail_deadlock", "busy": "continue", "late": "fail_rounds"}
    got = {(r.query_id, r.sub_query_id): (r.status, r.error is not None) for r in dependencies.stopped(sub, rounds).collect()}
    assert got == {("run", "a"): ("in_progress", False), ("run", "b"): ("failed", True), ("busy", "a"): ("in_progress", False), ("late", "a"): ("failed", True)}


def test_value_hits(spark):
    index = matching.value_index([("dim", spark.createDataFrame([(1, "Shenzhen"), (2, "Beijing")], "k int, v string"), "v", "k")])
    dims = "array<struct<text:string,role:string>>"
    parsed = spark.createDataFrame([("q", ([("x", "column"), (" shenzhen ", "value"), ("shenzhen", "value"), ("  ", "value")],)), ("r", ([("beijing", "value")],))], f"query_id string, parse_result struct<dimensions:{dims}>")
    got = sorted((r.query_id, r.source_index, r.source_text, r.matched_text) for r in matching.value_hits(parsed, index).collect())
    assert got == [("q", 1, "shenzhen", "Shenzhen"), ("q", 1, "shenzhen", "Shenzhen"), ("r", 0, "beijing", "Beijing")]


def test_predicates_escape_quotes(spark):
    predicate, _ = matching.suggested_predicate()
    df = spark.createDataFrame([("t", "c", "k", "O'Neil", "x", 1.0), ("t", "c", "", "", "it's", 1.0)], "dim_table string, dim_col string, key_col string, key_value string, matched_text string, score double")
    assert [r[0] for r in df.select(predicate).collect()] == ["t.k='O''Neil'", "t.c LIKE '%it''s%'"]


def test_catalogue_and_logs(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("known_table")
    assert [tuple(r) for r in sql_audit.table_columns(spark, "known_table").collect()] == [(1, "id", "bigint")]
    assert sql_audit.table_columns(spark, "no_such_table").count() == 0
    meta = operations.column_metadata({"a": spark.createDataFrame([(1, "x")], "p int, q string"), "b": spark.range(1)}).collect()
    assert [tuple(r) for r in meta] == [("a", 1, "p", "int"), ("a", 2, "q", "string"), ("b", 1, "id", "bigint")]
    assert one(spark, rollups.error_bullets(F.array(F.lit("x"), F.lit("y"))))[0] == "- x\n- y"
    (tmp_path / "log.txt").write_text("one\ntwo\n")
    assert [r.value for r in tables.text_log(spark, str(tmp_path / "log.txt")).collect()] == ["one", "two"]
    tables.write_report(spark.range(2), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2 and tables.grid(spark.range(50)).count() == 20
    like = spark.createDataFrame([(1, "a")], "k int, v string")
    like.write.parquet(str(tmp_path / "t"))
    tables.append(spark.createDataFrame([("b", 2)], "v string, k int"), like, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "b")]


def test_turns_are_written_by_day(spark, tmp_path):
    turns = spark.sql("SELECT * FROM VALUES ('u:1', 'q1', 'hi', 'ho', TIMESTAMP'2024-01-01 01:00:00'), ('u:1', 'q2', 'hi', 'ho', TIMESTAMP'2024-01-02 01:00:00') t(thread_id, query_id, question, answer, created_at)").withColumn("updated_at", F.col("created_at"))
    conversations.write_turns(turns, str(tmp_path / "turns"))
    assert sorted(p.name for p in (tmp_path / "turns").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]


def test_many_queries_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "object_id int, embedding array<float>")
    asked = corpus.withColumnRenamed("object_id", "query_id")
    key = lambda df: sorted((r.query_id, r.rank, r.object_id) for r in df.collect())
    whole = key(retrieval.top_k(asked, corpus, 4))
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    assert key(retrieval.top_k(asked, corpus, 4)) == whole and len(whole) == 240


def test_searches_of_many_kinds(spark, monkeypatch):
    """Each search ranks its own type and takes its own k and threshold, in whatever blocks."""
    rnd = random.Random(1)
    store = [(f"o{i}", rnd.choice("abc"), [rnd.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [("none", "a", None), ("zero", "a", [0.0] * 4)]
    searches = [(i, rnd.choice("abcd"), [rnd.gauss(0, 1) for _ in range(4)], rnd.choice([1, 3, 500]), rnd.choice([-1.0, 0.5])) for i in range(40)] + [(99, "a", None, 3, 0.0)]

    def cosine(x, y):
        size = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
        return sum(a * b for a, b in zip(x, y)) / size if size else 0.0

    want = {}
    for i, kind, x, k, least in searches:
        found = sorted((-round(cosine(x, y), 12), o) for o, t, y in store if t == kind and x and y and round(cosine(x, y), 12) >= least)
        want |= {(i, r): o for r, (_, o) in enumerate(found[:k], 1)}
    s = spark.createDataFrame(store, "object_id string, object_type string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(searches, "search_id int, object_type string, embedding array<double>, k int, threshold double")
    for block, cells in ((1 << 22, 1 << 22), (40, 64)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        assert {(r.search_id, r["rank"]): r.object_id for r in retrieval.search_all(q, s).collect()} == want


def test_retrieval_of_questions_without_anything(spark):
    """No hit at all, no dimension, a null parse result: empty lists and counters of 0."""
    kind = "query_id int, embedding array<double>, parse_result struct<dimensions:array<struct<text:string,role:string>>,time:string>"
    questions = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], ([], None)), (3, [1.0, 0.0], ([("x", "value"), ("gone", "column")], None))], kind)
    store = "object_id string, object_type string, embedding array<double>, parent_id string, table_category string, text_raw string, dim_table string, dim_col string, key_col string, key_value string, matched_text string, document string"
    rows = [("s.t", "table", [1.0, 0.1], None, "fact", "card", None, None, None, None, None, None), ("v1", "value", [1.0, 0.0], None, None, None, "d", "c", None, None, "one", None), ("v2", "value", [0.9, 0.1], None, None, None, "d", "e", None, None, "one", None)]
    texts = spark.createDataFrame([("x", [1.0, 0.0])], "text string, embedding array<double>")
    edges = spark.createDataFrame([("s.t", "public.d", "SRC.a = DST.b", None, "N:1", 1.0)], EDGE)
    got = {r.query_id: r for r in candidates.retrieve(questions, texts, spark.createDataFrame(rows, store), edges).collect()}
    assert (got[2].facts, got[2].value_hits, got[2].table_categories, got[2].base, got[2].table_count, got[2].join_plan_count) == ([], [], {}, None, 0, 0)
    assert (got[1].facts, got[1].dimensions, got[1].base, got[1].targets, got[1].cards) == (["s.t"], [], "s.t", [], {"s.t": "card"})
    # Two columns of one table that one text hits are two hits; the table is one candidate.
    assert [(h.dim_col, h.matched_text, h.source_index) for h in got[3].value_hits] == [("c", "one", 0), ("e", "one", 0)]
    assert (got[3].dimensions, got[3].targets, [e.on for e in got[3].edges], got[3].dim_match_count) == (["public.d"], ["public.d"], ["SRC.a = DST.b"], 2)
    none = candidates.retrieve(questions, texts, spark.createDataFrame([], store), edges).collect()
    assert len(none) == 3 and all(r.facts == [] and r.base is None for r in none)


def test_value_hits_are_one_for_each_value(spark):
    """By key, else by text, within a column; the best, and the order in which values were met."""
    rows = [(1, 1, "d", "c", "k1", "a", 0.5), (1, 2, "d", "c", "k1", "b", 0.9), (1, 3, "d", "c", "", "a", 0.9), (1, 4, "d", "x", "k1", "a", 0.5), (1, 5, "e", "c", "k1", "a", None), (2, 1, "d", "c", None, "a", 0.1)]
    hits = spark.createDataFrame(rows, "query_id int, ordinal int, dim_table string, dim_col string, key_value string, matched_text string, score double")
    hits = hits.withColumn("source_index", F.lit(0)).withColumn("source_text", F.lit("t")).withColumn("key_col", F.lit("k")).withColumn("table_name", F.col("dim_table"))
    got = {r.query_id: [(h.dim_table, h.dim_col, h.key_value, h.matched_text) for h in r.value_hits] for r in candidates.listed_hits(hits).collect()}
    assert got == {1: [("d", "c", "k1", "b"), ("d", "c", "", "a"), ("d", "x", "k1", "a"), ("e", "c", "k1", "a")], 2: [("d", "c", None, "a")]}


def test_paths_are_brute_force(spark):
    """Random graphs with ties: every pair's least (cost, hops, nodes), and the fewest hops."""
    rnd = random.Random(9)
    nodes = [f"n{i}" for i in range(9)]
    edges = {(a, b): float(rnd.choice([1, 1, 2])) for a in nodes for b in nodes if a < b and rnd.random() < 0.35}
    step = {**edges, **{(b, a): c for (a, b), c in edges.items()}}
    found = {}

    def walk(path, cost):
        for by, key in (("cost", (cost, len(path), path)), ("hops", (len(path), cost, path))):
            at = (by, path[0], path[-1])
            found[at] = min(found.get(at, key), key)
        for (a, b), c in step.items():
            if a == path[-1] and b not in path:
                walk([*path, b], cost + c)

    for n in nodes:
        walk([n], 0.0)
    e = spark.createDataFrame([(a, b, "x", None, "N:1", c) for (a, b), c in edges.items()], EDGE)
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "base string, target string")
    for by in ("cost", "hops"):
        got = {(by, r.base, r.target): r for r in join_graph.paths(e, pairs, by).collect()}
        assert {k: r.nodes for k, r in got.items()} == {k: v[2] for k, v in found.items() if k[0] == by}
        for r in got.values():
            assert r.hops == len(r.edges) == len(r.nodes) - 1 and r.cost == sum(x.cost for x in r.edges)
            assert all({x.src_table, x.dst_table} == {a, b} for x, a, b in zip(r.edges, r.nodes, r.nodes[1:]))


def test_long_paths_take_few_rounds_to_unroll(spark, monkeypatch):
    n, made = 40, []
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "x", None, "N:1", 1.0) for i in range(n)], EDGE)
    stored = join_graph.stored
    monkeypatch.setattr(join_graph, "stored", lambda df, name, *by: made.append(name) or stored(df, name, *by))
    found = join_graph.paths(edges, spark.createDataFrame([("n000", f"n{n:03}")], "base string, target string")).first()
    assert found.nodes == [f"n{i:03}" for i in range(n + 1)] and found.cost == n
    assert made.count("jumps") == 5 and made.count("ranks") == 0


def test_levels(spark, monkeypatch):
    """Random graphs with cycles and unknown ids by peeling; a chain of 500 takes 10 written rounds."""
    rnd, rows, want = random.Random(3), [], {}
    for q in range(40):
        n, deps, level = rnd.randrange(1, 14), {}, {}
        for i in range(n):
            pool = [f"s{j}" for j in range(i)] if rnd.random() < 0.85 else [f"s{j}" for j in range(n)] + ["nope"]
            deps[f"s{i}"] = rnd.sample(pool, min(len(pool), rnd.choice([0, 1, 1, 1, 2, 3])))
        while new := {k: max((level[d] for d in ds), default=-1) + 1 for k, ds in deps.items() if k not in level and all(d in level for d in ds)}:
            level |= new
        want |= {(q, k): level.get(k) for k in deps}
        rows += [(q, k, v) for k, v in deps.items()]
    kind = "query_id int, sub_query_id string, dependencies array<string>"
    assert {(r.query_id, r.sub_query_id): r.level for r in dependencies.levels(spark.createDataFrame(rows, kind)).collect()} == want
    made, stored = [], dependencies.stored
    monkeypatch.setattr(dependencies, "stored", lambda df, name, *by: made.append(name) or stored(df, name, *by))
    chain = spark.createDataFrame([(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(500)], kind)
    assert {r.sub_query_id: r.level for r in dependencies.levels(chain).collect()} == {f"c{i}": i for i in range(500)}
    assert made.count("chains") <= 11 and made.count("waits") <= 2


SHAPES = [
    ("SELECT ';' AS x", 1, ""), ("SELECT 1;;", 2, ""), ("SELECT 1; -- done", 1, ""), ("SELECT 1;\n-- done", 2, ""), ("SELECT 1; /* x */", 2, ""), ("SELECT 1;\n  ", 1, ""), ("  ", 0, ""), (None, 0, ""),
    ("SELECT 'it''s; from a' FROM t;", 1, "t"), ("SELECT 'a\\'; b' FROM t", 1, "t"), ("SELECT 'open ; FROM x", 2, "x"), ('SELECT "a;b" FROM "my t"', 1, '"my t"'), ("SELECT `from` FROM `db`.`t x`", 1, "`db`.`t x`"),
    ("SELECT extract(year FROM ts) FROM t", 1, "t"), ("SELECT 'from a' FROM t -- from b\n JOIN u ON true", 1, "t,u"), ("SELECT a IS DISTINCT FROM b FROM t", 1, "t"), ("SELECT (1; 2) FROM t", 1, "t"), ("DELETE FROM t", 1, "t"),
    ("SELECT * FROM a, b AS x, (SELECT 1 FROM c WHERE d IN (SELECT e FROM f)) g, h WHERE i = 'from z'", 1, "a,b,c,f,h"), ("SELECT * FROM (a JOIN b ON 1 = 1) LEFT JOIN s . c USING (k)", 1, "a,b,s.c"),
    ("SELECT * FROM generate_series(1, 2) g JOIN LATERAL (SELECT 1 FROM q) z ON true", 1, "q"), ("SELECT count(*), max(x) FROM a JOIN b ON f(a.x, b.y) = 1, c GROUP BY d, e", 1, "a,b,c"), ("select x from t1 union select y from t2, t3 limit 3", 1, "t1,t2,t3"),
]


def test_statement_shapes(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(SHAPES)], "i int, sql string")
    got = df.select("i", sql_audit.statements(F.col("sql")).alias("n"), F.array_join(sql_audit.tables_used(F.col("sql")), ",").alias("tables")).collect()
    assert {r.i: (r.n, r.tables) for r in got} == {i: x[1:] for i, x in enumerate(SHAPES)}


def test_matching_by_parts(spark):
    values = ["abcd", "xabcx", "ab", "b", "", None, "zz", "été"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for parts in (["abc"], ["b"], ["ab", "é"], [""], ["nope"], [None]):
        f = spark.createDataFrame([(p, 0.5) for p in parts] + [("zz", 0.9)], "value string, score double")
        want = sorted(v for v in values if v is not None and (v == "zz" or any(p is not None and p in v for p in parts)))
        assert sorted(r.v for r in questions.matching(df, f, "v").collect()) == want


def test_runs_of_many_statements(spark):
    log = sql_audit.execute_all(spark, ["SELECT id FROM range(5)", "SELECT 1 AS x", "SELECT broken"], {"SELECT 1 AS x"}, most=2).cache()
    got = {r.sql: (r.success, r.row_count, r.rows) for r in log.collect()}
    assert got == {"SELECT id FROM range(5)": (True, 5, ['{"id":0}', '{"id":1}']), "SELECT broken": (False, 0, [])}
    asked = spark.createDataFrame([("SELECT broken",), ("SELECT 2",)], "sql string")
    assert [r.sql for r in sql_audit.pending(asked, log).collect()] == ["SELECT 2"]
    times = spark.createDataFrame([(0.0, 10.0), (5.0, 10.0), (10.0, 1.0), (30.0, 1.0)], "began_ms double, execution_time_ms double")
    assert sql_audit.parallelism(times).first().most == 2 and sql_audit.parallelism(times.limit(0)).first().most == 0


def test_scratch_tables_are_cleared(spark):
    import os

    df = iteration.stored(spark.range(3), "cleared")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(path)
    iteration.clear(spark)
    assert not os.path.exists(path)
