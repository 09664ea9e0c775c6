"""What steps write and return must not grow faster than the input."""

from tabulon.operators import join_graph

EDGES = "src_table string, dst_table string, `on` string, join_type string, cardinality string, cost double"


def counted(monkeypatch, module, name):
    """Row counts of the tables that a module writes under this name."""
    counts, write = [], module.stored

    def stored(df, called, *by):
        out = write(df, called, *by)
        if called == name:
            counts.append(out.count())
        return out

    monkeypatch.setattr(module, "stored", stored)
    return counts


def test_paths_enter_no_dead_ends_in_vain(spark, monkeypatch):
    edges = [(f"t{i}", f"t{i // 3}", "SRC.k = DST.k", None, "N:1", float(1 + i % 3)) for i in range(1, 60)] + [("t1", "t2", "SRC.j = DST.j", None, "N:1", 1.0), ("a", "b", "SRC.k = DST.k", None, "N:1", 1.0)]
    edges = spark.createDataFrame(edges, EDGES)
    pairs = spark.createDataFrame([("t50", "t59"), ("t41", "t3"), ("t7", "t7"), ("a", "b"), ("t1", "a")], "base string, target string")
    got = {}
    for large in (1 << 30, 1):
        monkeypatch.setattr(join_graph, "LARGE", large)
        with monkeypatch.context() as m:
            sizes = counted(m, join_graph, "paths")
            got[large] = [tuple(r[:5]) for r in join_graph.paths(edges, pairs).orderBy("base", "target").collect()], max(sizes)
    assert got[1][0] == got[1 << 30][0] and [r[:2] for r in got[1][0]] == [("a", "b"), ("t41", "t3"), ("t50", "t59"), ("t7", "t7")]
    assert got[1][1] < 40 < 150 < got[1 << 30][1]


def test_parity_shuffles_no_pairs(spark, capsys):
    from tabulon.plans import QUERIES

    QUERIES["v_parity"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "MapInPandas" in plan and "Exchange" not in plan and "Join" not in plan


def test_hits_of_later_batches_are_held_only_if_better(monkeypatch):
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from tabulon.operators import retrieval

    sizes, best, rng = [], retrieval._best, np.random.default_rng(5)
    monkeypatch.setattr(retrieval, "_best", lambda found: (sizes.append(len(found)), best(found))[1])
    x, q = rng.normal(size=(4000, 8)), rng.normal(size=(50, 8))
    table = pa.table({"query_id": range(50), "object_type": [""] * 50, "embedding": pa.array(q.tolist(), pa.list_(pa.float64())), "k": pa.array([3] * 50, pa.int32()), "threshold": [-1.0] * 50})
    frames = (pd.DataFrame({"object_type": "", "object_id": range(a, a + 200), "embedding": list(x[a : a + 200])}) for a in range(0, 4000, 200))
    got = pd.concat(retrieval._scorer(table)(frames))
    sim = np.round((q @ x.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)), 12)
    assert sorted(zip(got["query_id"], got["object_id"])) == [(i, j) for i in range(50) for j in sorted(np.argsort(-sim[i], kind="stable")[:3])]
    assert max(sizes) <= 2 * 150


def test_look_up_of_repeated_texts(spark, monkeypatch):
    """Rows that repeat a text and queries that ask the same do not multiply before the best are taken."""
    import tabulon.operators.matching as matching

    parts = [(i, ["red bolt", "red bolts", "new anvil"][i % 3]) for i in range(900)]
    index = matching.value_index([("part", spark.createDataFrame(parts, "k int, v string"), "v", "k")])
    asks = spark.createDataFrame([(i, ["red bolt", "new anvill"][i % 2]) for i in range(100)], "query_id int, query_value string")
    sizes = counted(monkeypatch, matching, "rows"), counted(monkeypatch, matching, "ranked")
    got = {}
    for r in matching.look_up(asks, index, 4, method="similarity", min_score=0.4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.matched_text, int(r.key_value)))
    # Equal scores go by the text of the key.
    firsts = lambda j: [int(x) for x in sorted(str(i) for i in range(j, 900, 3))[:4]]
    # The index holds norms without blanks, so neither bolt equals what is asked.
    assert got.keys() == {i for i in range(100) if (i % 2 == 0 and got.get(0)) or (i % 2 == 1 and got.get(1))} and got
    for i, rows in got.items():
        assert sorted(rows) == [(n, ["red bolt", "new anvil"][i % 2], key) for n, key in enumerate(firsts([0, 2][i % 2]), 1)]
    assert sizes[0] == [3 * 8] and sizes[1][0] <= 2 * 4


def test_candidates_are_dealt_once(spark, capsys):
    from tabulon.operators import candidates as C
    from tabulon.operators.iteration import stored

    tables = spark.createDataFrame([(1, "a", 0.5, "FACT", 1), (1, "a", 0.4, "dim", 2), (1, "b", 0.3, "", 3), (2, "c", 0.9, None, 1)], "query_id int, table_name string, similarity double, table_category string, ordinal int")
    columns = spark.createDataFrame([(1, "a", "x", 0.9, 1), (1, "d", "x", 0.2, 2), (1, "e", None, 0.1, 3), (2, None, "y", 0.3, 1)], "query_id int, parent_id string, source_text string, similarity double, ordinal int")
    values = spark.createDataFrame([(1, "b", 1), (3, "f", 1)], "query_id int, table_name string, ordinal int")
    catalogue = spark.createDataFrame([("d", "bridge"), ("e", "fact"), ("b", "fact")], "object_id string, table_category string")
    got = C.scored(tables, columns, values, catalogue)
    par = C.parents(columns, C.category_map(tables, columns, catalogue))
    want = C.merged(tables, par, values).join(C.similarities(tables, par), ["query_id", "table_name"], "left")
    names = ["query_id", "group", "table_name", "place", "similarity"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    assert {(r.table_name, r.table_category) for r in got.collect()} == {("a", "dim"), ("b", "fact"), ("c", None), ("d", "bridge"), ("e", "fact"), ("f", None)}
    capsys.readouterr()
    C.scored(tables, columns, values, stored(catalogue, "catalogue")).explain()
    assert capsys.readouterr().out.count("hashpartitioning(query_id") == 1


def test_encoded_texts_return_in_large_batches(spark, monkeypatch):
    from tabulon.operators import retrieval

    def encode(texts):
        return [[float(len(t)), float(len(texts)), 0.5, -1.0, 2.0] for t in texts]

    def run():
        out = retrieval.encode_texts(rows, encode)
        found, plan = out.collect(), out._jdf.queryExecution().executedPlan()
        while not plan.metrics().contains("pythonDataReceived"):
            plan = plan.children().apply(0)
        return found, plan.metrics().apply("pythonDataReceived").value()

    ids = [None, *range((1 << 60) + 1, (1 << 60) + 1000)]
    rows = spark.createDataFrame([(i, " " if n % 100 == 7 else "x" * (n % 30 + 1)) for n, i in enumerate(ids)], "id bigint, text string").coalesce(1)
    want = [(i, n % 30 + 1) for n, i in enumerate(ids) if n % 100 != 7]
    found, size = run()
    # Ids take 8 bytes, offsets 4 and vectors 20; a null costs bits.
    assert size < 40 * len(found)
    monkeypatch.setattr(retrieval, "BLOCK", 500)
    blocks, more = run()
    assert blocks == found and more > size
    assert [(r.id, r.embedding[0]) for r in found] == want
    assert [r.embedding[1] for r in found] == [20.0] * 980 + [10.0] * 10 and {tuple(r.embedding[2:]) for r in found} == {(0.5, -1.0, 2.0)}


def test_an_encoder_that_miscounts_is_an_error():
    import pyarrow as pa
    import pytest

    from tabulon.operators import retrieval

    # One call is short by a vector and the next has one too many: together they would fit.
    calls = iter([[[1.0]], [[1.0], [2.0], [3.0]]])

    class Texts:
        schema = {"id": type("f", (), {"dataType": type("t", (), {"simpleString": lambda self: "int"})()})}
        select = where = lambda self, *_: self
        mapInArrow = lambda self, each, _: each

    each = retrieval.encode_texts(Texts(), lambda _: next(calls), 2)
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        list(each([pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["a", "b", "c", "d"]})]))


def test_texts_of_a_single_row_group_are_dealt_out(spark, capsys):
    from tabulon.plans import QUERIES

    QUERIES["v_encode"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.index("MapInArrow") < plan.index("Exchange hashpartitioning(id")


def test_graph_steps_of_many_tables_send_nothing_through_the_driver(spark, capsys, monkeypatch):
    from tabulon.operators import candidates as C
    from tabulon.operators import iteration

    plans, write = [], iteration.stored

    def stored(df, called, *by):
        df.explain()
        plans.append((called, capsys.readouterr().out))
        return write(df, called, *by)

    edges = spark.createDataFrame([(f"t{i:03}", f"t{i // 3:03}", "SRC.k = DST.k", None, "N:1", float(1 + i % 3)) for i in range(1, 27)], EDGES)
    rows = [(q, "dimension", f"t{(7 * q + 11 * p) % 29:03}", p, 0.5 + (q * p) % 5 / 10) for q in range(4) for p in range(1, 5)]
    candidates = spark.createDataFrame(rows, "query_id int, `group` string, table_name string, place int, similarity double")
    tasks = spark.createDataFrame([(q, True) for q in range(4)], "query_id int, has_time boolean")
    got = {}
    for most in (1 << 30, 0):
        monkeypatch.setattr(iteration, "SENT", most)
        monkeypatch.setattr(join_graph, "LARGE", 1)
        with monkeypatch.context() as m:
            m.setattr(join_graph, "stored", stored)
            m.setattr(C, "stored", stored)
            out = C.question_plans(candidates, tasks, edges)
        out = out.select("query_id", "base", "targets", "edges")
        got[most] = sorted(map(str, out.collect()))
    assert got[0] == got[1 << 30] and len(got[0]) == 4
    of_graph = [x for x in plans[len(plans) // 2 :] if x[0] != "bases"]
    assert {"paths", "own", "jumps", "rows", "tight", "found"} <= {x[0] for x in of_graph}
    assert not [x[0] for x in of_graph if "Broadcast" in x[1]]
    # The steps back along the paths do not double what is read.
    assert max(x[1].count("FileScan") for x in of_graph if x[0] in ("rows", "found")) <= 12


def test_context_deals_each_part_of_a_question_once(spark, capsys, monkeypatch):
    from tabulon.operators import candidates as C
    from tabulon.operators import iteration

    plans, write = {}, iteration.stored

    def stored(df, called, *by):
        df.explain()
        plans[called] = capsys.readouterr().out
        return write(df, called, *by)

    monkeypatch.setattr(C, "stored", stored)
    monkeypatch.setattr(join_graph, "stored", stored)
    hits = [(q, f"t{(q + p) % 5}", f"t{(q + 2 * p) % 5}", "s", 0.5 + p / 10, "fact" if (q + p) % 5 == 1 else "", p) for q in range(6) for p in range(4)]
    tables = write(spark.createDataFrame(hits, "query_id int, table_name string, parent_id string, source_text string, similarity double, table_category string, ordinal int"), "hits")
    values = tables.where("ordinal = 3").selectExpr("query_id", "table_name", "ordinal", "0 source_index", "'s' source_text", "'m' matched_text", "table_name dim_table", "'c' dim_col", "'k' key_col", "'' key_value", "similarity score")
    catalogue = write(spark.createDataFrame([(f"t{i}", "", f"card {i}") for i in range(4)], "object_id string, table_category string, text_raw string"), "catalogue")
    tasks = spark.createDataFrame([(q, q % 2 == 0) for q in range(6)], "query_id int, has_time boolean")
    examples = tables.where("ordinal < 2").selectExpr("query_id", "similarity", "ordinal", "struct(table_name sql) example")
    edges = write(spark.createDataFrame([(f"t{i}", f"t{i - 1}", "SRC.k = DST.k", None, "N:1", 1.0) for i in range(1, 4)], EDGES), "edges")
    out = C.context(tables, tables.drop("table_name", "table_category"), values, catalogue, tasks, edges, examples)
    out.explain()
    # Candidates, tasks, examples, value hits and counters; then the written rows stay where they are.
    assert plans["gathered"].count("hashpartitioning(query_id") == 5
    assert "hashpartitioning(query_id" not in capsys.readouterr().out
    row = out.where("query_id = 0").first()
    assert (row.facts, row.dimensions, row.base, row.targets) == (["t1"], ["t3", "t0", "t2", "t4"], "t1", ["t3", "t0", "t2", "t4"])
    assert [(e.src_table, e.dst_table) for e in row.edges] == [("t2", "t1"), ("t3", "t2"), ("t1", "t0")]
    assert (row.column_count, row.dim_match_count, row.join_plan_count, row.table_count, len(row.similar_sqls), set(row.cards)) == (4, 1, 1, 5, 2, {"t0", "t1", "t2", "t3"})
