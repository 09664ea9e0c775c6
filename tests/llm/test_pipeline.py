"""The pipeline's stages, each held against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_text_operators import WORD, brute_components

from tabulon.llm import common, mixing, quality, token_shards

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage."""
    docs, out = common.documents(spark, FOLDER), {}
    for name, stage in corpus_pipeline.STAGES:
        done = common.stored(stage(spark, docs, FOLDER), name)
        out[name] = (docs, done)
        docs = done
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages, spark):
    for name, (_, out) in stages.items():
        if name != "token_output":
            assert out.columns == common.documents(spark, FOLDER).columns, name


def test_quality_stage(stages, spark):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.score_quality(before, labels).collect()
    assert set(texts(after)) == {r.doc_id for r in scored if r.predicted}
    known = {r.doc_id: r.quality for r in labels.collect()}
    kept = set(texts(after))
    assert all(i in kept for i, q in known.items() if q == 1)
    assert sum(i in kept for i, q in known.items() if q == 0) <= 0.1 * sum(q == 0 for q in known.values())


def test_near_copies_stage(stages):
    before, after = map(texts, stages["near_copies"])
    want = brute_components(list(before.items()))
    assert set(after) == {i for i, (n, c) in want.items() if c == i or not n}


def test_benchmark_stage(stages, spark):
    before, after = map(texts, stages["benchmark_leaks"])
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = {i for i, t in before.items() if any(x in plain(t) for x in items)}
    assert holds and not holds & set(after)
    # What else went holds an edited copy: most of an item's 3-grams.
    grams = lambda t: {tuple(w[i : i + 3]) for w in [t.split()] for i in range(len(w) - 2)}
    for i in set(before) - set(after) - holds:
        own = grams(plain(before[i]))
        assert max(len(own & grams(x)) / len(grams(x)) for x in items) > 0.2


def test_mixture_stage(stages):
    before, after = stages["mixture"]
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(before).collect()}
    got = Counter(r.doc_id for r in after.select("doc_id").collect())
    assert got == Counter({i: c for i, c in plan.items() if c})
    total = sum(len(WORD.findall(t)) for t in texts(before).values())
    mixed = sum(len(WORD.findall(r.text)) for r in after.select("text").collect())
    assert abs(mixed - 1.5 * total) < 0.02 * total


def test_token_stage(stages):
    before, after = stages["token_output"]
    encode = token_shards._encoder(token_shards.default_tokenizer())
    rows = after.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    per_doc = Counter()
    for r in rows:
        for s in r.docs:
            per_doc[s.doc_id] += s.n
    want = Counter()
    for r in before.select("doc_id", "text").collect():
        want[r.doc_id] += len(encode(r.text)) + 1
    assert per_doc == want


def test_run(stages, spark):
    done = corpus_pipeline.run(spark, FOLDER)
    want = stages["token_output"][1]
    assert done.columns == want.columns and done.count() == want.count()


def small_folder(path, spark, rows, labels):
    from test_text_operators import frame

    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    plain = [f"w{i} x{i} y{i} z{i} a{i} b{i} c{i} d{i}" for i in range(30)]
    rows = [*enumerate(plain), (40, None), (41, ""), (None, "no id at all here now"), (50, plain[3]), (60, "and one two three four five six seven eight nine ten too"), (70, "twice is one document"), (70, "twice is one document"), (80, "ab" * 100_000)]
    folder = small_folder(tmp_path / "in", spark, rows, [])
    docs = common.documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "quality":
            assert len(ids) == len(rows)
        if name == "near_copies":
            assert 3 in ids and 50 not in ids and ids.count(70) == 2 and None in ids and {40, 41} <= set(ids)
        if name == "benchmark_leaks":
            assert 60 not in ids and len(ids) == len(rows) - 2
        docs = out
    done = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    counts = Counter(r.doc_id for r in docs.collect())
    assert {s.doc_id for r in done for s in r.docs} == set(counts) and max(counts.values()) <= 4


def test_run_on_an_empty_table(spark, tmp_path):
    folder = small_folder(tmp_path / "in", spark, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
