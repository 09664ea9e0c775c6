"""Ranked search, whitening and sharding, held against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import corpus, empty, frame

from tabulon.llm import common, queries, ranked_search, rendezvous, whitening

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(rows, items, k):
    """rows, items: (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    total, every = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for place, (i, c) in enumerate(counts):
            m = 10 + (90 * sum(c.values()) * total) // every
            score = 0
            for w in words & set(c):
                df = sum(w in x for _, x in counts)
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, place, i))
        out += [(item, r, f[4], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def asked(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit("x"))


ITEMS = [(1, "w1 w2 W3, w4 w1"), (2, "loop"), (3, None), (4, "...!"), (5, "nowhere"), (None, "p1 p2 p3"), (6, "ü é Ü w7 w7"), (1, "w9"), (7, " ".join(f"w{i}" for i in range(400))), (2, "loop")]


@pytest.mark.parametrize("postings, cells", [(1 << 21, 1 << 20), (30, 7)])
def test_ranked_search(spark, monkeypatch, postings, cells):
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    rows = corpus()
    rows += [(i, t) for i, t in rows[:9]] + [(None, "w1 w2 w3"), (None, None), (900, "w1 w2 w3"), (901, "w1 w2 w3")]
    got = ranked_search.search(frame(spark, rows), asked(spark, ITEMS), 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, ITEMS, 4)


def test_ranked_search_on_nothing(spark):
    docs, items = frame(spark, corpus()), asked(spark, ITEMS)
    assert ranked_search.search(docs.limit(0), items).count() == 0
    none = ranked_search.search(docs, items.limit(0))
    assert none.count() == 0 and none.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert ranked_search.search(frame(spark, [(1, None), (2, "")]), items).count() == 0


def test_ranked_search_on_long_texts(spark):
    """A document over a slice of words and an item over a block of the index."""
    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randrange(60_000)}" for _ in range(300_000))
    rows = [(i, f"w{i} w{i + 1} w{i + 2}") for i in range(40)] + [(99, long)]
    items = [(1, long), (2, "w3 w4")]
    got = ranked_search.search(frame(spark, rows), asked(spark, items), 3).orderBy("item_id", "rank").collect()
    assert got[0].doc_id == 99 and got[3].doc_id == 2
    want = brute_search(rows, items[1:], 3)
    assert sorted((tuple(r) for r in got[3:]), key=str) == want


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**7])
    assert ranked_search.lengths(n, 10**12, 10**13).tolist() == [10 + 90 * x * 10**12 // 10**13 for x in (1, 10**7)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("x", F.lit("x")).withColumn("index", F.lit(1)).withColumn("n", F.lit(2))


def brute_whitening(rows, k):
    """Whole rows' ids, x vectors, whitened (up to sign), explained, deviation."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = Counter(len(v) for _, v in kept).most_common()
    width = min(w for w, c in width if c == width[0][1])
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in kept if len(v) == width]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    white = {(j, i): (x - sums / n) @ u[:, :k] / np.sqrt(e[:k]) for j, (i, x) in enumerate(kept)}
    return white, e[:k] / e.sum(), n, {(j, i): sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)) for j, (i, x) in enumerate(kept)}


@pytest.mark.parametrize("cells", [1 << 20, 6 * 50])
def test_whitening(spark, monkeypatch, cells):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", cells)
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(300, 6)) * np.array([1, 2, 3, 0.5, 4, 1.5])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base @ rnd.normal(size=(6, 6)))]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third are one vector, which counts once
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [math.nan] * 6), (2004, [math.inf] * 6), (2005, [1.0, 2.0]), (None, rows[3][1]), (5, rows[5][1])]
    white, explained, n, deviation = brute_whitening(rows, 4)
    got = whitening.whiten(vectors(spark, rows), "embedding", 4).select("row.vec_id", "row.x", "n", "deviation", "whitened", "explained", "identity_error").collect()
    assert len(got) == len(white)
    want = defaultdict(list)
    for (_, i), w in white.items():
        want[i].append(w)
    sign = None
    for r in sorted(got, key=lambda r: str(r.vec_id)):
        w = want[r.vec_id].pop()
        sign = np.sign(np.array(r.whitened) * w) if sign is None else sign
        assert np.allclose(np.array(r.whitened), sign * w, rtol=1e-8, atol=1e-9)
        assert r.n == n and r.x == "x" and r.identity_error < 1e-9 and np.allclose(r.explained, explained)
    assert Counter(int(r.deviation) for r in got) == Counter(deviation.values())


def test_whitening_of_few_dimensions(spark):
    """A direction without variance is no component; without any there are no rows."""
    flat = [(i, [float(i), float(2 * i), 1.0]) for i in range(20)]
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert len(got) == 20 and {len(r.whitened) for r in got} == {1} and {r.explained[0] for r in got} == {1.0}
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    none = whitening.whiten(vectors(spark, []))
    assert none.count() == 0 and none.columns == ["row", "n", "deviation", "whitened", "explained", "identity_error"]
    large = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 7.0])])).collect()
    assert len(large) == 3 and all(r.deviation is None or r.deviation >= 0 for r in large)


def test_whitening_query(spark):
    rows = [tuple(r) for r in duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()]
    white, explained, n, deviation = brute_whitening(rows, 4)
    white, deviation = ({i: v for (_, i), v in x.items()} for x in (white, deviation))
    got = queries.op12_whitening(spark, FOLDER).toPandas()
    assert len(got) == 4 * len(white) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-4
    for c, part in got.groupby("component"):
        own, want = part["whitened"].to_numpy(), np.array([white[i][c - 1] for i in part["vec_id"]])
        assert np.allclose(own, want) or np.allclose(own, -want)
        assert np.allclose(part["explained"], explained[c - 1])
    assert all(deviation[i] == d for i, d in zip(got["vec_id"], got["deviation"]))


def sharded(docs, **options):
    return rendezvous.shard_rows(docs, **options).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot", "grown_shard").collect()


@pytest.mark.parametrize("hot", [1 << 21, 20])
def test_sharding(spark, monkeypatch, hot):
    monkeypatch.setattr(rendezvous, "HOT", hot)
    rows = [(i, f"text {i} ü") for i in range(900)] + [(7, "same key")] * 300 + [(None, "x"), (None, None), (7, None)]
    got = sharded(frame(spark, rows), shards=8)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and r.grown_shard in (r.shard, 8)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[r.doc_id] == r.shard for r in got)
    # One more shard takes what it takes in a table with one more, and about a ninth.
    grown = {r.doc_id: r.shard for r in sharded(frame(spark, rows), shards=9)}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    assert 0.06 < sum(r.grown_shard == 8 for r in got if r.doc_id != 7) / 900 < 0.17


def test_sharding_does_not_depend_on_the_split(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(3, "text 3")] * 5
    one, other = (sorted(map(tuple, sharded(frame(spark, rows).repartition(n, "text"), shards=5))) for n in (1, 7))
    assert one == other


def test_weighted_sharding(spark):
    docs = frame(spark, [(i, "x") for i in range(6000)])
    n = Counter(r.shard for r in sharded(docs, shards=[1.0, 2.0, 3.0], keep=["doc_id", "text"]))
    assert all(abs(n[i] / 6000 - (i + 1) / 6) < 0.03 for i in range(3))
    with pytest.raises(ValueError):
        rendezvous.shard_rows(docs, [1.0, 0.0])
    assert rendezvous.shard_rows(empty(spark), 4).count() == 0


def test_written_shards(spark, tmp_path):
    """Files of a shard follow each other by slot; every row is in one of them with its columns."""
    rows = [(i, f"text {i}") for i in range(400)]
    rendezvous.write_shards(frame(spark, rows).withColumn("shard", F.lit("own")), str(tmp_path / "out"), 3, files=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text) for r in back.select("row.doc_id", "row.text").collect()} == set(rows)
    assert {r[0] for r in back.select("row.shard").distinct().collect()} == {"own"}
    for folder in sorted((tmp_path / "out").glob("shard=*")):
        slots = [r.slot for f in sorted(folder.glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("name", ["op11_reversed_search", "op13_rendezvous"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_documents_table_is_whole(spark):
    n = common.documents(spark, FOLDER).count()
    assert queries.op13_rendezvous(spark, FOLDER).count() == n
