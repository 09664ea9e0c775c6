"""Top-k vector retrieval for many queries at once, and the look-ups around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp01, cosine_similarity
from .iteration import stored

#: Entries of the query vectors in one block: 8 MB in each task.
BLOCK = 1 << 20
#: Similarities that a task holds at a time, and hits (or twice the best of all queries, if more) that it gathers before it keeps the best.
CELLS = 1 << 19


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float = 0.0, clamp: bool = False) -> DataFrame:
    """(query_id, object_id, similarity, rank): exact cosine top-k of corpus (object_id, embedding) for queries (query_id, embedding).

    Similarities below the threshold are dropped first; clamping to 0..1 comes after.  Ties go to the lesser object_id.
    """
    asked = queries.select("query_id", F.lit("").alias("object_type"), "embedding", F.lit(k).alias("k"), F.lit(float(threshold)).alias("threshold"))
    best = _ranked(asked, corpus.withColumn("object_type", F.lit(""))).drop("object_type")
    return best.withColumn("similarity", clamp01(F.col("similarity"))) if clamp else best


def search_all(searches: DataFrame, store: DataFrame) -> DataFrame:
    """(search_id, object_type, object_id, similarity, rank): many searches of several kinds in one pass over the store.

    searches: search_id, object_type, embedding, k, threshold; store: object_type, object_id, embedding.
    Each search ranks the objects of its own type by cosine similarity and takes its own k best that reach its own threshold.
    """
    return _ranked(searches.withColumnRenamed("search_id", "query_id"), store).withColumnRenamed("query_id", "search_id")


def scores(queries: DataFrame, corpus: DataFrame, *keep: str) -> DataFrame:
    """(query_id, object_id, similarity, *keep) of every query with every object, for audits of a few queries.

    keep: columns of the corpus that go with every pair, so that nothing is joined to all pairs afterwards.
    """
    asked = queries.select("query_id", F.lit("").alias("object_type"), "embedding", F.lit(None).cast("int").alias("k"), F.lit(-1.0).alias("threshold"))
    return _scored(asked, corpus.withColumn("object_type", F.lit("")), lambda found: found, keep).select("query_id", "object_id", "similarity", *keep)


def _ranked(asked: DataFrame, store: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "object_id")
    best = _scored(asked, store, lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")))
    return best.select("query_id", "object_type", "object_id", "similarity", "rank")


def _scored(asked: DataFrame, store: DataFrame, best_of: Callable[[DataFrame], DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """Hits (query_id, object_type, k, object_id, similarity, *keep) of asked (query_id, object_type, embedding, k, threshold).

    The queries are written once, in blocks of bounded size.  Each block goes to the tasks
    for one pass over the store, and its hits are written before the next is collected, so
    that the driver holds one block.  A task scores a batch by one matrix product for each
    type and leaves its k best of each query, so k rows a query and task are shuffled.
    """
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    asked = asked.select("query_id", "object_type", vector, "k", "threshold").where(F.size("embedding") > 0)
    rows = store.select("object_type", "object_id", vector, *keep).where(F.size("embedding") > 0)
    n, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n // max(1, BLOCK // (width or 1))))
    if blocks > 1:
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "asked", "block")
    types = {c: t.schema[c].dataType.simpleString() for t, c in ((asked, "query_id"), (store, "object_id"), *((store, c) for c in keep))}
    schema = f"query_id {types['query_id']}, object_type string, k int, object_id {types['object_id']}, similarity double" + "".join(f", `{c}` {types[c]}" for c in keep)
    out = None
    for b in range(blocks):
        part = (asked.where(F.col("block") == b).drop("block") if blocks > 1 else asked).toArrow()
        found = best_of(rows.mapInPandas(_scorer(part, keep), schema))
        found = stored(found, "hits") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _best(found: pd.DataFrame) -> pd.DataFrame:
    """The k best hits of each query, ties to the lesser object_id."""
    found = found.sort_values(["q", "similarity", "object_id"], ascending=[True, False, True], kind="stable")
    return found[(found.groupby("q").cumcount() < found["k"]).to_numpy()]


def _scorer(queries: pa.Table, keep: Sequence[str] = ()) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    kinds, types = {}, queries["object_type"].to_pandas().to_numpy()
    for kind in sorted(set(types)):
        part = queries.filter(pa.array(types == kind)).combine_chunks()
        vectors = part["embedding"].combine_chunks()
        if len(set(vectors.value_lengths().to_pylist())) > 1:
            raise ValueError("query vectors differ in width")
        q, k = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1), part["k"].to_pandas()
        most = k.max()
        kinds[kind] = (part["query_id"].to_pandas().to_numpy(), q, np.linalg.norm(q, axis=1), None if pd.isna(most) else k.to_numpy(), part["threshold"].to_numpy())

    def hits(kind: str, frame: pd.DataFrame, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row of frame, similarity) of pairs that reach the least of their query."""
        _, q, norms, k, _ = kinds[kind]
        most = None if k is None else int(k.max())
        x = np.stack(frame["embedding"].to_numpy())
        lengths, step = np.linalg.norm(x, axis=1), max(1, CELLS // len(x))
        for a in range(0, len(q), step):
            size = np.outer(norms[a : a + step], lengths)
            sim = np.divide(q[a : a + step] @ x.T, size, out=np.zeros_like(size), where=size > 0)
            # Rounding first keeps ties between equal vectors whatever the order of a product's sums.
            sim = np.round(sim, 12, out=sim)
            kept = sim >= least[a : a + step, None]
            if most is not None and len(x) > most:
                for i in np.flatnonzero(kept.sum(axis=1) > 4 * most):
                    # In order of id, so that an earlier column wins a tie.
                    first = np.argsort(-sim[i], kind="stable")[:most]
                    kept[i] = False
                    kept[i, first] = sim[i, first] >= least[a + i]
            at, col = np.nonzero(kept)
            yield a + at, col, sim[at, col]

    def each(frames):
        # Of each type the hits held, their number, and the similarity that a further hit of a query has to reach.
        held = {kind: ([], 0, threshold) for kind, (*_, threshold) in kinds.items()}

        def reduced(kind: str) -> tuple[list[pd.DataFrame], int, np.ndarray]:
            found, least = _best(pd.concat(held[kind][0])), held[kind][2].copy()
            ends = found.groupby("q").agg(n=("k", "size"), k=("k", "first"), s=("similarity", "last"))
            ends = ends[ends["n"] >= ends["k"]]
            least[ends.index.to_numpy()] = np.maximum(least[ends.index.to_numpy()], ends["s"].to_numpy())
            return [found], len(found), least

        for frame in frames:
            for kind, part in frame.groupby("object_type"):
                if kind not in kinds:
                    continue
                part = part.sort_values("object_id", kind="stable")
                keys, _, _, k, _ = kinds[kind]
                ids = part["object_id"].to_numpy()
                for q, col, sim in hits(kind, part, held[kind][2]):
                    if k is None:
                        yield pd.DataFrame({"query_id": keys[q], "object_type": kind, "k": pd.array([None], "Int32").take(np.zeros(len(q), int)), "object_id": ids[col], "similarity": sim, **{c: part[c].to_numpy()[col] for c in keep}})
                        continue
                    found, n, least = held[kind]
                    found.append(pd.DataFrame({"q": q, "k": k[q], "object_id": ids[col], "similarity": sim}))
                    held[kind] = (found, n + len(q), least)
                    if n + len(q) > max(CELLS, 2 * int(k.sum())):
                        held[kind] = reduced(kind)
                if k is not None and held[kind][0]:
                    held[kind] = reduced(kind) if len(held[kind][0]) > 1 else held[kind]
        for kind, (found, _, _) in held.items():
            if found:
                best = _best(pd.concat(found))
                yield pd.DataFrame({"query_id": kinds[kind][0][best["q"].to_numpy()], "object_type": kind, "k": best["k"].to_numpy(), "object_id": best["object_id"].to_numpy(), "similarity": best["similarity"].to_numpy()})

    return each


def normalised(hits: DataFrame, object_type: str) -> DataFrame:
    """Hits with object_type, and table_name: their own, else object_id of tables and parent_id of columns."""
    own = lambda c: F.col(c) if c in hits.columns else F.lit(None).cast("string")
    table = F.col("object_id") if object_type == "table" else F.col("parent_id")
    return hits.withColumn("object_type", F.coalesce(own("object_type"), F.lit(object_type))).withColumn("table_name", F.coalesce(own("table_name"), table.cast("string")))


def value_search(queries: DataFrame, values: DataFrame, k: int = 5, min_score: float = 0.0) -> DataFrame:
    """(query_id, dim_table, dim_col, matched_text, score, rank) of values (object_id, table_name, col_name, col_value, embedding).

    With min_score, 2k values are taken first, those below it go, and the first k of the rest stay.
    """
    hits = top_k(queries, values, 2 * k if min_score > 0 else k, threshold=-1.0)
    hits = hits.where(F.col("similarity") >= min_score) if min_score > 0 else hits
    named = values.select("object_id", F.col("table_name").alias("dim_table"), F.col("col_name").alias("dim_col"), F.col("col_value").alias("matched_text"))
    # Those that go are the last ones, so ranks stay.
    return hits.where(F.col("rank") <= k).join(named, "object_id").select("query_id", "dim_table", "dim_col", "matched_text", F.col("similarity").alias("score"), "rank")


def similar_examples(queries: DataFrame, examples: DataFrame, k: int = 3, least: float = 0.6) -> DataFrame:
    """(query_id, object_id, similarity, rank, question, sql): the best examples (object_id, embedding, document) of each question."""
    hits = top_k(queries, examples, k, threshold=least).join(examples.select("object_id", "document"), "object_id")
    return parsed_examples(hits).select("query_id", "object_id", "similarity", "rank", "question", "sql")


def probe_hits(probe_rows: DataFrame, vectors: DataFrame, columns: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """(query_id, source_text, object_id, similarity, rank): the best columns for each probe (query_id, text).

    vectors: (text, embedding).  A text that many questions share is searched once.
    """
    asked = probe_rows.select("text").distinct().join(vectors, "text").select(F.col("text").alias("query_id"), "embedding")
    hits = top_k(asked, columns, k, threshold).withColumnRenamed("query_id", "source_text")
    return probe_rows.select("query_id", F.col("text").alias("source_text")).join(hits, "source_text").select("query_id", "source_text", "object_id", "similarity", "rank")


def with_parent(hits: DataFrame, objects: DataFrame) -> DataFrame:
    """Column hits with table_category of their parent table; joined after the limit, so only hits are joined."""
    parents = objects.where("object_type = 'table'").select(F.col("object_id").alias("parent_id"), "table_category")
    return hits.join(parents, "parent_id", "left")


def parent_id(object_type: Column, object_id: Column) -> Column:
    """A column's first two dotted parts, a table itself, else null."""
    return F.when(object_type == "column", F.concat_ws(".", F.split_part(object_id, F.lit("."), F.lit(1)), F.split_part(object_id, F.lit("."), F.lit(2)))).when(object_type == "table", object_id)


def similarity_report(corpus: DataFrame, query: DataFrame, n: int = 15) -> DataFrame:
    """The n best objects for each query, empty vectors left out: (query_id, object_id, similarity, rank)."""
    return top_k(query, corpus, n, threshold=-1.0)


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("object_id",), tolerance: float = 0.01) -> DataFrame:
    """(*keys, a, b, differs) of two stores' (*keys, similarity); a missing side differs."""
    joined = a.select(*keys, F.col("similarity").alias("a")).join(b.select(*keys, F.col("similarity").alias("b")), list(keys), "full_outer")
    return joined.withColumn("differs", _differs(tolerance))


def parity_of(scored: DataFrame, a: Column, b: Column, keys: Sequence[str] = ("object_id",), tolerance: float = 0.01) -> DataFrame:
    """parity() of two similarities that stand in one row, without a join; null is a missing side, and a row without both goes."""
    both = scored.select(*keys, a.alias("a"), b.alias("b"))
    return both.where("a is not null or b is not null").withColumn("differs", _differs(tolerance))


def _differs(tolerance: float) -> Column:
    return F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, F.lit(True))


def pairwise(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(left_id, right_id, similarity) for pairs of ids."""
    left = vectors.select(F.col("object_id").alias("left_id"), F.col("embedding").alias("x"))
    right = vectors.select(F.col("object_id").alias("right_id"), F.col("embedding").alias("y"))
    return pairs.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", cosine_similarity(F.col("x"), F.col("y")).alias("similarity"))


def violations(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors of another width or with null or NaN elements."""
    bad = (F.size("embedding") != width) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.coalesce(bad, F.lit(True)))


def look_up(objects: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of objects whose object_id is wanted."""
    return objects.join(wanted.select("object_id").distinct(), "object_id", "left_semi").select("object_id", *columns)


def categories(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    return look_up(objects, wanted, ["table_category"]).where("table_category <> ''")


def parsed_examples(hits: DataFrame) -> DataFrame:
    """Hits with question and sql of their JSON document; one that cannot be parsed becomes sql, with an empty question."""
    doc = F.from_json("document", "question string, sql string")
    valid = F.try_parse_json("document").isNotNull()
    return hits.withColumn("_d", doc).withColumn("question", F.when(valid, F.coalesce("_d.question", F.lit(""))).otherwise("")).withColumn("sql", F.when(valid, F.coalesce("_d.sql", F.lit(""))).otherwise(F.col("document"))).drop("_d")


def write_store(objects: DataFrame, path: str) -> None:
    """Writes objects in folders by tenant (db_name), so that a tenant's search reads its own alone."""
    objects.write.partitionBy("db_name").parquet(path)


def tenant(objects: DataFrame, db_name: str | None) -> DataFrame:
    """The objects of a tenant, of all without one; of a store written by write_store only its folder is read."""
    return objects.where(F.col("db_name") == db_name) if db_name else objects


def probes(parsed: DataFrame, role: str = "column") -> DataFrame:
    """(query_id, text): the distinct, trimmed, non-blank texts of the dimensions with this role."""
    d = parsed.select("query_id", F.explode("parse_result.dimensions").alias("d")).where(F.col("d.role") == role)
    return d.select("query_id", F.trim("d.text").alias("text")).where("text <> ''").distinct()


def catalogue_text(columns: DataFrame) -> DataFrame:
    """columns (table_name, column_name, data_type, comment) with one sentence each to embed."""
    text = F.format_string("Column %s of table %s has type %s. %s", "column_name", "table_name", "data_type", F.coalesce("comment", F.lit("")))
    return columns.withColumn("text_raw", F.trim(text))


def encode_texts(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch_size: int = 20) -> DataFrame:
    """df (id, text) -> (id, embedding) by the caller's encoder, batch_size texts a call; blank texts are left out.

    Each call's vectors are packed as it returns, and those of many calls go to Spark together: an
    input batch's, or BLOCK entries and one call more.  Texts are encoded by the tasks that read them,
    so callers repartition a table of few row groups first.
    """
    vectors = pa.list_(pa.float32())

    def packed(texts: list[str]) -> pa.Array:
        found = pa.array(list(encode(texts)), vectors)
        if len(found) != len(texts):
            raise ValueError(f"the encoder gave {len(found)} vectors for {len(texts)} texts")
        return found

    def each(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            start, held, entries = 0, [], 0
            for i in range(0, len(texts), batch_size):
                held.append(packed(texts[i : i + batch_size]))
                entries += len(held[-1].values)
                end = min(i + batch_size, len(texts))
                if entries >= BLOCK or end == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.concat_arrays(held)], ["id", "embedding"])
                    start, held, entries = end, [], 0

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").where(F.trim("text") != "").mapInArrow(each, f"id {kind}, embedding array<float>")


def text_pairs(pairs: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch_size: int = 20) -> DataFrame:
    """pairs (left_text, right_text, ...) with similarity, the cosine of the texts' vectors.

    Each distinct text is encoded once, however many pairs hold it, and its vector joined back.
    A pair with a null or blank text has none.
    """
    texts = pairs.select(F.explode(F.array("left_text", "right_text")).alias("text")).distinct()
    vectors = stored(encode_texts(texts.withColumn("id", F.col("text")), encode, batch_size), "vectors")
    sides = [vectors.select(F.col("id").alias(f"{side}_text"), F.col("embedding").alias(f"_{side}")) for side in ("left", "right")]
    out = pairs.join(sides[0], "left_text", "left").join(sides[1], "right_text", "left")
    return out.withColumn("similarity", cosine_similarity(F.col("_left"), F.col("_right"))).select(*pairs.columns, "similarity")
