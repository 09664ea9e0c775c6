"""The registered queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, jaccard_join, line_dedup, mixing, pii, quality, ranked_search, rendezvous, secrets, substring_dedup, token_shards, whitening, winnowing


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(common.documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_later(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _joined(spans: str, kinds: tuple[str, ...]) -> F.Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _count(spans: str, field: str, kind: int) -> F.Column:
    return F.size(F.filter(spans, lambda x: x[field] == kind)).cast("bigint")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(common.documents(spark, sf_dir))
    counts = [_count("base", "no", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2("base_digest", 256).alias("base_sha256"), F.col("spans_digest").alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(common.documents(spark, sf_dir))
    counts = [_count("base", "kind", i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined("base", secrets.KINDS), 256).alias("base_sha256"), _joined("spans", secrets.KINDS).alias("spans"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.fingerprints(common.documents(spark, sf_dir))
    return out.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), winnowing.printed(F.col("selected")).alias("fingerprint"),
        winnowing.printed(F.col("edited_selected")).alias("edited_fingerprint"), "near_edited", "near_next", "next_id",
    )


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shards_in_scratch(common.documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(common.documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", components=4)
    each = out.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "row.vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("bigint").alias("deviation"), F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )


def op13_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rendezvous.shard_rows(common.documents(spark, sf_dir), 40, keep=["doc_id"])
    return out.select("row.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Words of a text as a list, in DuckDB.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Terms of the ranked search: runs of ASCII letters and digits and of what is not ASCII.
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {
    "op2_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
        flat AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
                  FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x)
        SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, c.component_id
        FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id""",
    "op3_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
        keyed AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS k FROM win),
        twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM keyed SEMI JOIN twice USING (k)),
        word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
        marked AS (SELECT word.doc_id, word.i, x, gone.doc_id IS NOT NULL AS g FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i),
        done AS (SELECT doc_id, count(*) AS n, count_if(g) AS r, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT g), '') AS kept FROM marked GROUP BY doc_id)
        SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN done ON done.doc_id = w.doc_id""",
    "op4_line_dedup": """
        WITH l AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
        w AS (SELECT doc_id, unnest(range(1, len(ls) - 1)) AS i, ls FROM l WHERE len(ls) >= 3),
        k AS (SELECT doc_id, i, sha256(array_to_string(ls[i:i + 2], chr(10))) AS h FROM w),
        later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM later),
        line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM l),
        m AS (SELECT line.doc_id, line.i, x, gone.doc_id IS NOT NULL AS g FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.i = line.i),
        done AS (SELECT doc_id, count(*) AS n, count_if(g) AS r, string_agg(x, chr(10) ORDER BY i) FILTER (NOT g) AS kept FROM m GROUP BY doc_id)
        SELECT l.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM l LEFT JOIN done ON done.doc_id = l.doc_id""",
    "op11_reversed_search": f"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
        f AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM t WHERE len(ts) > 0),
        tot AS (SELECT count(*) AS total, sum(len(ts)) AS terms FROM t WHERE len(ts) > 0),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        h AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM f SEMI JOIN q ON q.term = f.term GROUP BY r, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM h GROUP BY term), tot),
        s AS (SELECT q.item_id, h.r, any_value(h.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // terms)))) AS BIGINT) AS score
              FROM q JOIN h ON h.term = q.term JOIN w ON w.term = q.term, tot GROUP BY q.item_id, h.r)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_rendezvous": """
        WITH poly AS (SELECT list(CAST(list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS BIGINT) ORDER BY i) AS crcs FROM range(0, 256) x(i)),
        raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        b AS (SELECT r, doc_id, length(x) // 2 + 16 AS size, list_transform(regexp_extract_all(x, '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs FROM raw),
        k AS (SELECT r, doc_id, size, xor(list_reduce(bs, lambda c, v: xor(c >> 8, crcs[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS crc, coalesce('k' || doc_id, 'n') AS key FROM b, poly),
        d AS (SELECT r, i, CAST('0x' || substr(md5(key || ':' || i), 1, 13) AS BIGINT) AS draw FROM k, range(0, 41) x(i)),
        p AS (SELECT r, arg_max(i, draw) FILTER (i < 40) AS shard, arg_max(i, draw) AS grown FROM d GROUP BY r)
        SELECT doc_id, size, crc AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, CAST(grown AS INT) AS grown_shard,
            row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(key), 1, 13) AS BIGINT), key, crc, size) - 1 AS slot
        FROM k JOIN p USING (r)""",
}
