"""Fuzzy matching of question terms to dimension values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text, trigram_similarity, trigrams, word_similarity
from .iteration import stored


def value_index(tables: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(dim_table, dim_col, key_col, key_value, value_text, value_norm) of (name, table, column, key) branches; nulls are skipped."""
    out = None
    for name, df, column, key in tables:
        part = df.where(F.col(column).isNotNull()).select(
            F.lit(name).alias("dim_table"), F.lit(column).alias("dim_col"), F.lit(key).alias("key_col"), F.col(key).cast("string").alias("key_value"),
            F.col(column).alias("value_text"), norm_text(F.col(column)).alias("value_norm"),
        )
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates()


#: Sizes at which a new band of set sizes begins, each about a quarter above the last.
_BANDS = [1]
while _BANDS[-1] < 1 << 30:
    _BANDS.append(max(_BANDS[-1] + 1, _BANDS[-1] * 5 // 4))


def _least_shared(n: Column, m: Column, least: float) -> Column:
    """The fewest shared elements of sets of n and m whose similarity exceeds `least`."""
    return F.floor((n + m) * F.lit(least / (1 + least)) - F.lit(1e-6)).cast("int") + 1


def _ordered_sets(texts: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """(name, n, sorted): each text's number of trigrams, and these from the rarest to the most frequent."""
    sets = texts.select(name).distinct().withColumn("g", trigrams(F.col(name))).select(name, F.size("g").alias("n"), F.explode("g").alias("g"))
    found = sets.join(counts, "g", "left").groupBy(name, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g"))).alias("sorted"))
    return found.select(name, "n", F.transform("sorted", lambda x: x["g"]).alias("sorted"))


def candidate_pairs(queries: DataFrame, texts: DataFrame, least: float = 0.3) -> DataFrame:
    """(q, v): distinct texts that can exceed `least`, by a prefix join of their trigrams.

    Trigrams stand in order of their frequency among texts, the rarest first.  Sets of n and m elements that
    share c of them have to share one among the first n - c + 1 and m - c + 1.  Texts are indexed under
    a band of their size and a query asks each band that may hold a partner with the prefix that this band
    needs, so the most frequent trigrams of a text meet nothing.  A pair is left out
    if what stands from the shared trigram on, on either side, is too little.
    """
    flat = texts.select("v").distinct().select(F.explode(trigrams(F.col("v"))).alias("g"))
    counts = stored(flat.groupBy("g").agg(F.count("*").alias("c")), "trigrams")
    q, v = _ordered_sets(queries, "q", counts), _ordered_sets(texts, "v", counts)
    bands = F.array(*map(F.lit, _BANDS))
    band = F.size(F.filter(bands, lambda b: b <= F.col("n")))
    first = lambda n, m: F.slice("sorted", F.lit(1), F.greatest(F.lit(0), F.least(n, n - _least_shared(n, m, least) + 1)))
    # The least partner of n elements has over least * n.
    smallest = F.floor(F.col("n") * F.lit(least) - F.lit(1e-6)).cast("int") + 1
    v = v.select("v", F.col("n").alias("nv"), band.alias("band"), F.posexplode(first(F.col("n"), smallest)).alias("pv", "g"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(len(_BANDS) - 2)), lambda i: F.struct((i + 1).alias("band"), F.get(bands, i).alias("lo"), (F.get(bands, i + 1) - 1).alias("hi")))
    asked = F.filter(ends, lambda b: (b["hi"] >= smallest) & (b["lo"] * F.lit(least - 1e-6) < F.col("n")))
    q = q.select("q", "n", "sorted", F.explode(asked).alias("b")).withColumn("nq", F.col("n"))
    q = q.select("q", "nq", F.col("b.band").alias("band"), F.posexplode(first(F.col("n"), F.greatest(F.col("b.lo"), smallest))).alias("pq", "g"))
    rest = F.least(F.col("nq") - F.col("pq"), F.col("nv") - F.col("pv"))
    return q.join(v, ["g", "band"]).where(rest >= _least_shared(F.col("nq"), F.col("nv"), least)).select("q", "v").distinct()


def similar_texts(queries: DataFrame, texts: DataFrame, least: float = 0.3) -> DataFrame:
    """(q, v, similarity) of distinct texts q and v whose trigram similarity exceeds `least`.

    Distinct texts go in, so a value that many rows repeat is compared once; candidate_pairs leaves few to compare.
    """
    pairs = candidate_pairs(queries, texts, least)
    return pairs.withColumn("similarity", trigram_similarity(F.col("q"), F.col("v"))).where(F.col("similarity") > least)


def look_up(queries: DataFrame, index: DataFrame, k: int = 5, least: float = 0.3, method: str = "word", min_score: float = 0.0) -> DataFrame:
    """The k best index rows for each query (query_id, query_value): (query_id, ..., score, rank).

    Candidates exceed `least` in whole-string trigram similarity.  method 'word' scores by
    word similarity of value and normalised query, 'similarity' by trigram similarity of
    value and lower-cased query.  With min_score, 2k rows are taken first, those below it
    go, and the first k of the rest stay.
    """
    norm = norm_text(F.col("query_value")) if method == "word" else F.lower("query_value")
    fetch = 2 * k if min_score > 0 else k
    # Scores and ranks depend on the distinct texts alone: each gives its first rows, and every query takes the ranks of its text.
    shown = ["dim_table", "dim_col", "matched_text", "key_value"]
    rows = index.select(F.col("value_norm").alias("v"), "dim_table", "dim_col", F.col("value_text").alias("matched_text"), "key_col", "key_value")
    rows = stored(_firsts(rows, "v", shown, fetch).drop("rank"), "rows")
    q = queries.withColumn("q", norm)
    found = similar_texts(q, rows.select("v"), least)
    scored = found.withColumn("score", word_similarity("v", "q") if method == "word" else F.col("similarity")).select("q", "v", "score")
    hits = _firsts(scored.join(rows, "v"), "q", [F.desc(F.round("score", 9)), *shown], fetch)
    if min_score > 0:
        hits = _firsts(hits.where(F.col("score") >= min_score), "q", ["rank"], k)
    hits = stored(hits, "ranked")
    return q.join(hits, "q").select("query_id", "query_value", "matched_text", "dim_table", "dim_col", "key_col", "key_value", "score", "rank")


def _firsts(df: DataFrame, key: str, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def dimension_values(parsed: DataFrame, role: str = "value") -> DataFrame:
    """(query_id, source_index, text): the non-blank dimensions of this role, with their place."""
    d = parsed.select("query_id", F.posexplode("parse_result.dimensions").alias("source_index", "d")).where(F.col("d.role") == role)
    return d.select("query_id", "source_index", F.col("d.text").alias("text")).where(F.trim("text") != "")


def value_hits(parsed: DataFrame, index: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, source_index, source_text, ...): the look-up of every value dimension's trimmed text; equal texts are looked up once.

    source_index is that of the question's first dimension with this text.
    """
    asked = dimension_values(parsed).select("query_id", "source_index", F.trim("text").alias("query_value"))
    hits = look_up(asked.select(F.col("query_value").alias("query_id"), "query_value").distinct(), index, k, **options).drop("query_id").withColumnRenamed("query_value", "source_text")
    firsts = asked.withColumn("source_index", F.min("source_index").over(Window.partitionBy("query_id", "query_value"))).withColumnRenamed("query_value", "source_text")
    return firsts.join(hits, "source_text").select("query_id", "source_index", *hits.columns)


def at_least(matches: DataFrame, min_score: float = 0.5) -> DataFrame:
    return matches.where(F.coalesce("score", F.lit(0.0)) >= min_score)


def by_source(matches: DataFrame) -> DataFrame:
    """(query_id, source_index, matches): the matches of each dimension in order of their ordinal; those without a place go."""
    packed = F.array_sort(F.collect_list(F.struct("ordinal", "matched_text", "score")))
    return matches.where("source_index is not null").groupBy("query_id", "source_index").agg(packed.alias("matches"))


def best(matches: DataFrame, keys: Sequence[str] = ("query_id", "source_index")) -> DataFrame:
    """The match of the highest score for each key; the lesser ordinal wins ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "ordinal")
    return matches.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_source(matches: DataFrame, dimensions: DataFrame) -> DataFrame:
    """matches (query_id, query_value) with source_index: the first dimension whose text equals the value."""
    first = dimensions.groupBy("query_id", F.col("text").alias("query_value")).agg(F.min("source_index").alias("source_index"))
    return matches.join(first, ["query_id", "query_value"], "left")


def deduplicate(hits: DataFrame) -> DataFrame:
    """One hit for (dim_table, dim_col, key_value or else matched_text) of each query: the best, the first on a tie."""
    key = F.coalesce(F.nullif("key_value", F.lit("")), F.col("matched_text"))
    return best(hits.withColumn("_key", key), ["query_id", "dim_table", "dim_col", "_key"]).drop("_key")


def effective_filters(dimensions: DataFrame, matches: DataFrame, min_score: float = 0.4) -> DataFrame:
    """(query_id, filters): 'value=' the matched text if its score reaches min_score, else the original; 'column=' as it is."""
    b = best(matches).select("query_id", "source_index", "matched_text", "score")
    d = dimensions.join(b, ["query_id", "source_index"], "left")
    value = F.when(F.col("score") >= min_score, F.col("matched_text")).otherwise(F.col("text"))
    text = F.when(F.col("role") == "value", F.concat(F.lit("value="), value)).otherwise(F.concat(F.lit("column="), "text"))
    packed = F.array_sort(F.collect_list(F.struct("source_index", text.alias("t"))))
    return d.groupBy("query_id").agg(F.transform(packed, lambda x: x["t"]).alias("filters"))


def suggested_predicate() -> tuple[Column, Column]:
    """(predicate, band) of match rows: key equality if there is a key, else LIKE; bands at 0.8 and 0.5."""
    keyed = F.concat("dim_table", F.lit("."), "key_col", F.lit("='"), F.replace("key_value", F.lit("'"), F.lit("''")), F.lit("'"))
    like = F.concat("dim_table", F.lit("."), "dim_col", F.lit(" LIKE '%"), F.replace("matched_text", F.lit("'"), F.lit("''")), F.lit("%'"))
    has_key = (F.coalesce("key_col", F.lit("")) != "") & (F.coalesce("key_value", F.lit("")) != "")
    band = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    return F.when(has_key, keyed).otherwise(like), band


def match_errors(required: Sequence[str] = ("query_value", "matched_text", "dim_table", "dim_col", "score")) -> Column:
    """Array of what is wrong with a match row; empty if nothing is."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    return F.array_compact(F.array(*missing, F.when((F.col("score") < 0) | (F.col("score") > 1), F.lit("score is outside 0..1"))))


def qualified_tables(hits: DataFrame, schema: str = "public") -> DataFrame:
    """(query_id, table_name, ordinal): the tables of the hits, bare ones qualified, in order of first appearance."""
    name = F.when(F.instr("dim_table", ".") == 0, F.concat(F.lit(schema + "."), "dim_table")).otherwise(F.col("dim_table"))
    return hits.groupBy("query_id", name.alias("table_name")).agg(F.min("ordinal").alias("ordinal"))
