"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Full-width forms stand 0xFEE0 above their ASCII forms; the ideographic space becomes a blank.
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"　": " "}
#: Latin letters with marks, by their canonical decomposition.
_MARKED = {chr(c): d[0] for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
_FROM = "".join([*_WIDE, *_MARKED])
_TO = "".join([*_WIDE.values(), *_MARKED.values()])
#: CJK punctuation that normalisation drops besides ASCII punctuation.
CJK_MARKS = "·、。，；：？！“”‘’（）《》〈〉【】「」『』—…～￥"
_DROP = rf"[\s\p{{Punct}}{CJK_MARKS}]+"


def norm_text(s: Column) -> Column:
    """Null becomes '', full-width half-width, marked Latin letters plain; lower case; blanks and punctuation go."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(s, F.lit("")), _FROM, _TO)), _DROP, "")


def _ordered(s: Column) -> Column:
    """Trigrams, in order and with repeats, of the alphanumeric words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(words, of_word))


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the alphanumeric words."""
    return F.array_distinct(_ordered(s))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 when neither has any."""
    x, y = trigrams(a), trigrams(b)
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def truncate_text(s: Column, most: int) -> Column:
    """At most `most` characters: with room for it, the cut is marked by '...'."""
    if most <= 0:
        return F.lit("")
    cut = F.left(s, F.lit(most)) if most <= 3 else F.concat(F.left(s, F.lit(most - 3)), F.lit("..."))
    return F.when(F.length(s) > most, cut).otherwise(F.coalesce(s, F.lit("")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_similarity(a: Column | str, b: Column | str) -> Column:
    """Best |A & E| / |A | E| over contiguous extents E of b's ordered trigrams; 0 when either has none.

    Each trigram of b knows whether A holds it and where it stood last, so an extent that
    grows by one changes two counts.  Only extents that start within A are tried: others are never better.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def best(t: Column) -> Column:
        n, size = F.size(t["y"]), F.size(t["x"])

        def mark(g: Column, j: Column) -> Column:
            back = F.array_position(F.reverse(F.slice(t["y"], F.lit(1), j)), g).cast("int")
            return F.struct(F.array_contains(t["x"], g).cast("int").alias("in"), F.when(back > 0, j - back).otherwise(-1).alias("last"))

        def extents(m: Column) -> Column:
            def from_start(i: Column) -> Column:
                def grown(acc: Column, e: Column) -> Column:
                    new = (e["last"] < i).cast("int")
                    both, every = acc["both"] + new * e["in"], acc["every"] + new
                    return F.struct(both.alias("both"), every.alias("every"), F.greatest(acc["best"], both / (size + every - both)).alias("best"))

                start = F.struct(F.lit(0).alias("both"), F.lit(0).alias("every"), F.lit(0.0).alias("best"))
                return F.aggregate(F.slice(m, i + 1, n), start, grown, lambda acc: acc["best"])

            starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(m, i)["in"] == 1)
            return F.array_max(F.transform(starts, from_start))

        return F.when(n > 0, _let(F.transform(t["y"], mark), extents))

    t = F.struct(trigrams(a).alias("x"), _ordered(b).alias("y"))
    return F.coalesce(_let(t, best), F.lit(0.0))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> None:
    """Make the functions callable from SQL, as temporary SQL functions."""
    numbers = "ARRAY<DOUBLE>"
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), CAST(0 AS DOUBLE), (s, v) -> s + v)"
    word = "transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3))"
    ordered = lambda x: f"flatten(transform(filter(split(lower({x}), {_quoted('[^\\p{L}\\p{N}]+')}), w -> w <> ''), w -> {word}))"
    of = lambda x: f"array_distinct({ordered(x)})"
    every = f"size(array_union({of('a')}, {of('b')}))"
    mark = "named_struct('held', int(array_contains(t.x, g)), 'last', IF(array_contains(slice(t.y, 1, j), g), j - int(array_position(reverse(slice(t.y, 1, j)), g)), -1))"
    new = "int(e.last < i)"
    shared, seen = f"(acc.both + {new} * e.held)", f"(acc.every + {new})"
    grown = f"named_struct('both', {shared}, 'every', {seen}, 'best', greatest(acc.best, {shared} / (size(t.x) + {seen} - {shared})))"
    extent = f"aggregate(slice(m, i + 1, size(m)), named_struct('both', 0, 'every', 0, 'best', CAST(0 AS DOUBLE)), (acc, e) -> {grown}, acc -> acc.best)"
    starts = f"array_max(transform(filter(sequence(0, size(m) - 1), i -> get(m, i).held = 1), i -> {extent}))"
    best = f"IF(size(t.y) > 0, get(transform(array(transform(t.y, (g, j) -> {mark})), m -> {starts}), 0), NULL)"
    bodies = (
        ("norm_text(s STRING) RETURNS STRING", f"regexp_replace(lower(translate(coalesce(s, ''), {_quoted(_FROM)}, {_quoted(_TO)})), {_quoted(_DROP)}, '')"),
        ("trigrams(s STRING) RETURNS ARRAY<STRING>", of("s")),
        ("word_similarity(a STRING, b STRING) RETURNS DOUBLE", f"coalesce(get(transform(array(named_struct('x', {of('a')}, 'y', {ordered('b')})), t -> {best}), 0), CAST(0 AS DOUBLE))"),
        ("trigram_similarity(a STRING, b STRING) RETURNS DOUBLE", f"CASE WHEN {every} > 0 THEN size(array_intersect({of('a')}, {of('b')})) / {every} ELSE CAST(0 AS DOUBLE) END"),
        (f"cosine_similarity(a {numbers}, b {numbers}) RETURNS DOUBLE", f"CASE WHEN {dot('a', 'a')} * {dot('b', 'b')} = 0 THEN CAST(0 AS DOUBLE) ELSE {dot('a', 'b')} / (sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')})) END"),
        ("truncate_text(s STRING, most INT) RETURNS STRING", "CASE WHEN most <= 0 THEN '' WHEN length(s) > most THEN IF(most <= 3, left(s, most), concat(left(s, most - 3), '...')) ELSE coalesce(s, '') END"),
    )
    for head, body in bodies:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
