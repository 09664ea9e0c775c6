"""Personal data: base patterns, and contextual patterns bootstrapped from what they find.

Base spans (e-mail, IP, card, phone) are the seeds.  The words around a seed are lexical
patterns: (side, the next word or the next two; one at the text's edge).  Identifier-shaped
runs that no base pattern covers are candidates: digit groups, anything with a digit, mails
with at and dot spelt out.  Patterns and instances (distinct values) form a graph that is scored in
rounds.  A pattern is of the kind of most of its accepted instances; its trust is the mean
score of its instances, 0 unless `seeds` accepted ones are of its kind.  Base instances are
accepted; an accepted one scores 1 for patterns of its kind and 0 for others, an unseen one
`damping` times the trust of its best pattern, and it is accepted, as of that pattern's kind, once that trust
reaches `confidence`.  So accepted instances give new patterns in the next round.  Rounds end when no
instance is newly accepted and no score moves by over SETTLED; `rounds` of them without that are an error.
Candidates that are accepted become spans.

All expressions are DataFrame functions, and their work is in proportion to a text's length.  The text is
scanned once; only spans, candidates and their contexts are kept of it.  Quantifiers are
possessive wherever the greedy match cannot need a shorter one, so very long runs neither
backtrack nor recurse.

Defined results: null or empty text has no spans; equal rows each get their own spans;
positions are code points with exclusive ends; candidates are looked for in what base spans leave, so
none overlaps one; the context reaches to the neighbouring match of the same kind, which counts as a
word.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: A match of a run's start decides for the whole run, hence the look-behinds; \\G lets a match start where the last ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = "[A-Za-z0-9_]"
_DOT = r"(?:\s*+[\[(]\s*+(?i:dot)\s*+[\])]\s*+|\s++(?i:dot)\s++|\.)"
_LABEL = "[A-Za-z0-9_-]++"
#: Mails with the at sign spelt out; a bare "at" needs a dot in what follows.
_SPELT = rf"(?<!{_LOCAL}){_LOCAL}++(?:\s*+[\[(]\s*+(?i:at)\s*+[\])]\s*+{_LABEL}(?:{_DOT}{_LABEL})*+|\s++(?i:at)\s++{_LABEL}(?:{_DOT}{_LABEL})++)"
#: Groups of digits with up to three blanks, dots, dashes or parentheses between them.
_GROUP = r"[0-9]++(?![A-Za-z_@+]|[.-]{1,3}+[A-Za-z_])"
_GROUPS = rf"\+?+(?:\((?=[0-9]++\)[\x20.-]?+[0-9]))?+{_GROUP}(?:[\x20().-]{{1,3}}+{_GROUP})*+(?![@.+-]{{1,3}}+{_TOKEN}|{_TOKEN})"
#: Letters and digits with a digit anywhere, parts joined by up to three signs.
_JOIN = rf"[@.+-]{{1,3}}+(?={_TOKEN})"
_MIXED = rf"(?:[A-Za-z_]++(?:{_JOIN})?+)*+[0-9](?:{_TOKEN}++|{_JOIN})*+"
#: All identifier-shaped runs; the pattern graph alone decides which are personal data.
CANDIDATE = rf"{_SPELT}|(?<!{_TOKEN}[@.+-]{{0,3}})(?:{_GROUPS}|{_MIXED})"
#: A longer word is known by the characters of this number that are nearest to the span.
WORD = 64
#: Two nearest words, from the span outwards.
_NEAREST = rf"^\s*+(\S{{1,{WORD}}}+(?:\s++\S{{1,{WORD}}}+)?+)"
#: A piece of text that is sure to hold the two nearest words in full.
_ENOUGH = rf"^\s*+(?:\S{{{WORD + 1}}}|\S{{1,{WORD}}}+\s++(?:\S{{{WORD}}}|\S++\s))"
#: Characters looked at first; where they are not enough, the whole side is.
CONTEXT = 256
#: Stands for the characters of base spans while candidates are looked for.
FILLER = "\ufffc"
#: Elements of one part of a running sum.
CHUNK = 256

_MATCH = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
_SPANS = "array<struct<no:int,start:int,end:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column) -> Column:
    """Running sums of an array of int: a part at a time, so that no long array is copied for each element."""

    def running(part: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

        def step(s: Column, x: Column) -> Column:
            at = (s["at"] + x).cast("int")
            return F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

        return F.aggregate(part, first, step, lambda s: s["out"])

    def shifted(both: Column) -> Column:
        return F.flatten(F.transform(both["parts"], lambda p, i: F.transform(p, lambda x: x + F.when(i > 0, F.get(both["totals"], i - 1)).otherwise(0))))

    def joined(parts: Column) -> Column:
        return _let(F.struct(parts.alias("parts"), running(F.transform(parts, lambda p: F.element_at(p, -1))).alias("totals")), shifted)

    parts = lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int")), lambda j: running(F.slice(v, j * CHUNK + 1, CHUNK)))
    return _let(values, lambda v: _let(parts(v), joined))


def _pieces(text: Column, pattern: str) -> Column:
    """(hits, gaps): leftmost non-overlapping matches, and the text before each and after the last."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))


def matches(text: Column, pattern: str, valid=None) -> Column:
    """Leftmost non-overlapping matches that are valid: (start, end, value, left, right), the last two of up to two words."""
    none = F.expr(f"cast(array() as {_MATCH})")

    def found(p: Column) -> Column:
        hits, gaps = p["hits"], p["gaps"]
        every = F.sequence(F.lit(0), F.size(hits) - 1)
        ends = _sums(F.transform(every, lambda i: F.length(F.get(gaps, i)) + F.length(F.get(hits, i))))
        kept = F.filter(every, lambda i: valid(F.get(hits, i))) if valid else every

        def placed(ends: Column) -> Column:
            def one(i: Column) -> Column:
                hit, end = F.get(hits, i), F.get(ends, i)
                before = F.concat(F.when(i > 0, F.get(hits, i - 1)).otherwise(""), F.get(gaps, i))
                after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(hits, i + 1), F.lit("")))
                left, right = _context(before, after)
                return F.struct((end - F.length(hit)).cast("int").alias("start"), end.cast("int").alias("end"), F.lower(hit).alias("value"), left.alias("left"), right.alias("right"))

            return F.transform(kept, one)

        return F.when(F.size(hits) > 0, _let(ends, placed)).otherwise(none)

    return _let(_pieces(text, pattern), found)


def masked(text: Column, kind: str) -> Column:
    """The text with FILLER in place of the characters of valid matches."""

    def covered(p: Column) -> Column:
        hits = F.transform(p["hits"], lambda h: F.when(_valid(kind, h), F.repeat(F.lit(FILLER), F.length(h))).otherwise(h))
        return F.array_join(F.flatten(F.zip_with(p["gaps"], hits, lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))), "")

    return F.when(_MAY[kind](text), _let(_pieces(text, PATTERNS[kind]), covered)).otherwise(text)


def _luhn(digits: Column) -> Column:
    def step(s: Column, i: Column) -> Column:
        v = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(1) + (i - 1) % 2)
        return s + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.left(part(p), F.lit(4)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


#: Cheap tests without which a pattern cannot match.
_MAY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}


def _context(before: Column, after: Column) -> tuple[Column, Column]:
    """Up to two words on either side, fewer at the text's edges."""
    near = F.reverse(F.right(before, F.lit(CONTEXT)))
    near = F.when(near.rlike(_ENOUGH) | (F.length(before) <= CONTEXT), near).otherwise(F.reverse(before))
    far = F.left(after, F.lit(CONTEXT))
    far = F.when(far.rlike(_ENOUGH) | (F.length(after) <= CONTEXT), far).otherwise(after)
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), FILLER + "+", FILLER), r"\s+", " ")
    left, right = (F.regexp_extract(tidy(x), _NEAREST, 1) for x in (near, far))
    return F.reverse(left), right


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, seen): base spans (no, start, end) in order; seen: (no, start, end, value, left, right), no = -1 for candidates."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.expr(f"cast(array() as {_MATCH})")
    found = [F.when(_MAY[k](F.col("text")), matches(F.col("text"), PATTERNS[k], lambda v, k=k: _valid(k, v))).otherwise(none).alias(k) for k in KINDS]
    d = d.select("doc_id", "text", *found)
    left = F.col("text")
    for k in KINDS:
        d = d.withColumn("left", masked(left, k))
        left = F.col("left")
    may = F.col("left").rlike(r"[0-9]|(?i:[\[(\s]at[\])\s])")
    d = d.withColumn("more", F.when(may, matches(F.col("left"), CANDIDATE)).otherwise(none))
    numbered = lambda spans, no: F.transform(spans, lambda x: F.struct(F.lit(no).alias("no"), *[x[c].alias(c) for c in ("start", "end", "value", "left", "right")]))
    every = [numbered(k, i) for i, k in enumerate(KINDS)]
    base = F.transform(F.concat(*every), lambda x: F.struct(*[x[c].alias(c) for c in ("no", "start", "end")]))
    return d.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), F.concat(*every, numbered("more", -1)).alias("seen"))


def _free(seen: DataFrame) -> DataFrame:
    """seen without the candidates that overlap a base span of their row."""
    base = lambda c: F.when(F.col("no") >= 0, F.col(c))
    earlier = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    out = seen.withColumn("reach", F.max(base("end")).over(earlier)).withColumn("next", F.min(base("start")).over(later))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return out.where((F.col("no") >= 0) | clear).drop("reach", "next")


#: The scores are settled when no instance is newly accepted and none moves by more than this.
SETTLED = 1e-3


def discovered(rows: DataFrame, rounds: int = 200, seeds: int = 3, confidence: float = 0.75, damping: float = 0.7) -> DataFrame:
    """(row, more): spans (no, start, end) of the accepted candidates, from scanned rows."""
    seen = stored(_free(rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")), "seen")
    words = {"l": (F.col("left"), r"(\S+)$"), "r": (F.col("right"), r"^(\S+)")}
    sides = F.array_distinct(F.array(*[F.struct(F.lit(k).alias("side"), x.alias("words")) for k, (both, one) in words.items() for x in (both, F.regexp_extract(both, one, 1))]))
    edges = seen.select("no", "value", F.explode(sides).alias("p")).where("p.words <> ''").groupBy("p", "value").agg(F.max("no").alias("no"))
    edges = stored(edges, "edges")
    # A pattern of fewer instances than `seeds` can never be confident.
    wide = stored(edges.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= seeds).select("p"), "patterns")
    graph = stored(edges.join(wide, "p"), "graph")
    # kind: of base instances at first, of accepted ones later; null where an instance is not accepted.
    scores = stored(graph.groupBy("value").agg(F.max("no").alias("no")).select("value", F.when(F.col("no") >= 0, F.col("no")).alias("kind"), F.when(F.col("no") >= 0, 1.0).otherwise(0.0).alias("score")), "scores")
    for _ in range(rounds):
        votes = graph.select("p", "value").join(scores, "value").groupBy("p", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
        known = F.col("kind").isNotNull()
        most = F.max(F.when(known, F.struct("n", "kind")))
        trust = votes.groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("score"))).alias("hoped"), most.alias("most")).where(F.col("most.n") >= seeds)
        share = (F.col("most.n") + F.coalesce("hoped", F.lit(0.0))) / F.col("n")
        trust = stored(trust.select("p", F.struct(share.alias("trust"), F.col("most.kind").alias("of")).alias("t")), "trust")
        best = graph.select("p", "value").join(trust, "p").groupBy("value").agg(F.max("t").alias("t"))
        new = F.when(F.col("kind").isNotNull(), F.struct("kind", "score")).when(F.col("t.trust") >= confidence, F.struct(F.col("t.of").alias("kind"), F.lit(1.0).alias("score")))
        new = new.otherwise(F.struct(F.lit(None).cast("int").alias("kind"), F.coalesce(damping * F.col("t.trust"), F.lit(0.0)).alias("score")))
        moved = ~F.col("s.kind").eqNullSafe(F.col("kind")) | (F.abs(F.col("s.score") - F.col("score")) > SETTLED)
        new = scores.join(best, "value", "left").select("value", "kind", "score", new.alias("s")).select("value", "s.kind", "s.score", moved.alias("moved"))
        scores = stored(new, "scores")
        if scores.where("moved").isEmpty():
            break
        scores = scores.drop("moved")
    else:
        raise RuntimeError(f"the scores of patterns and instances still move after {rounds} rounds")
    fresh = scores.where("kind is not null").select("value", "kind")
    return seen.where("no < 0").join(fresh, "value").groupBy("row").agg(F.collect_list(F.struct(F.col("kind").alias("no"), "start", "end")).alias("more"))


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["no"]), x["start"], x["end"])), ",")


def find_pii(docs: DataFrame, rounds: int = 200, seeds: int = 3, confidence: float = 0.75, damping: float = 0.7) -> DataFrame:
    """doc_id, base and spans (arrays of (no, start, end), no: place in KINDS), and their digests as strings."""
    rows = stored(scanned(docs), "pii")
    out = rows.join(discovered(rows, rounds, seeds, confidence, damping), "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {_SPANS})"))))
    return out.select("doc_id", "base", every.alias("spans")).withColumn("base_digest", _digest(F.col("base"))).withColumn("spans_digest", _digest(F.col("spans")))
