"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are computed with numpy a slice of documents at a time.
A random forest on a bounded, seeded sample of labelled rows gives tree paths; each path
prefix is a conjunctive rule.  A lasso logistic regression weighs the rules, most weights
become zero, and the rest are compiled into one Spark column expression, so that scoring
is plain SQL over the statistics.

Defined results: null, empty and blank texts have all statistics 0 and the score that
these give; without labels of both classes every score is the labels' mean (0.5 without
any); a null doc_id is never held out and has no label; labels other than 0 and 1 are
ignored, and of several labels of a document the least counts; equal texts have equal scores.  Only doc_id and text are read of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

FEATURES = (
    "log_words", "mean_word", "upper", "symbols", "digits", "marks", "bars", "exclaims", "non_ascii", "distinct", "top_word",
    "same_next", "repeated_grams", "repeated_lines", "line_words", "short_words", "long_words", "stops",
)

_KINDS = np.zeros((9, 256), dtype=bool)
for _row, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#$%&*+/<=>@[\\]^_`{}~", b"0123456789", b",;:'\"()-", b"|", b"!", bytes(range(128, 256)), b".?")):
    _KINDS[_row, list(_set)] = True


def _per(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values[of[i]:of[i+1]]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[of[1:]] - total[of[:-1]]


def statistics_of(words) -> np.ndarray:
    """One row of FEATURES for each document of a slice."""
    of, docs = words.of, len(words.of) - 1
    n = np.diff(of).astype(float)
    one = np.maximum(n, 1)
    sums = [_per(words.offsets, _KINDS[i][words.data]) for i in range(len(_KINDS))]
    letters = np.maximum(sums[0] + sums[1], 1)
    size = words.end - words.start
    chars = np.maximum(_per(of, size), 1)
    same = np.zeros(len(words.hash))
    doc = np.repeat(np.arange(docs), np.diff(of))
    if len(same) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    distinct, top, grams, lines, line_words = (np.zeros(docs) for _ in range(5))
    three = words.grams(3)
    newline = np.flatnonzero(words.data == 10)
    for i in range(docs):
        lo, hi = of[i], of[i + 1]
        if hi == lo:
            continue
        counts = np.unique(words.hash[lo:hi], return_counts=True)[1]
        distinct[i], top[i] = len(counts) / n[i], counts.max() / n[i]
        if hi - lo >= 3:
            grams[i] = 1 - len(np.unique(three[lo : hi - 2])) / (hi - lo - 2)
        at = newline[np.searchsorted(newline, words.offsets[i]) : np.searchsorted(newline, words.offsets[i + 1])]
        starts = np.unique(np.searchsorted(words.start[lo:hi], np.concatenate(([words.offsets[i]], at))))
        starts = starts[starts < hi - lo]
        line_words[i] = n[i] / max(1, len(starts))
        sums_of_lines = np.add.reduceat(words.hash[lo:hi] * np.arange(1, hi - lo + 1, dtype=np.uint64)[np.arange(hi - lo) - np.repeat(starts, np.diff(np.append(starts, hi - lo)))], starts)
        lines[i] = 1 - len(np.unique(sums_of_lines)) / len(starts)
    return np.column_stack([
        np.log1p(n), np.minimum(chars / one, 100), sums[0] / letters, sums[2] / chars, sums[3] / chars, sums[4] / chars, sums[5] / one, sums[6] / one,
        sums[7] / chars, distinct, top, _per(of, same) / one, grams, lines, np.minimum(line_words, 1000), _per(of, size <= 3) / one, _per(of, size > 12) / one, sums[8] / one,
    ]) * (n > 0)[:, None]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every document."""

    def each(batches):
        for batch in batches:
            for a, b, words in slices(batch.column(1)):
                x = statistics_of(words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(x[:, j]) for j in range(len(FEATURES))]], ["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(each, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no label may be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    """A rule as a condition on the statistics' columns."""
    out = F.lit(True)
    for name, above, at in rule:
        out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
    return out


def _paths(node, path: Rule = ()) -> set[Rule]:
    """The path prefixes of a tree as rules, without the empty one."""
    out = {path} if path else set()
    if "LeafNode" not in node.getClass().getName():
        split = node.split()
        name, at = FEATURES[split.featureIndex()], float(split.threshold())
        out |= _paths(node.leftChild(), (*path, (name, False, at))) | _paths(node.rightChild(), (*path, (name, True, at)))
    return out


def fit(statistics: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 16, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> RuleModel:
    """A rule ensemble for labels.quality; at most `sample` labelled rows, drawn by a seeded hash, are used."""
    y = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    rows = statistics.where(~held_out()).join(y, "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(sample)
    rows = stored(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.coalesce(1)), "labelled")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = float(ones or 0) / n if n else 0.5
        return RuleModel(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), ())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=256, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted(set().union(*[_paths(t._call_java("rootNode")) for t in forest.trees]))
    if not rules:
        return RuleModel(float(np.log(ones / (n - ones))), ())
    hits = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    hits = stored(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="hits").transform(hits).select("label", "hits"), "hits")
    model = LogisticRegression(featuresCol="hits", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(hits)
    weights = model.coefficients.toArray()
    return RuleModel(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def score_quality(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    statistics = stored(text_statistics(docs), "statistics")
    score = fit(statistics, labels, **parameters).score()
    return statistics.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that the classifier does not reject; rows without a doc_id stay."""
    bad = score_quality(docs, labels, **parameters).where("predicted = 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
