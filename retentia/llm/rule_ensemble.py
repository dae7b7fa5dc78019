"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on labelled rows, every path of a tree becomes a rule (a
conjunction of comparisons), a logistic model with an L1 penalty weighs the
rules, and those with a weight are compiled into one column expression
(Friedman and Popescu, "Predictive learning via rule ensembles", 2008).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.base import bounded_sample, count_of, let, renamed, returned, words
from retentia.session import materialise

LABELLED = 20_000
TREES, DEPTH = 20, 4
PENALTY = 0.002
# Classes of characters by name, as in a regular expression.
CLASSES = {
    "symbols": "#*$%&|<>", "upper": "A-Z", "digits": "0-9", "ends": ".,;:!?", "exclamations": "!", "bars": "|",
    "other": "()\\[\\]{}=_/\\\\@^~`\"'+-",
}
STATISTICS = ["log_words", "word_length", "longest", "distinct", "follows", "line_length", "repeated_lines", "wide", *CLASSES]


def statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without ``text``, with the doubles of ``STATISTICS``; zeros for a null or empty text."""
    others = [c for c in rows.columns if c != text]
    t = F.col("_text")

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        length = F.aggregate(w, F.struct(F.lit(0).alias("all"), F.lit(0).alias("most")), _lengths)
        follows = F.size(F.filter(F.transform(w, lambda x, i: x == F.get(w, i + 1)), lambda x: x))
        return F.struct(
            F.log1p(F.size(w)).alias("log_words"), (length["all"] / n).alias("word_length"),
            F.log1p(length["most"]).alias("longest"), (F.size(F.array_distinct(w)) / n).alias("distinct"),
            (follows / n).alias("follows"),
        )

    def of_lines(x: Column) -> Column:
        n = F.greatest(F.size(x), F.lit(1))
        return F.struct(
            F.log1p(F.length(t) / n).alias("line_length"), ((F.size(x) - F.size(F.array_distinct(x))) / n).alias("repeated_lines")
        )

    def of_rest(r: Column) -> Column:
        """Shares of characters, from what is left without a-z and blanks."""
        size = F.greatest(F.length(t), F.lit(1))
        return F.struct(*[(count_of(r, c) / size).alias(name) for name, c in CLASSES.items()])

    size = F.greatest(F.length(t), F.lit(1))
    made = rows.select(*others, F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        *others,
        let(words(t), of_words).alias("w"),
        let(F.split(t, "\n"), of_lines).alias("l"),
        let(F.regexp_replace(t, "[a-z \n]+", ""), of_rest).alias("c"),
        ((F.octet_length(t) - F.length(t)) / size).alias("wide"),
    )
    picked = {"log_words": "w", "word_length": "w", "longest": "w", "distinct": "w", "follows": "w", "line_length": "l", "repeated_lines": "l"}
    picked |= dict.fromkeys(CLASSES, "c")
    return made.select(*others, *[F.col(f"{picked[c]}.{c}" if c in picked else c).cast("double").alias(c) for c in STATISTICS])


def _lengths(done: Column, word: Column) -> Column:
    n = F.length(word)
    return F.struct((done["all"] + n).alias("all"), F.greatest(done["most"], n).alias("most"))


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, True for "at most", threshold) each, in one order."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, threshold in self.tests:
            out = out & (F.col(name) <= threshold if low else F.col(name) > threshold)
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    weights: dict[Rule, float]

    def column(self) -> Column:
        """Probability of label 1 from the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _paths(node, names: list[str], above: dict[tuple[str, bool], float], found: set[Rule]) -> None:
    if above:
        found.add(Rule(tuple(sorted((n, low, t) for (n, low), t in above.items()))))
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, threshold = names[split.featureIndex()], split.threshold()
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        old = above.get((name, low))
        # Of two tests of one statistic on a path the narrower counts.
        tight = threshold if old is None else min(old, threshold) if low else max(old, threshold)
        _paths(child, names, {**above, (name, low): tight}, found)


def rules(sample: DataFrame, label: str, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Every path of a small forest, in a fixed order."""
    vector = sample.select(label, array_to_vector(F.array(*STATISTICS)).alias("x"))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5,
        featureSubsetStrategy="onethird",
    ).fit(vector)
    found: set[Rule] = set()
    for tree in forest.trees:
        _paths(tree._call_java("rootNode"), STATISTICS, {}, found)
    return sorted(found, key=lambda r: r.tests)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    most: int = LABELLED, penalty: float = PENALTY, trees: int = TREES, depth: int = DEPTH,
) -> Ensemble:
    """Ensemble of about ``most`` labelled rows, chosen by a seeded hash of the id.

    Labels that are null or whose id has no document are left out; repeated
    labels count each.  With labels of one value only, or none, every text gets
    the smoothed share of label 1.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("label")).dropna()
    chosen = F.broadcast(bounded_sample(known, ["_id"], most, seed=7))  # about `most` rows
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id")
    sample = materialise(statistics(rows, "text").repartition(8, "_id").sortWithinPartitions("_id").drop("_id"), "labelled")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    good, total = counts.get(1.0, 0), sum(counts.values())
    if not 0 < good < total:
        return Ensemble(math.log((good + 1) / (total - good + 1)), {})
    found = rules(sample, "label", trees, depth)
    met = array_to_vector(F.array(*[r.column().cast("double") for r in found]))
    model = LogisticRegression(
        featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=200, tol=1e-7
    ).fit(materialise(sample.select("label", met.alias("x")), "rules"))
    weights = {r: float(w) for r, w in zip(found, model.coefficients, strict=True) if w != 0.0}
    return Ensemble(float(model.intercept), weights)


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", cut: float = 0.7) -> DataFrame:
    """``docs`` without ``text``, with ``score`` and ``predicted``, 1 from ``cut`` up.

    The whole text counts; null and empty texts are scored by their zeros.
    """
    docs, names = renamed(docs)
    rows = statistics(docs, names[text])
    rows = rows.select(*[c for old, c in names.items() if old != text], ensemble.column().alias("score"))
    judged = rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
    return judged.select(*returned(names, [text], ["score", "predicted"]))
