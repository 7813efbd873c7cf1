"""Quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Trees grown on a bounded labelled sample
give conjunctive rules, one per node; a lasso logistic model keeps the few rules
that matter; and the result is compiled back into one Spark column, so scoring
is a plain scan with generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.samples import labelled_sample
from wardlens.session import stored

WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """What the rules may ask of a text; every statistic is 0 for an empty text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size(words)
    lines = F.size(F.split(text, "\n"))

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    return {
        "chars": F.length(text).cast("double"),
        "words": n_words.cast("double"),
        "word_length": (F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) / F.greatest(n_words, F.lit(1))).cast("double"),
        "distinct_words": (F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1))).cast("double"),
        "line_words": (n_words / lines).cast("double"),
        "upper": share(r"\p{Lu}+") * 1.0,
        "upper_runs": share(r"\p{Lu}{3,}"),
        "digits": share(r"[0-9]+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"()-]+"),
        "stops": share(r"[.!?]+"),
        "exclaims": share(r"!"),
        "bars": share(r"\|"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds on statistics, as SQL over their columns, and its lasso weight."""

    conditions: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        condition = F.lit(True)
        for name, sign, bound in self.conditions:
            condition = condition & (F.col(name) <= F.lit(bound) if sign == "<=" else F.col(name) > F.lit(bound))
        return condition.cast("double")


def tidy(path: list[tuple[str, str, float]]) -> tuple[tuple[str, str, float], ...]:
    """One bound per statistic and side: the tightest of the path."""
    tight: dict[tuple[str, str], float] = {}
    for name, sign, bound in path:
        held = tight.get((name, sign))
        tight[name, sign] = bound if held is None else min(held, bound) if sign == "<=" else max(held, bound)
    return tuple((name, sign, bound) for (name, sign), bound in sorted(tight.items()))


def tree_paths(node, names: list[str], path: list[tuple[str, str, float]]):
    """The path to every node below the root of a fitted tree."""
    if path:
        yield tidy(path)
    if node.numDescendants():
        name, bound = names[node.split().featureIndex()], float(node.split().threshold())
        yield from tree_paths(node.leftChild(), names, [*path, (name, "<=", bound)])
        yield from tree_paths(node.rightChild(), names, [*path, (name, ">", bound)])


def fit_rules(
    docs: DataFrame, labels: DataFrame, label: Column, where: Column | None = None, sample: int = 20_000, trees: int = 12, depth: int = 3,
    penalty: float = 2e-3, seed: int = 7, id_column: str = "doc_id", text_column: str = "text",
) -> tuple[float, list[Rule]]:
    """The intercept and the rules with a weight.

    Fitted on at most ``sample`` labelled rows (of those that meet ``where``). Inputs are statistics of the text alone.
    A null text counts as empty, rows without id or label are left out. With one outcome only there are no rules and the
    intercept is that outcome's; with no rows at all it is 0.
    """
    chosen = labelled_sample(labels.select(id_column, label.cast("double").alias("label")).where("label IS NOT NULL"), sample, id_column, where)
    texts = docs.select(F.col(id_column).alias(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    stats = statistics(F.col("text"))
    names = list(stats)
    # At most ``sample`` rows, so the broadcast has a bound.
    rows = stored(texts.join(F.broadcast(chosen), id_column).select("label", *[c.alias(n) for n, c in stats.items()]), "quality-sample")
    n, on = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < on < n:
        return (0.0 if n == 0 else 6.0 if on else -6.0), []
    table = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", seed=seed, minInstancesPerNode=max(2, n // 2000)).fit(table)
    paths = sorted({p for tree in forest.trees for p in tree_paths(tree._call_java("rootNode"), names, [])})
    if not paths:
        return 0.0, []
    flags = rows.select("label", *[Rule(p).column().alias(f"r{i}") for i, p in enumerate(paths)])
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="features").transform(flags).select("label", "features")
    lasso = LogisticRegression(labelCol="label", regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(table)
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [Rule(p, float(w)) for p, w in zip(paths, weights, strict=True) if w]


def compiled(intercept: float, rules: list[Rule]) -> Column:
    """The ensemble as one column over the statistics: a probability."""
    total = F.lit(intercept)
    for rule in rules:
        total = total + F.lit(rule.weight) * rule.column()
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, intercept: float, rules: list[Rule], threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row: the probability of label 1 and whether it reaches the threshold.

    Null and empty texts have statistics of 0 and a score like any other. Rows are scored one by one, whole, with or
    without an id; only the statistics that the rules use are computed. Other columns are not read.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    used = {name for rule in rules for name, _, _ in rule.conditions}
    stats = {n: c for n, c in statistics(F.col("text")).items() if n in used}
    scored = texts.select("id", *[c.alias(n) for n, c in stats.items()]).select("id", compiled(intercept, rules).alias("score"))
    return scored.select(F.col("id").alias(id_column), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
