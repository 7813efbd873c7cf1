"""Toxicity by a classifier chain: categories are predicted in turn, and each later model sees the earlier probabilities.

Fitting: a bounded sample of labelled documents gives a lexicon (words and word
beginnings that speak for a category, found by counting on the cluster) and one
linear model per category. A later category is trained on out-of-fold
predictions of the earlier ones, so it meets probabilities of the kind it will
meet in use. Scoring: one Arrow pass over whole texts, no shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wardlens.llm.samples import labelled_sample
from wardlens.session import ship_by_value, stored

ship_by_value(__name__)

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings, which catch a stem under many endings.
STEMS = (4, 5, 6)
FLUSH = 200_000


def features(text: str) -> set[str]:
    """Distinct words of letters in lower case, and their beginnings marked with a hyphen."""
    words = set(LETTERS.findall(text.lower()))
    found = set(words)
    for n in STEMS:
        found.update(w[:n] + "-" for w in words if len(w) > n)
    return found


@dataclass(frozen=True)
class Chain:
    """A fitted chain: per category a bias, weights of lexicon entries and weights of the earlier categories."""

    categories: tuple[str, ...]
    lexicon: dict[str, int]
    bias: tuple[float, ...]
    weights: np.ndarray
    earlier: tuple[tuple[float, ...], ...]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.categories)))
        for i, text in enumerate(texts):
            hits = [self.lexicon[f] for f in self._hits(text)]
            scores = self.weights[:, hits].sum(axis=1)
            for k, (bias, earlier) in enumerate(zip(self.bias, self.earlier, strict=True)):
                z = bias + scores[k] + sum(w * p for w, p in zip(earlier, out[i], strict=False))
                out[i, k] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out

    def _hits(self, text: str):
        words = set(LETTERS.findall(text.lower()))
        hits = words & self.lexicon.keys()
        for n in STEMS:
            hits |= {w[:n] + "-" for w in words if len(w) > n} & self.lexicon.keys()
        return sorted(hits)


def count_features(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``feature, n`` and per category ``n_<category>``: documents of the sample that have the feature."""
    names = [f"n_{c}" for c in categories]

    def run(batches):
        held: dict[str, list[int]] = {}

        def out():
            columns = list(zip(*held.values(), strict=True)) if held else [()] * (len(names) + 1)
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["feature", "n", *names])

        for batch in batches:
            flags = list(zip(*[batch.column(c).to_pylist() for c in categories], strict=True))
            for text, flag in zip(batch.column("text").to_pylist(), flags, strict=True):
                for f in features(text):
                    counts = held.get(f)
                    if counts is None:
                        counts = held[f] = [0] * (len(names) + 1)
                    counts[0] += 1
                    for k, on in enumerate(flag, 1):
                        if on:
                            counts[k] += 1
                if len(held) >= FLUSH:
                    yield out()
                    held.clear()
        yield out()

    counted = rows.mapInArrow(run, "feature string, n bigint, " + ", ".join(f"{n} bigint" for n in names))
    return counted.groupBy("feature").agg(*[F.sum(n).alias(n) for n in ["n", *names]])


def choose_lexicon(counts: DataFrame, totals: dict[str, int], n_rows: int, size: int, least: int) -> dict[str, int]:
    """The ``size`` features that say most about any category, by log-likelihood ratio, with at least ``least`` documents.

    A feature must pass what chance would give the best of all features tried, so that a small sample does not fill the
    lexicon with accidents.
    """

    def ratio(name: str, total: int) -> Column:
        both, n = F.col(f"n_{name}").cast("double"), F.col("n").cast("double")

        def part(seen: Column, expected: Column) -> Column:
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        p = total / max(n_rows, 1)
        gain = part(both, n * p) + part(n - both, n * (1 - p)) + part(F.lit(float(total)) - both, (n_rows - n) * p)
        gain = gain + part(n_rows - n - (total - both), (n_rows - n) * (1 - p))
        # Only features that speak for the category.
        return F.when((both > n * p) & (F.lit(0) < total), gain).otherwise(0.0)

    score = F.greatest(*[ratio(c, t) for c, t in totals.items()], F.lit(0.0))
    scored = stored(counts.where(F.col("n") >= least).withColumn("score", score).select("feature", "score"), "toxicity-features")
    by_chance = math.log(max(scored.count(), 1)) + 1
    rows = scored.where(F.col("score") > by_chance).orderBy(F.desc("score"), "feature").limit(size).collect()
    return {r.feature: i for i, r in enumerate(rows)}


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 20_000, lexicon_size: int = 2_000, folds: int = 3,
    least: int = 3, penalty: float = 1e-4, id_column: str = "doc_id", text_column: str = "text",
) -> Chain:
    """Fit a chain for ``categories`` (name to a boolean column over ``labels``), in their order.

    Fitted on at most ``sample`` labelled documents. Lexicon, models and folds depend on ids, texts and labels only, so a
    rerun gives the same chain up to rounding. A category without both outcomes in the sample gets its constant rate.
    Null texts count as empty; labels without a document, null ids and labels for which a category is null are left out;
    of several documents with one id the least text counts; an empty sample predicts 0.
    """
    names = tuple(categories)
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in categories.values()])
    chosen = labelled_sample(labels, sample, id_column, known).select(F.col(id_column).alias("id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    # At most ``sample`` rows, so the broadcast has a bound, and so has the table that one text per id makes.
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = stored(texts.join(F.broadcast(chosen), "id").groupBy("id", *names).agg(F.min("text").alias("text")), "toxicity-sample")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first().asDict()
    n_rows = totals.pop("n")
    if not n_rows:
        return Chain(names, {}, (-math.log(1e6),) * len(names), np.zeros((len(names), 1)), tuple((0.0,) * k for k in range(len(names))))
    lexicon = choose_lexicon(count_features(rows, names), totals, n_rows, lexicon_size, least)
    width = max(len(lexicon), 1)

    def vectors(batches):
        for batch in batches:
            hits = [sorted(features(t) & lexicon.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[batch.column(n) for n in names], pa.array(hits, pa.list_(pa.string()))], ["id", *names, "hits"])

    kind = rows.schema["id"].dataType.simpleString()
    # Vectors are made by Spark: a Python function on top of the pass would give each task a second worker, which stays.
    as_vector = CountVectorizerModel.from_vocabulary(sorted(lexicon, key=lexicon.get) or [""], inputCol="hits", outputCol="words", binary=True)
    table = as_vector.transform(rows.mapInArrow(vectors, f"id {kind}, " + ", ".join(f"{n} int" for n in names) + ", hits array<string>"))
    fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fold")), F.lit(folds)).cast("int").alias("fold")
    table = stored(table.select("id", *names, fold, F.col("words").alias("words", metadata={})), "toxicity-vectors")

    bias, weights, chain = [], np.zeros((len(names), width)), []
    for k, name in enumerate(names):
        inputs = VectorAssembler(inputCols=["words", *[f"p_{n}" for n in names[:k]]], outputCol="features")
        model = LogisticRegression(labelCol=name, regParam=penalty, maxIter=40, standardization=False, probabilityCol="probability")
        # The sample is bounded, so a fit needs no more than one partition; more would only add tasks to each iteration.
        ready = inputs.transform(table.coalesce(1))

        def fit(part, model=model, name=name):
            found = part.agg(F.count(F.lit(1)).alias("n"), F.sum(name).alias("on")).first()
            return model.fit(part) if found.n and 0 < found.on < found.n else (found.on or 0) / max(found.n, 1)

        whole = fit(ready)
        if isinstance(whole, float):
            rate = min(max(whole, 1e-6), 1 - 1e-6)
            bias.append(float(np.log(rate / (1 - rate))))
            chain.append((0.0,) * k)
            table = table.withColumn(f"p_{name}", F.lit(rate))
            continue
        coefficients = whole.coefficients.toArray()
        bias.append(float(whole.intercept))
        weights[k] = coefficients[:width]
        chain.append(tuple(map(float, coefficients[width:])))
        if k + 1 == len(names):
            break
        # Out-of-fold probabilities of this category for the categories that follow.
        parts = []
        for f in range(folds):
            held, model_f = ready.where(F.col("fold") == f), fit(ready.where(F.col("fold") != f))
            if isinstance(model_f, float):
                parts.append(held.select(*table.columns, F.lit(model_f).alias(f"p_{name}")))
            else:
                parts.append(model_f.transform(held).select(*table.columns, vector_to_array("probability")[1].alias(f"p_{name}")))
        joined = parts[0]
        for part in parts[1:]:
            joined = joined.union(part)
        table = stored(joined, "toxicity-folds")
    return Chain(names, lexicon, tuple(bias), weights, tuple(chain))


def score(docs: DataFrame, chain: Chain, threshold: float = 0.4, id_column: str = "doc_id", text_column: str = "text", carried: list[str] | None = None) -> DataFrame:
    """``id``, one probability ``p_<category>`` each, ``score`` (the last category's, the end of the chain) and ``toxic`` (score >= threshold).

    Null and empty texts are scored like texts without words. Every row is scored on its own, with or without an id,
    repeated or not; texts are read whole. With ``carried``, those columns of ``docs`` come back too, in a struct ``row``.
    """
    columns = [F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")]
    more = ["row"] if carried else []
    rows = docs.select(*columns, *[F.struct(*[F.col(c) for c in carried]).alias("row") for _ in more])
    # Plain values only: a broadcast is unpickled by name, and executors need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(chain, f.name) for f in fields(chain)))
    outputs = [f"p_{c}" for c in chain.categories]

    def run(batches):
        fitted = Chain(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = fitted.probabilities(part.column("text").to_pylist())
                columns = [pa.array(found[:, k]) for k in range(found.shape[1])]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, *[part.column(m) for m in more]], ["id", *outputs, *more])

    schema = StructType([rows.schema["id"], *[StructField(o, DoubleType()) for o in outputs], *[rows.schema[m] for m in more]])
    scored = rows.mapInArrow(run, schema)
    return scored.select(F.col("id").alias(id_column), *outputs, F.col(outputs[-1]).alias("score"), (F.col(outputs[-1]) >= threshold).alias("toxic"), *more)


def standard_categories() -> dict[str, Column]:
    """Toxic inside good prose, toxic inside junk, then toxic at all, which builds on both and decides."""
    toxic, good = F.col("toxic") == 1, F.coalesce(F.col("quality") == 1, F.lit(False))
    return {"in_prose": toxic & good, "in_junk": toxic & ~good, "toxic": toxic}


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    return score(docs, chain, threshold, id_column, text_column, docs.columns).where("NOT toxic").select("row.*")

