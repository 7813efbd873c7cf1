import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.conftest import ODD
from wardlens.llm import quality, suffix_tree, toxicity
from wardlens.llm.samples import labelled_sample

LABELS = "doc_id bigint, quality int, toxic int"


def bad_words(i):
    return ["scoundrel", "rascalish", "rascalous", "rascally"][i % 4]


def labelled(make_docs, spark, n=400):
    rows = [(i, f"some words about thing{i % 7} and other{i % 11} " * 3 + (f"you {bad_words(i)} fool{i}" if i % 5 == 0 else "")) for i in range(n)]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(n)]
    return make_docs(rows), spark.createDataFrame([*labels, (None, 1, 1), (10**6, 0, 1)], LABELS)


def test_chain_finds_words_and_stems(make_docs, spark):
    docs, labels = labelled(make_docs, spark)
    chain = toxicity.fit_chain(docs, labels, toxicity.standard_categories())
    assert chain.categories == ("in_prose", "in_junk", "toxic") and [len(e) for e in chain.earlier] == [0, 1, 2]
    assert "rascal-" in chain.lexicon and "some" not in chain.lexicon
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert all(r.toxic == (i % 5 == 0) for i, r in got.items())
    fresh = make_docs([*ODD, (90, "RASCALESQUE!"), (91, "a kind word")])
    scored = toxicity.score(fresh, chain).collect()
    chance = {r.doc_id: r.score for r in scored}
    # The stem of known words raises the chance of a new one; texts without words stay clean.
    assert len(scored) == len(ODD) + 2 and chance[90] > 3 * chance[91] and max(chance[i] for i in (None, 1, 91)) < 0.4
    kept = toxicity.drop_toxic(fresh, chain, threshold=3 * chance[91])
    assert kept.columns == fresh.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in ODD} | {91}


def test_fit_takes_one_worker_a_task(make_docs, spark, monkeypatch):
    seen = []

    def stored(frame, label, store=toxicity.stored):
        seen.append((label, frame._jdf.queryExecution().executedPlan().toString()))
        return store(frame, label)

    monkeypatch.setattr(toxicity, "stored", stored)
    docs, labels = labelled(make_docs, spark)
    chain = toxicity.fit_chain(docs, labels, toxicity.standard_categories())
    assert {"toxicity-vectors", "toxicity-folds"} <= {label for label, _ in seen} and len(chain.lexicon) > 1
    assert all(plan.count("MapInArrow") + plan.count("EvalPython") <= 1 for _, plan in seen)


def test_chain_uses_earlier_probabilities():
    chain = toxicity.Chain(("a", "b"), {"x": 0}, (0.0, -1.0), np.array([[2.0], [0.0]]), ((), (4.0,)))
    (a, b), (c, d) = chain.probabilities(["x", ""])
    assert a == pytest.approx(1 / (1 + math.exp(-2))) and c == pytest.approx(0.5)
    assert b == pytest.approx(1 / (1 + math.exp(1 - 4 * a))) and d == pytest.approx(1 / (1 + math.exp(1 - 2)))


def test_chain_without_outcomes(make_docs, spark):
    docs, labels = labelled(make_docs, spark, 40)
    for some in (labels.where("toxic = 0"), labels.where("false")):
        chain = toxicity.fit_chain(docs, some, toxicity.standard_categories())
        assert not any(r.toxic for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(docs.where("false"), chain).count() == 0


def test_sample_is_bounded_and_stable(spark):
    labels = spark.createDataFrame([(i % 90, 1, i % 2) for i in range(200)] + [(None, 0, 0)], LABELS)
    one, two = (sorted(map(tuple, labelled_sample(labels.repartition(n), 50).collect())) for n in (1, 7))
    assert one == two and len({r[0] for r in one}) == 50
    assert labelled_sample(labels, 500).count() == 90


def junk(i):
    return [" ".join(["STOP!!"] * 30), "word*** other### " * 20, "same " * 60][i % 3] + f"tail{i}"


def prose(i):
    return ". ".join(" ".join(f"word{(i * 31 + j * 7 + k) % 997}" for k in range(8)) for j in range(6)) + "."


def test_rules_separate_and_compile(make_docs, spark):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], LABELS)
    docs = make_docs(rows)
    intercept, rules = quality.fit_rules(docs, labels, F.col("quality"), where=F.col("doc_id") < 200)
    assert rules and all(r.weight and r.conditions for r in rules)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, intercept, rules).collect()}
    assert all(p == int(i % 4 > 0) for i, (s, p) in got.items() if i >= 200)
    # The compiled column says what the rules say.
    stats = {r.doc_id: r for r in docs.select("doc_id", *[c.alias(f"{n}") for n, c in quality.statistics(F.col("text")).items() if n not in docs.columns]).collect()}
    for i in (0, 1, 2, 4):
        z = intercept + sum(r.weight for r in rules if all((stats[i][n] <= b) == (s == "<=") for n, s, b in r.conditions))
        assert got[i][0] == pytest.approx(1 / (1 + math.exp(-z)))
    odd = quality.score(make_docs(ODD), intercept, rules).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert quality.score(docs.where("false"), intercept, rules).count() == 0


def test_rules_without_outcomes(make_docs, spark):
    docs = make_docs(ODD)
    one = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], LABELS)
    assert quality.fit_rules(docs, one, F.col("quality")) == (6.0, [])
    assert quality.fit_rules(docs, one.where("false"), F.col("quality")) == (0.0, [])


def tree_rows():
    """Texts whose next words depend on one, two and three words before."""
    rows = []
    for i in range(300):
        a, b = ("le chat noir", "der hund laut")[i % 2].split()[0], i % 9
        parts = [f"{a} w{(i * j + b) % 23}{i % 2} of the same rare{i}x{j}" for j in range(12)]
        parts += [f"kw{(i + j) % 5} on at zw{(i + j) % 5} jw{(i * j) % 4} in yw{(i * j) % 4}" for j in range(6)]
        rows.append((i, " ".join(parts)))
    return rows


class PlainTree:
    """The suffix tree in dictionaries: every gram of a training text counted, every state tested."""

    def __init__(self, texts, depth, least):
        counts = [Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)) for k in range(1, depth + 2)]
        self.c, self.n, self.v = counts[0], sum(map(len, texts)), len(counts[0])
        self.states = {}
        for k in range(1, depth + 1):
            followers = {}
            for g, n in counts[k].items():
                if n >= least:
                    followers.setdefault(g[:-1], {})[g[-1]] = n
            kept = {}
            for state, found in followers.items():
                total = counts[k - 1][state]
                parent = {w: 10 ** self.log(state[1:], w) for w in found}
                share = {w: (n - 0.5) / total for w, n in found.items()}
                left, rest = max(1 - sum(share.values()), 1e-12), max(1 - sum(parent.values()), 1e-12)
                gain = sum(n * math.log(share[w] / parent[w]) for w, n in found.items()) + (total - sum(found.values())) * math.log(left / rest)
                if gain > len(found) * math.log(max(total, 2)) / 2:
                    kept[state] = share, left / rest
            self.states |= kept

    def root(self, word):
        return math.log10((self.c.get((word,), 0) + 1) / (self.n + self.v + 1))

    def log(self, state, word):
        """log10 of a word's probability in the longest state kept, with states of any length falling back."""
        if not state:
            return self.root(word)
        if state not in self.states:
            return self.log(state[1:], word)
        share, back = self.states[state]
        return math.log10(share[word]) if word in share else math.log10(back) + self.log(state[1:], word)

    def score(self, text, depth):
        return sum(self.log(tuple(text[max(i - depth, 0) : i]), w) for i, w in enumerate(text))


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def split_words(text):
    return [*(text or "").encode().lower().split(), None]


def plain_and_distributed(make_docs, rows, depth, least, **shares):
    plain = PlainTree([split_words(t) for i, t in rows if not held(i)], depth, least)
    result = suffix_tree.score(make_docs(rows), depth=depth, least=least, **shares).collect()
    base = lambda words: sum(plain.root(w) for w in words)
    want = sorted((i, held(i), len(w), sum((x,) in plain.c for x in w), plain.n, round(base(w), 6), round(plain.score(w, depth), 6)) for i, t in rows for w in [split_words(t)])
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in result)
    return plain, want, got


@pytest.mark.parametrize("shares", [{}, {"word_share": 1e-3, "gram_share": 1e-3}, {"word_share": 1.0, "gram_share": 1.0}])
def test_tree_against_brute_force(make_docs, shares):
    """Base and tree scores equal a plain tree's, whatever is looked up in arrays and whatever in joins."""
    rows = [*[r for r in ODD if r[0] is not None], *[(1000 + i, t) for i, t in tree_rows()]]
    plain, want, got = plain_and_distributed(make_docs, rows, 3, 3, **shares)
    assert got == want and {len(s) for s in plain.states} == {1, 2, 3}
    fresh = [r for r in got if r[1] and r[0] >= 1000]
    assert fresh and sum(r[6] for r in fresh) > sum(r[5] for r in fresh)
    # In every state the probabilities of all known words and of one unknown word sum to 1.
    for state in [(), *list(plain.states)[::50]]:
        assert sum(10 ** plain.log(state, w) for w in [*[g[0] for g in plain.c], b"unknown"]) == pytest.approx(1)


def test_tree_of_one_word_and_without_states(make_docs):
    rows = [(1000 + i, t) for i, t in tree_rows()]
    for depth, least in ((1, 2), (2, 10**6), (0, 1)):
        plain, want, got = plain_and_distributed(make_docs, rows, depth, least)
        assert got == want and bool(plain.states) == (least == 2)


def test_other_documents_drop_no_state(make_docs):
    """Thresholds are counts: a state stays when documents of other words are added, and the tree grows with them."""
    rows = [(1000 + i, t) for i, t in tree_rows()]
    more = [(10_000 + i, t.replace("w", "v").replace("same", "equal")) for i, t in tree_rows()]
    few = PlainTree([split_words(t) for _, t in rows], 3, 3)
    many = PlainTree([split_words(t) for _, t in rows + more], 3, 3)
    gone = [s for s in few.states if s not in many.states and not {b"of", b"the", b"le", b"der"} & set(s)]
    assert not gone and len(many.states) > 1.5 * len(few.states)
    _, want, got = plain_and_distributed(make_docs, rows + more, 3, 3, word_share=1e-3, gram_share=1e-3)
    assert got == want


def test_very_long_words_and_only_held_out_rows(make_docs):
    long = "x" * 100_000
    rows = [(i, f"{long} b {long}y c") for i in range(40)]
    _, want, got = plain_and_distributed(make_docs, rows, 2, 2)
    assert got == want
    alone = next(i for i in range(100) if held(i))
    assert [(r.n_known, r.train_tokens, r.score) for r in suffix_tree.score(make_docs([(alone, "a b")])).collect()] == [(0, 0, 0.0)]


def test_grams_travel_in_packs(make_docs):
    """What counting and asking send grows with packs, not with a row per gram, and a pack gives back what went in."""
    docs = make_docs([(i, " ".join(f"w{(i * j) % 97}" for j in range(200))) for i in range(200)])
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast((*[np.zeros(0, np.uint64)] + [np.zeros(0)] * 3, np.zeros(0, np.uint64), np.zeros(0), *[np.full(1 << 10, 255, np.uint8)] * 2))
    packs = suffix_tree.asked(rows, shared, 3, 5).where("keys IS NOT NULL").collect()
    assert len(packs) <= 5 * rows.rdd.getNumPartitions()
    # One entry per text and gram of up to four words, the end being a word, as often as it is there.
    want = sum(len({tuple(t[i : i + size]) for i in range(len(t) - size + 1)}) for r in docs.collect() for t in [split_words(r.text)] for size in (1, 2, 3, 4))
    assert sum(len(suffix_tree.stepped(r.keys)) for r in packs) == want
    assert sum(int(suffix_tree.unplaned(r.n).sum()) for r in packs) == 200 * (201 + 200 + 199 + 198)
    assert sum(len(r.keys) + len(r.text) + len(r.n) for r in packs) < 12 * want
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 1_000, np.uint64))
    assert (suffix_tree.stepped(suffix_tree.steps(keys)) == keys).all() and len(suffix_tree.stepped(suffix_tree.steps(keys[:0]))) == 0
    sums = np.array([-1.5, 0.0, 1e-300])
    assert (suffix_tree.unplaned(suffix_tree.planes(sums), np.float64) == sums).all()


def test_arrays_hold_the_most_frequent_grams(spark):
    grams = spark.createDataFrame([(i, n) for i, n in enumerate([9, 8, 8, 7, 7, 7, 3])], "key bigint, n bigint")
    got = [suffix_tree.most_frequent(grams, share, most) for share, most in ((9, 3), (9, 2), (9, 1), (8.5, 6), (8, 100), (20, 0))]
    assert got == [8, 9, 9, 7, 3, 20]


def test_equal_rows_and_empty_tables(make_docs):
    docs = make_docs([(3, "a b c"), (3, "a b c"), (3, "other"), (None, None)])
    got = sorted((str(r.doc_id), r.n_tokens) for r in suffix_tree.score(docs).collect())
    assert got == [("3", 2), ("3", 4), ("3", 4), ("None", 1)]
    assert suffix_tree.score(docs.where("false")).count() == 0


def test_pipeline_stages(spark):
    """Each stage works on all that its predecessor kept, and its decisions are those of the operator."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    texts = [r.text for r in docs.dropDuplicates(["doc_id"]).collect()]
    assert len({" ".join(t.split()) for t in texts}) == len(texts)
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert final.count() == counts[-1] and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(final.columns)
