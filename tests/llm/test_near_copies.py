import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from wardlens.llm import hnsw, minhash, substrings, words
from wardlens.llm.components import components


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def variants(seed, n, length, changes):
    """A base text of random words, and copies with some words replaced."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.choice(changes)):
            copy[draw.randrange(length)] = f"v{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def near_rows():
    draw = random.Random(5)
    texts = variants(1, 40, 120, range(0, 12)) + variants(2, 25, 60, range(0, 4)) + variants(3, 10, 12, range(0, 2)) + ["a b c", "A B C", "a b c d"]
    texts += [" ".join(f"u{draw.randrange(10**5)}" for _ in range(50)) for _ in range(40)] + ["same text of more than four words"] * 30
    draw.shuffle(texts)
    return [(100 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_equal_brute_force(make_docs, size):
    rows = [r for r in ODD if r[0] not in (None, 5)] + near_rows()
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(sets, links)
    want = sorted((i, len(s), root[i], root[i] == i) for i, s in sets.items())
    assert sorted(map(tuple, minhash.near_groups(make_docs(rows), shingle=size).collect())) == want


def test_near_odd_rows(make_docs):
    docs = make_docs([*ODD, (50, "one two three four five six"), (50, "other words entirely here and there")])
    got = minhash.near_groups(docs).collect()
    assert len(got) == len(ODD) + 2
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert {(r.component_id, r.kept) for r in got if r.doc_id == 5} == {(4, False)}
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3, 8)} == {1, 2, 3, 8}
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 50").count() == 2 and kept.where("doc_id IS NULL").count() == 1
    assert minhash.near_groups(docs.where("false")).count() == 0


def test_min_max_needs_half_the_evaluations_and_estimates_similarity():
    draw = np.random.default_rng(3)
    common, a, b = (np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in (800, 100, 100))
    one, two = minhash.min_max([np.union1d(common, a), np.union1d(common, b)], 256)
    assert len(one) == 512
    assert np.mean(one == two) == pytest.approx(0.8, abs=0.08)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3), (3, None)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = dict(map(tuple, components(frame).collect()))
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 1000 for i in range(1000, 1100)}}
    assert components(frame.where("false")).count() == 0


def test_word_hashes_do_not_depend_on_slices():
    texts = ["a b  c\td", "", "é É b", "a b c d e f", " x "]
    whole = words.Words(pa.array(texts))
    single = [words.Words(pa.array([t])).hash for t in texts]
    assert np.array_equal(whole.hash, np.concatenate(single)) and whole.counts().tolist() == [4, 0, 3, 6, 1]
    sums = whole.sums()
    assert whole.of(sums, whole.first[[0]], 4)[0] == whole.of(sums, whole.first[[3]], 4)[0]


def removed_by_brute_force(rows, window):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out.append((i, len(w), sum(gone), kept))
    return out


def repeat_rows():
    draw = random.Random(11)
    fresh = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 75, 200)]
    rows = []
    for i in range(60):
        text = fresh(draw.randrange(40))
        for _ in range(draw.randrange(3)):
            text += draw.choice(passages)[draw.randrange(3) :] + fresh(draw.randrange(30))
        rows.append((1000 - 7 * i, " ".join(text)))
    return rows


@pytest.mark.parametrize("window", [32, 50])
def test_substrings_equal_brute_force(make_docs, window):
    rows = [r for r in ODD if r[0] not in (None, 5)] + repeat_rows()
    want = removed_by_brute_force(rows, window)
    got = sorted(map(tuple, substrings.remove_repeats(make_docs(rows), window=window, range_bytes=2_000).collect()))
    assert got == want
    digests = sorted(map(tuple, substrings.remove_repeats(make_docs(rows), window=window, digest=True).collect()))
    assert digests == [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want]


def test_substring_odd_rows(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make_docs([*ODD, (60, passage), (60, "x " + passage), (70, passage), (70, passage), (None, passage)])
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()]
    assert len(got) == len(ODD) + 5
    assert got.count((70, 60, 60)) == 2 and (60, 60, 0) in got and (60, 61, 0) in got and (None, 60, 0) in got
    assert (7, 20001, 20000) in got
    assert substrings.remove_repeats(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, window=31)


def test_cover_gives_every_difference():
    found = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert found == set(range(substrings.PERIOD))


def vector_rows():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 16))
    rows = []
    for i in range(500):
        v = centres[i % 12] + draw.normal(size=16) * (0.02 if i % 3 else 0.9)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 4) if i % 50 else None))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0] * 8]
    return rows + [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[1][1], rows[1][2]), (2001, [2 * x for x in rows[1][1]], rows[1][2])]


def test_vector_links_equal_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"id": F.lit(1), "v": F.lit(2), "shard": F.lit(3)})
    good = [(i, np.array(v, np.float64), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for (i, v, l), (j, w, m) in combinations(good, 2):
        if l == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93:
            links.append((i, j))
    root = union_find([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    for shard in (16_384, 40):
        got = sorted(map(tuple, hnsw.linked_vectors(frame, shard_rows=shard).collect()))
        assert got == sorted((i, degree[i], root[i], root[i] == i) for i, _, _ in rows)
    assert hnsw.linked_vectors(frame.where("false")).count() == 0


def clustered(seed=4):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(3000, 32))
    base[1000:1400] = base[1000] + draw.normal(size=(400, 32)) * 0.02
    base[2000:2500] = base[:500] + draw.normal(size=(500, 32)) * 0.05
    return (base / np.linalg.norm(base, axis=1, keepdims=True)).astype(np.float32)


def test_graph_recall_at_size():
    unit, limit = clustered(), np.float32(0.93)
    graph, own = hnsw.Graph(unit), np.arange(len(unit))
    beam = hnsw.audited(graph, unit, own, limit, 1e-5, 256, 512)
    found = sum(len(x) for x in graph.within(unit, limit, beam, own))
    assert found >= 0.999 * int((unit @ unit.T >= 0.93).sum())
    # Vectors that are no members: no self-hits, and they start where any query starts.
    foreign = clustered(5)[:300] * 0.02 + unit[:300]
    foreign /= np.linalg.norm(foreign, axis=1, keepdims=True)
    beam = hnsw.audited(graph, foreign, None, limit, 1e-5, 300, 512)
    truth = foreign @ unit.T >= limit + 1e-5
    assert truth.sum() >= 300 and all(t[f].sum() == t.sum() for t, f in zip(truth, graph.within(foreign, limit - 1e-5, beam), strict=True))


def test_audit_counts_every_query_and_no_self_hit():
    """A graph cut in two parts: the audit fails for the vectors it cannot reach, and the shards are compared whole."""
    unit = clustered()[1000:1400]
    graph = hnsw.Graph(unit)
    for _, links in graph.layers:
        links[:] = -1
    graph.both_ways = graph._both_ways()
    assert hnsw.audited(graph, unit, np.arange(400), np.float32(0.93), 1e-5, 64, 256) is None
    assert hnsw.proposed(graph, None, np.float32(0.93), 1e-5, 64, 256) is None


def test_a_failed_audit_is_compared_whole(spark, monkeypatch):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    want = sorted(map(tuple, hnsw.linked_vectors(frame, shard_rows=60).collect()))
    monkeypatch.setattr(hnsw, "audited", lambda *_: None)
    assert sorted(map(tuple, hnsw.linked_vectors(frame, shard_rows=60).collect())) == want


def test_no_link_is_lost_beside_a_large_clique(spark):
    """Pairs far from a clique keep their links, and so do the clique, repeated rows and pairs between shards."""
    draw = np.random.default_rng(21)
    base = draw.normal(size=(3000, 64)).astype(np.float32)
    base[:2000] = base[0] + draw.normal(size=(2000, 64)).astype(np.float32) * 0.01
    base[2100:2900:2] = base[2101:2901:2] + draw.normal(size=(400, 64)).astype(np.float32) * 0.2
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(2950, base[2950].tolist(), 1)] * 30
    ids, wide = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    one, two = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))
    root = union_find(ids.tolist(), list(zip(ids[one].tolist(), ids[two].tolist(), strict=True)))
    degree = np.bincount(np.concatenate((one, two)), minlength=len(rows))
    want = sorted((i, int(d), root[i], root[i] == i) for i, d in zip(ids.tolist(), degree, strict=True))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for shard in (16_384, 700):
        assert sorted(map(tuple, hnsw.linked_vectors(frame, shard_rows=shard).collect())) == want


def test_a_task_holds_two_shards(spark, monkeypatch):
    """However many vectors a label has, and whatever their length."""
    draw = np.random.default_rng(22)
    rows = [(i, draw.normal(size=16).tolist(), 1) for i in range(1200)] + [(5000, [1.0] * 16, 1)] * 400
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    plain = hnsw.unpacked

    def watched(table, *rest):
        assert table.num_rows == 1
        shard, graph = plain(table, *rest)
        assert len(shard["ids"]) <= 150
        return shard, graph

    monkeypatch.setattr(hnsw, "unpacked", watched)
    got = {r.vec_id: r.n_links for r in hnsw.linked_vectors(frame, shard_rows=100).collect()}
    assert len(got) == 1201 and got[5000] == 399
    assert hnsw.linked_vectors(frame, shard_bytes=100 * 64).count() == len(rows)


def test_rows_that_repeat_an_id_keep_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (3, [1.0, 0.01], 1), (4, [5.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, hnsw.linked_vectors(frame).collect()))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]
