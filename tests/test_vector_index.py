import numpy as np
import pytest

from wardlens.operators import vector_index
from wardlens.plans.catalogue import ORACLES, PLANS


def frame(spark, name, matrix, ids=None):
    rows = [(i if ids is None else ids[i], [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<double>")


def brute(queries, vectors, ids, top):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = np.round(unit(queries) @ unit(vectors).T, 6) + 0.0
    out = set()
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], ids[i]))[:top]
        out |= {(q, rank + 1, ids[i], row[i]) for rank, i in enumerate(order)}
    return out


def clustered(draw, n, centres, spread, dims=16):
    middles = draw.normal(size=(centres, dims))
    return middles[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dims))


@pytest.mark.parametrize("kind", ["clustered", "copies", "zeros"])
def test_equals_all_pairs(spark, tmp_path, kind):
    draw = np.random.default_rng(7)
    vectors = clustered(draw, 3_000, 40, 0.05) if kind == "clustered" else draw.normal(size=(600, 16))
    if kind == "copies":
        vectors[:300] = vectors[0]
    if kind == "zeros":
        vectors[::7] = 0
    ids = draw.permutation(len(vectors)).tolist()
    queries = np.concatenate((vectors[:40] + (0.01 if kind == "clustered" else 0.0), draw.normal(size=(5, 16)), np.zeros((1, 16))))
    index = vector_index.write_index(frame(spark, "vec_id", vectors, ids), str(tmp_path / "index"), block_bytes=32 * 16 * 8)
    hits, work = vector_index.indexed_search(index, frame(spark, "query_id", queries), top=5, query_rows=10)
    assert {tuple(r) for r in hits.collect()} == brute(queries, vectors, ids, 5)
    n_blocks = index.blocks.count()
    met = {r.query_id: r.blocks_met for r in work.collect()}
    assert len(met) == len(queries) and max(met.values()) <= n_blocks
    assert index.blocks.selectExpr("sum(n)").first()[0] == len(vectors) and index.blocks.selectExpr("max(n)").first()[0] <= 32
    if kind == "clustered":
        assert np.mean([met[q] for q in range(40)]) * 5 <= n_blocks
    if kind == "copies":  # the smallest ids of the copies are enough
        assert np.mean([met[q] for q in range(40)]) < n_blocks / 2


def test_empty_sides_and_text_ids(spark, tmp_path):
    some = frame(spark, "vec_id", np.eye(4))
    none = vector_index.write_index(some.where("false"), str(tmp_path / "none"))
    assert vector_index.indexed_search(none, some.withColumnRenamed("vec_id", "query_id"))[0].count() == 0
    named = some.selectExpr("concat('v', vec_id) AS vec_id", "embedding")
    index = vector_index.write_index(named, str(tmp_path / "named"), block_bytes=64)
    assert vector_index.indexed_search(index, some.withColumnRenamed("vec_id", "query_id").where("false"))[0].count() == 0
    again = vector_index.open_index(spark, str(tmp_path / "named"))
    hits, _ = vector_index.indexed_search(again, named.withColumnRenamed("vec_id", "query_id"), top=2)
    got = sorted(tuple(r) for r in hits.collect())
    assert got == [(f"v{i}", rank, v, s) for i in range(4) for rank, v, s in ((1, f"v{i}", 1.0), (2, "v1" if i == 0 else "v0", 0.0))]


def test_only_the_best_of_a_group_of_blocks_go_on(spark, tmp_path):
    """Hits were kept per (query, block), and a query travelled once per block."""
    vectors = spark.range(300).selectExpr("id AS vec_id", "transform(array(1, 2, 3, 5), k -> CAST(pmod(xxhash64(id, k), 1000) - 500 AS FLOAT)) AS embedding")
    index = vector_index.write_index(vectors, str(tmp_path / "few"), block_bytes=10 * 4 * 8)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q")
    pairs = asked.select("q").join(index.blocks.select("block", "n"))
    hits = {}
    for packs, groups in ((1, 1), (3, 4)):
        hits[groups] = vector_index._meet(index, asked, pairs, 5, packs, groups).toPandas()
        assert len(hits[groups]) <= 15 * 5 * groups
    best = lambda h: h.sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(5).values.tolist()
    assert best(hits[1]) == best(hits[4]) and index.blocks.count() > 20


def test_every_vector_is_asked(spark):
    """The query once asked only with the ids divisible by 100."""

    class Own:
        embeddings = frame(spark, "vec_id", np.random.default_rng(3).normal(size=(30, 4)), range(1, 31)).selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding")

    hits = PLANS["vector_search_indexed"](Own).collect()
    assert sorted({r.query_id for r in hits}) == list(range(1, 31)) and len(hits) == 30 * 5
    assert "%" not in ORACLES["vector_search_indexed"]
