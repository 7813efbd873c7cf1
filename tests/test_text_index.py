import random

import pytest

from tests.test_operators import brute_search
from wardlens.operators import text_index


def topics(seed, n, groups):
    """Chunks in the order of their subject, so that a block has few subjects."""
    draw = random.Random(seed)
    names = [[f"subject{g}word{i}" for i in range(30)] for g in range(groups)]
    common = ["ward", "bed", "nurse"]
    return [(i, " ".join(draw.choice(names[i * groups // n] + common) for _ in range(draw.randrange(1, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id bigint, text string")


def found(index, asked):
    rows = text_index.search(index, asked, "item_id").orderBy("item_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["item_id"], []).append((r["chunk_id"], r["score"]))
    return got


@pytest.fixture(scope="module")
def questions():
    draw = random.Random(3)
    chunks = topics(1, 600, 30)
    said = [(1_000 + i, " ".join(draw.sample(chunks[draw.randrange(600)][1].split() * 3, 3))) for i in range(25)]
    return [*said, (2_000, chunks[7][1]), (2_001, "the of"), (2_002, "ward"), (2_003, None), (2_004, "subject1word1 zzz")]


def test_blocks_segments_and_merging(spark, tmp_path, questions):
    chunks = topics(1, 600, 30)
    asked = spark.createDataFrame(questions, "item_id bigint, text string")
    want = lambda rows: {k: v for k, v in brute_search([(i, t or "") for i, t in questions], rows).items() if v}
    index = text_index.write_text_index(frame(spark, [*chunks[:300], (5_000, None), (5_001, "")]), ["chunk_id"], str(tmp_path), segment="a", block_chunks=16)
    assert found(index, asked) == want(chunks[:300])
    text_index.append_segment(index, frame(spark, chunks[300:500]), "b", block_chunks=16)
    text_index.append_segment(index, frame(spark, chunks[300:]), "b", block_chunks=16)  # the replay has more, and replaces
    assert found(index, asked) == want(chunks)
    assert sorted(r.name for r in index.live().collect()) == ["a", "b"]
    met = [r for r in text_index.blocks_met(index, asked, "item_id").collect() if r.item_id < 2_000]
    assert sum(r.blocks for r in met) > 2 * sum(r.met for r in met), (sum(r.blocks for r in met), sum(r.met for r in met))  # most blocks are skipped
    before = sorted(p.name for p in tmp_path.iterdir())
    text_index.merge_segments(index, block_chunks=16)
    assert [r.name for r in index.live().collect()] == ["merged"]
    assert found(text_index.TextIndex(spark, str(tmp_path), ["chunk_id"]), asked) == want(chunks)
    assert sorted(p.name for p in tmp_path.iterdir()) == before == ["blocks", "bounds", "manifest"]


def test_broken_append_changes_nothing(spark, tmp_path, questions, monkeypatch):
    chunks = topics(1, 60, 3)
    asked = spark.createDataFrame(questions, "item_id bigint, text string")
    index = text_index.write_text_index(frame(spark, chunks), ["chunk_id"], str(tmp_path))
    first = found(index, asked)

    def fails(*_):
        raise OSError("broken off")

    monkeypatch.setattr(text_index, "_commit", fails)
    with pytest.raises(OSError):
        text_index.append_segment(index, frame(spark, topics(2, 60, 3)), "more")
    assert found(index, asked) == first


def test_small_lists_of_questions(spark, tmp_path, questions, monkeypatch):
    monkeypatch.setattr(text_index, "QUESTION_ROWS", 2)
    chunks = topics(4, 200, 2)
    index = text_index.write_text_index(frame(spark, chunks), ["chunk_id"], str(tmp_path), block_chunks=8)
    got = found(index, spark.createDataFrame(questions, "item_id bigint, text string"))
    assert got == {k: v for k, v in brute_search([(i, t or "") for i, t in questions], chunks).items() if v}
    empty = text_index.write_text_index(frame(spark, chunks).where("false"), ["chunk_id"], str(tmp_path / "empty"))
    assert found(empty, spark.createDataFrame(questions, "item_id bigint, text string")) == {}
