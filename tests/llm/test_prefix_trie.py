import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlens.llm import digests, prefix_trie
from wardlens.llm.queries import QUERIES


def rebuilt(rows):
    original = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            original.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in original.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def expected(rows):
    """All nodes by walking every prefix of every rebuilt conversation."""
    paths = rebuilt(rows)
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + (len(convs) - 1) * words
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return made.withColumns({c: F.lit(1) for c in ("conv", "key", "depth", "digest", "words", "place", "part", "n", "total", "parent")})


def many(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(400), n):
        for turn in range(draw.randrange(1, 7)):
            rows.append((c, turn if draw.random() < 0.95 else None, draw.choice(("user", "assistant", None)), draw.choice(("yes yes", "no", None, "", "a b c"))))
    return rows


ODD = [
    *many(1, 150),
    *[(1_000 + i, t, "user", f"same {t} words") for i in range(300) for t in range(3)],
    *[(2_000 + i, t, "user", f"deep {t}") for i in range(3) for t in range(400)],
    (None, 1, "user", "nobody"), (3_000, None, None, None), (3_001, 1, "user", "x" * 200_000), (-7, 1, "user", "minus"), (-7, 1, "user", "minus"),
]


@pytest.mark.parametrize("shard_turns,task_nodes,block,pack", [(200_000, 100_000, 1_024, 1_000_000), (30, 20, 64, 40), (1, 1, 7, 5)])
def test_trie_equals_walk_over_prefixes(spark, monkeypatch, shard_turns, task_nodes, block, pack):
    monkeypatch.setattr(prefix_trie, "DEPTH_BLOCK", block)
    monkeypatch.setattr(digests, "PACK_BYTES", pack)
    got = prefix_trie.trie(*prefix_trie.rebuild(frame(spark, ODD)), shard_turns=shard_turns, task_nodes=task_nodes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected(ODD)


def test_turnless_conversations_and_empty_table(spark):
    # Conversations of one turn lose it where the conversation they borrow from is absent.
    rows = [(c, 1, "user", "alone") for c in range(21, 40)]
    assert any(not t for t in rebuilt(rows).values())
    assert sorted([tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()], key=repr) == expected(rows)
    none = [r for r in rows if not rebuilt(rows)[r[0]]]
    assert [tuple(r) for r in prefix_trie.prefix_trie(frame(spark, none)).collect()] == expected(none)
    assert prefix_trie.prefix_trie(frame(spark, rows).where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 600), st.integers(0, 10**6))
def test_parentheses(n, seed):
    draw = random.Random(seed)
    near = draw.choice((1, 3, 600))
    parents = np.array([-1] + [draw.randrange(max(0, i - near), i) if draw.random() < 0.95 else -1 for i in range(1, n)], np.int64)
    own = np.array([draw.randrange(5) for _ in range(n)], np.int64)
    hanging = np.array([draw.choice((0, 0, 1, 7)) for _ in range(n)], np.int64)
    more = np.where(hanging > 0, 3, 0)
    leaves = np.where(np.isin(np.arange(n), parents) | (hanging > 0), 0, 1) + hanging
    saved = own + more
    for i in range(n - 1, 0, -1):  # a parent comes before its children
        if parents[i] >= 0:
            leaves[parents[i]] += leaves[i]
            saved[parents[i]] += saved[i]
    got = prefix_trie.subtree_sums(parents, own, hanging, more)
    assert (got[0] == leaves).all() and (got[1] == saved).all()


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted([tuple(r) for r in QUERIES["op12_conversation_trie"](spark, folder).collect()], key=repr) == expected(rows)
