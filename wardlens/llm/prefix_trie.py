"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged above them.

Turns become 128-bit digests in the order of their conversation; running sums of digests salted by depth name every prefix,
in blocks, so a conversation of any length is spread. Counts per node are plain aggregates. Sums over subtrees come from
shards: a node is in a shard when at most ``shard_turns`` turns of members lie below it, and a task encodes the subtrees of
its shard as balanced parentheses with blocks of least excess: findclose delimits a subtree, ranks count its leaf pairs,
cumulative arrays give its savings. Nodes with more turns below them form the spine; it gets one weighted leaf pair per
node for the shards that hang there and is encoded the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalars import scalar
from wardlens.llm.digests import group_digest
from wardlens.llm.mixing import word_count
from wardlens.session import ship_by_value, stored

ship_by_value(__name__)

#: Turns below a node of a shard, shared nodes that a task takes together, depths summed in one window.
SHARD_TURNS, TASK_NODES, DEPTH_BLOCK = 200_000, 100_000, 1_024
#: Parentheses per block of least excess.
EXCESS_BLOCK = 128
ROOT = hashlib.md5(b"0,0,0,0,0").digest()


class Parentheses:
    """A tree in balanced parentheses, with least excess per block in a binary tree over the blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        n = len(opens)
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-n // EXCESS_BLOCK)
        padded = np.full(blocks * EXCESS_BLOCK, 1 << 40)
        padded[:n] = self.excess
        self.width = 1 << max(blocks - 1, 0).bit_length()
        self.least = np.full(2 * self.width, 1 << 40)
        self.least[self.width : self.width + blocks] = padded.reshape(blocks, EXCESS_BLOCK).min(axis=1)
        for i in range(self.width - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])
        #: Leaf pairs that begin before a place.
        pair = np.zeros(n, np.int64)
        pair[:-1] = opens[:-1] & ~opens[1:]
        self.leaf_places = np.flatnonzero(pair)

    def find_close(self, i: int) -> int:
        """The place of the parenthesis that closes the one opened at i: the next with an excess one lower."""
        target = self.excess[i] - 1
        end = (i // EXCESS_BLOCK + 1) * EXCESS_BLOCK
        here = np.flatnonzero(self.excess[i + 1 : end] <= target)
        if len(here):
            return i + 1 + int(here[0])
        node = self.width + i // EXCESS_BLOCK
        while node & 1 or self.least[node + 1] > target:  # up, until a right neighbour goes low enough
            node >>= 1
        node += 1
        while node < self.width:
            node *= 2
            if self.least[node] > target:
                node += 1
        start = (node - self.width) * EXCESS_BLOCK
        return start + int(np.flatnonzero(self.excess[start : start + EXCESS_BLOCK] <= target)[0])


def subtree_sums(parents: np.ndarray, own: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and savings of the subtree of every node of a forest.

    ``parents`` are positions (-1: a root), ``own`` the savings of the nodes themselves; a node with ``leaves`` has one more
    leaf pair below it that counts so many leaves and ``saved``. A node without children or such a pair is a leaf.
    """
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    roots = []
    for i, parent in enumerate(parents.tolist()):
        (children[parent] if parent >= 0 else roots).append(i)
    opened = np.zeros(n, np.int64)
    hanging = leaves.tolist()
    opens: list[bool] = []
    weights: list[tuple[int, int, int]] = []  # place, leaves, savings
    own_list, saved_list = own.tolist(), saved.tolist()
    stack = roots[::-1]
    while stack:
        i = stack.pop()
        if i < 0:
            opens.append(False)
            continue
        opened[i] = len(opens)
        weights.append((len(opens), 0 if children[i] or hanging[i] else 1, own_list[i]))
        opens.append(True)
        if hanging[i]:
            weights.append((len(opens), hanging[i], saved_list[i]))
            opens += (True, False)
        stack.append(-1)
        stack.extend(children[i])
    tree = Parentheses(np.array(opens, bool))
    place, count, saving = np.array(weights, np.int64).T
    # Only pairs count as leaves: a rank over the leaf places, weighted by what hangs there.
    order = np.zeros(len(opens), np.int64)
    order[place] = count
    ranks = np.concatenate(([0], np.cumsum(order[tree.leaf_places])))
    savings = np.zeros(len(opens) + 1, np.int64)
    np.add.at(savings, place + 1, saving)
    savings = np.cumsum(savings)
    closed = np.fromiter((tree.find_close(i) for i in opened.tolist()), np.int64, n)
    first, last = np.searchsorted(tree.leaf_places, opened), np.searchsorted(tree.leaf_places, closed)
    return ranks[last] - ranks[first], savings[closed + 1] - savings[opened]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, size, d1..d4, words`` from ``conv_id, turn, role, text``: places from 1, turns as 128-bit digests.

    Rows without a conversation are left out; null roles and texts are empty. Equal turns are ordered by role, then text.
    Rows are dealt by ranges of that order and numbered inside their task; a small table of counts per conversation and task
    puts the numbers together.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    ranged = rows.repartitionByRange("conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64))
    ordered = ranged.sortWithinPartitions("conv", "turn", "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    place = F.monotonically_increasing_id()
    kept = stored(ordered.select("conv", F.unhex(digest).alias("digest"), word_count(F.col("text")).cast("long").alias("words"), place.alias("place")), "trie-turns")
    kept = kept.withColumn("part", F.shiftright("place", 33))
    spans = kept.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "conv", "part", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv")).alias("size")
    )
    return kept.join(spans, ["conv", "part"]).select("conv", (F.col("place") - F.col("first") + F.col("before") + 1).alias("pos"), "size", "digest", "words")


def rebuild(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: ``conv, depth, digest, words`` and ``conv, total``.

    The first h turns of conversation c are replaced by the first h of c - c % every (fewer if it has fewer), h being the
    checksum of c modulo ``most``. The remainder has the sign of c, as in SQL.
    """
    turns = stored(ordered_turns(conversations), "trie-places")
    sizes = turns.where("pos = 1").select("conv", "size")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    lengths = sizes.select("conv", "size", h, (F.col("conv") - F.col("conv") % every).alias("base")).join(
        sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left"
    )
    head = F.least(F.col("h"), F.coalesce("base_size", F.lit(0)))
    lengths = lengths.select("conv", "base", "h", head.alias("head"), (head + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("total"))
    lengths = stored(lengths, "trie-lengths")
    # A long conversation's own turns meet one row; the join deals them by conversation and adaptive execution splits them.
    own = turns.join(lengths, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "digest", "words")
    bases = turns.where(F.col("conv") % every == 0).where(F.col("pos") < most)
    heads = lengths.where("head > 0").select("conv", "base", "head").join(bases.withColumnRenamed("conv", "base"), "base").where("pos <= head")
    return own.unionByName(heads.select("conv", F.col("pos").alias("depth"), "digest", "words")), lengths.select("conv", "total")


def prefix_paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv, depth, total, key, parent, words``: the name of each prefix and of the one before it.

    A prefix is named by the sums, in four parts of 32 bits, of the digests of its turns salted by their depth. Sums run
    inside blocks of depths; block totals are summed apart and added.
    """
    salted = F.md5(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("digest")))
    parts = [F.conv(F.substring("salted", 8 * i + 1, 8), 16, 10).cast("long").alias(f"s{i}") for i in range(4)]
    names = [f"s{i}" for i in range(4)]
    block = F.floor((F.col("depth") - 1) / DEPTH_BLOCK).cast("long")
    salted_turns = turns.withColumn("salted", salted).select("conv", "depth", "words", block.alias("block"), *parts)
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted_turns.groupBy("conv", "block").agg(*[F.sum(s).alias(s) for s in names])
    offsets = totals.select("conv", "block", *[F.sum(s).over(earlier).alias(f"{s}_before") for s in names]).where("block > 0")
    summed = salted_turns.select("*", *[F.sum(s).over(inside).alias(f"{s}_upto") for s in names]).join(offsets, ["conv", "block"], "left")
    through = [F.col(f"{s}_upto") + F.coalesce(f"{s}_before", F.lit(0)) for s in names]
    name = lambda depth, sums: F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))
    key = name(F.col("depth"), through).alias("key")
    parent = name(F.col("depth") - 1, [t - F.col(s) for t, s in zip(through, names, strict=True)]).alias("parent")
    return summed.join(lengths, "conv").select("conv", "depth", "total", key, parent, "words")


def _sums_of(rows: DataFrame, group) -> DataFrame:
    """``key, n_leaves, saved_tokens`` of nodes ``key, parent, own, hanging, hanging_saved``, one forest per group."""

    def encode(table: pa.Table) -> pa.Table:
        keys, parents = table.column("key").to_pylist(), table.column("parent").to_pylist()
        at = {k: i for i, k in enumerate(keys)}
        places = np.fromiter((at.get(p, -1) for p in parents), np.int64, len(keys))
        own, leaves, saved = (table.column(c).to_numpy() for c in ("own", "hanging", "hanging_saved"))
        n_leaves, savings = subtree_sums(places, own, leaves, saved)
        return pa.table([pa.array(keys, pa.binary()), pa.array(n_leaves, pa.int64()), pa.array(savings, pa.int64())], ["key", "n_leaves", "saved_tokens"])

    return rows.groupBy(group).applyInArrow(lambda table: encode(table), "key binary, n_leaves bigint, saved_tokens bigint")


def trie(turns: DataFrame, lengths: DataFrame, shard_turns: int = SHARD_TURNS, task_nodes: int = TASK_NODES) -> DataFrame:
    """Per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` (``conv, depth, digest, words``) and ``lengths`` (``conv, total``) as ``rebuild`` gives them. The root stands
    for all conversations, turnless ones too; without any conversation there is no row.
    """
    paths = stored(prefix_paths(turns, lengths), "trie-paths")
    below = (F.col("total") - F.col("depth") + 1).alias("below")
    nodes = paths.groupBy("key").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
        F.max("words").alias("words"), F.sum(below).alias("size"),
    )
    nodes = stored(nodes, "trie-nodes")
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("children"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
    own = (F.col("n") - 1) * F.col("words")
    shared = nodes.where("n > 1").join(kids, "key", "left").select("key", "conv", "parent", "size", own.alias("own"), F.coalesce("single", F.lit(0)).alias("single"))
    shared = stored(shared, "trie-shared")

    # The spine: nodes with too many turns below. A shard begins where the path of its owner leaves the spine.
    spine = shared.where(F.col("size") > shard_turns)
    left_at = paths.join(spine.select("key"), "key", "left_semi").groupBy("conv").agg((F.max("depth") + 1).alias("leaves_spine"))
    owners = shared.where(F.col("size") <= shard_turns).select("conv").distinct()
    starts = owners.join(left_at, "conv", "left").select("conv", F.coalesce("leaves_spine", F.lit(1)).alias("depth"))
    shards = paths.join(starts, ["conv", "depth"]).select("conv", F.col("key").alias("shard_key"))
    n_shards = F.greatest(F.ceil(scalar(shared, F.count(F.lit(1))) / F.lit(task_nodes)), F.lit(1))
    in_shards = (
        shared.where(F.col("size") <= shard_turns)
        .join(shards, "conv")
        .select("key", "parent", "own", F.col("single").alias("hanging"), F.lit(0).cast("long").alias("hanging_saved"), F.pmod(F.xxhash64("shard_key"), n_shards).alias("shard"))
    )
    sharded = stored(_sums_of(in_shards, "shard"), "trie-shards")
    hung = (
        shared.where(F.col("size") <= shard_turns)
        .select("key", "parent")
        .join(sharded, "key")
        .groupBy(F.col("parent").alias("key"))
        .agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("hanging_saved"))
    )
    on_spine = spine.join(hung, "key", "left").select(
        "key", "parent", "own", (F.col("single") + F.coalesce("more", F.lit(0))).alias("hanging"), F.coalesce("hanging_saved", F.lit(0)).alias("hanging_saved"), F.lit(0).alias("shard")
    )
    sums = sharded.unionByName(_sums_of(on_spine, "shard"))

    # All nodes with the sums of the shared ones; below a single conversation there is one leaf and nothing saved.
    full = (
        nodes.join(sums, "key", "left")
        .join(kids, "key", "left")
        .select("key", "parent", "conv", "depth", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    )
    full = stored(full, "trie-full")
    root = lengths.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0")
    first = F.col("depth") == 1
    top = full.agg(F.count(F.when(first, 1)).alias("children"), F.sum(F.when(first, F.col("n_leaves"))).alias("n_leaves"), F.sum(F.when(first, F.col("saved_tokens"))).alias("saved_tokens"))
    top = top.select(F.struct("children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")).alias("t"))
    root = root.select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "conv", F.lit(0).cast("long").alias("depth"), "n",
        *[scalar(top, F.first("t")).getField(c).alias(c) for c in ("children", "n_leaves", "saved_tokens")],
    )
    named = root.unionByName(full)
    parents = named.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    ends = paths.where("depth = total").select("key", "conv").unionByName(lengths.where("total = 0").select(F.lit(ROOT).alias("key"), "conv"))
    ends = group_digest(ends.withColumn("decimal", F.col("conv").cast("string").cast("binary")), "key", "conv", "decimal", b",")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        named.join(parents, "parent", "left")
        .join(ends, "key", "left")
        .select(
            F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").cast("long").alias("n_children"),
            F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations; ``conversations`` has ``conv_id, turn, role, text``, other columns are not read.

    Rows without a conversation are left out, null roles and texts are empty, null turns come first, equal turns are ordered
    by role and text, repeated rows are turns of their own. Texts are read whole; prefixes are told apart by 128-bit digests.
    An empty table gives no rows.
    """
    return trie(*rebuild(conversations))
