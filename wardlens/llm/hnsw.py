"""Near-duplicate vectors: navigable small-world graphs per shard, walked by every shard of the same label.

A shard is a bounded part of one label. One task builds and stores the graph of a shard. A second task holds two shards:
the vectors of either walk through the graph of the other, and beams widen until an audit finds every link of every
audited vector. Where the widest beam fails its audit, the two shards are compared whole. Links are verified in double
precision where rounding leaves them open. A task returns counts and the least id that its links reach from each vector,
so a clique of n vectors costs n rows, not n squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from wardlens.llm.components import components
from wardlens.session import ship_by_value, stored

ship_by_value(__name__)


class Graph:
    """A layered graph over unit vectors; searches advance many queries together, one expansion at a time."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 64, seed: int = 1, layers: list | None = None):
        """Built from the vectors, or restored with the ``layers`` of a graph built before."""
        self.vectors, self.degree, self.beam = vectors, degree, beam
        if layers is not None:
            self.layers = layers
            self.both_ways = self._both_ways()
            return
        n = len(vectors)
        levels = (-np.log(np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int) if n else np.zeros(0, int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(int(levels.max(initial=0)) + 1):
            members = np.flatnonzero(levels >= level)
            self.layers.append((members, np.full((len(members), 2 * degree if level == 0 else degree), -1, np.int32)))
        for members, links in self.layers:
            self._build(members, links)
        self.both_ways = self._both_ways()

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the lowest layer in either direction: where a member's begin, and the members they lead to."""
        links = self.layers[0][1]
        a, b = np.repeat(np.arange(len(links)), links.shape[1]), links.ravel()
        a, b = a[b >= 0], b[b >= 0].astype(np.int64)
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(len(links) + 1)), b[order]

    def _build(self, members: np.ndarray, links: np.ndarray) -> None:
        """Insert the members of one layer in doubling batches, each linked to what is there and then back."""
        vectors, width = self.vectors[members], links.shape[1]
        done = min(len(members), width + 1)
        if done > 1:
            near = vectors[:done] @ vectors[:done].T
            np.fill_diagonal(near, -np.inf)
            links[:done, : done - 1] = np.argsort(-near, axis=1)[:, : done - 1]
        while done < len(members):
            more = np.arange(done, min(len(members), 2 * done, done + 512))
            found, score = search(vectors, links, vectors[more], self._entries(done, len(more)), self.beam)
            # Vectors of one batch do not find each other in the graph, so they are compared directly.
            inside = vectors[more] @ vectors[more].T
            np.fill_diagonal(inside, -np.inf)
            take = min(width, len(more) - 1)
            beside = np.argpartition(-inside, take - 1, axis=1)[:, :take] if take else np.zeros((len(more), 0), int)
            found = np.concatenate((found, more[beside]), axis=1)
            score = np.concatenate((score, np.take_along_axis(inside, beside, 1)), axis=1)
            self._join(vectors, links, more, found, score)
            done = int(more[-1]) + 1

    def _entries(self, n: int, queries: int) -> np.ndarray:
        return np.tile(np.linspace(0, n - 1, min(n, 4)).astype(np.int32), (queries, 1))

    def _join(self, vectors, links, rows, found, score) -> None:
        width = links.shape[1]
        changed: dict[int, list[int]] = {}
        for i, row in enumerate(rows.tolist()):
            chosen = diverse(vectors, found[i], score[i], width // 2)
            links[row, : len(chosen)] = chosen
            for c in chosen:
                changed.setdefault(c, []).append(row)
        for node, new in changed.items():
            held = links[node][links[node] >= 0]
            both = np.unique(np.concatenate((held, np.array(new, np.int32))))
            if len(both) > width:
                both = diverse(vectors, both, vectors[both] @ vectors[node], width)
            links[node] = -1
            links[node, : len(both)] = both

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Down the layers with a narrow beam: where the search of the lowest layer starts."""
        entry = None
        for members, links in self.layers[:0:-1]:
            start = self._entries(len(members), len(queries)) if entry is None else np.searchsorted(members, entry).astype(np.int32)
            found, _ = search(self.vectors[members], links, queries, start, 4)
            entry = members[np.maximum(found, 0)]
        return self._entries(len(self.layers[0][0]), len(queries)) if entry is None else entry.astype(np.int32)

    def within(self, queries: np.ndarray, threshold: float, beam: int, own: np.ndarray | None = None) -> list[np.ndarray]:
        """Members whose similarity reaches the threshold.

        A beam search finds the first of them; then the beam is widened for as long as it stays above the threshold, by
        following links both ways from members that reach it, and from ``own``, the queries' places where they are members.
        A clique costs its links, not a beam of its size per query.
        """
        found, score = search(self.vectors, self.layers[0][1], queries, self.entries(queries), min(beam, len(self.vectors)))
        hit = (score >= threshold) & (found >= 0)
        if own is not None:
            found = np.concatenate((found, own[:, None].astype(found.dtype)), axis=1)
            hit = np.concatenate((hit, np.ones((len(own), 1), bool)), axis=1)
        out: list[np.ndarray] = []
        for at in range(0, len(queries), 64):
            out += self._spread(queries[at : at + 64], found[at : at + 64], hit[at : at + 64], threshold)
        return out

    def _spread(self, queries, found, hit, threshold) -> list[np.ndarray]:
        n, (first, other) = len(self.vectors), self.both_ways
        inside, visited = np.zeros(len(queries) * n, bool), np.zeros(len(queries) * n, bool)
        front = (np.nonzero(hit)[0] * n + found[hit]).astype(np.int64)
        visited[front] = inside[front] = True
        while len(front):
            reached = np.zeros(len(queries) * n, bool)
            for at in range(0, len(front), 20_000):
                q, node = np.divmod(front[at : at + 20_000], n)
                size = first[node + 1] - first[node]
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                reached[np.repeat(q, size) * n + other[np.repeat(first[node], size) + step]] = True
            new = np.flatnonzero(reached & ~visited)
            visited[new] = True
            near = np.zeros(len(new), np.float32)
            for at in range(0, len(new), 50_000):
                q, node = np.divmod(new[at : at + 50_000], n)
                near[at : at + 50_000] = np.einsum("ij,ij->i", queries[q], self.vectors[node])
            front = new[near >= threshold]
            inside[front] = True
        return [np.flatnonzero(row) for row in inside.reshape(len(queries), n)]


def diverse(vectors: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> list[int]:
    """Neighbours in order of similarity, passing over one that is closer to a chosen neighbour; gaps are filled in order."""
    order = np.argsort(-score, kind="stable")
    order = order[(found[order] >= 0) & np.isfinite(score[order])][: 4 * most]
    ids, near = found[order], score[order]
    among = vectors[ids] @ vectors[ids].T
    chosen, passed = [], []
    for i in range(len(ids)):
        if len(chosen) == most:
            break
        (chosen if not chosen or among[i, chosen].max() < near[i] else passed).append(i)
    return ids[(chosen + passed)[:most]].tolist()


def search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` members per query that a greedy walk finds (-1 where fewer), with similarities, best first."""
    rows, n, out = len(queries), len(vectors), []
    step = max(1, 8_000_000 // max(n, 1))  # a visited table of bounded size
    for at in range(0, rows, step):
        out.append(_search(vectors, links, queries[at : at + step], entry[at : at + step], beam))
    if not out:
        return np.zeros((0, beam), np.int32), np.zeros((0, beam), np.float32)
    return np.concatenate([f for f, _ in out]), np.concatenate([s for _, s in out])


def _search(vectors, links, queries, entry, beam):
    rows = len(queries)
    here = np.arange(rows)
    visited = np.zeros((rows, len(vectors) + 1), bool)  # the last column takes the empty links
    ids = np.full((rows, beam), -1, np.int32)
    score = np.full((rows, beam), -np.inf, np.float32)
    open_ = np.zeros((rows, beam), bool)

    def merge(at, new):
        nonlocal ids, score, open_
        seen = np.take_along_axis(visited[at], new, 1) | (new < 0)
        near = np.einsum("qkd,qd->qk", vectors[new], queries[at]).astype(np.float32)
        near[seen] = -np.inf
        visited[at[:, None], new] = True
        all_ids, all_score = np.concatenate((ids[at], new), 1), np.concatenate((score[at], near), 1)
        all_open = np.concatenate((open_[at], ~seen), 1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam] if all_ids.shape[1] > beam else np.argsort(-all_score, 1)
        ids[at], score[at], open_[at] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_score, all_open))

    entry = np.sort(entry, axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    merge(here, entry)
    while True:
        waiting = np.where(open_ & np.isfinite(score), score, -np.inf)
        best = waiting.argmax(1)
        alive = np.flatnonzero(np.isfinite(waiting[here, best]))
        if not len(alive):
            break
        chosen = best[alive]
        open_[alive, chosen] = False
        merge(alive, links[ids[alive, chosen]])
    order = np.argsort(-score, 1, kind="stable")
    return np.where(np.isfinite(np.take_along_axis(score, order, 1)), np.take_along_axis(ids, order, 1), -1), np.take_along_axis(score, order, 1)


def audited(graph: Graph, queries: np.ndarray, own: np.ndarray | None, threshold: float, slack: float, audit: int, widest: int) -> int | None:
    """The narrowest beam, doubling from the graph's own, that finds every link of every audited query; None beyond ``widest``.

    Audited are ``audit`` evenly spaced queries, each compared with all members. A query's own place does not count.
    """
    rows = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    truth = queries[rows] @ graph.vectors.T >= threshold + slack
    if own is not None:
        truth[np.arange(len(rows)), own[rows]] = False
    some = truth.any(axis=1)
    rows, truth = rows[some], truth[some]
    beam = graph.beam
    while len(rows):
        found = graph.within(queries[rows], threshold - slack, beam, None if own is None else own[rows])
        if all(t[f].sum() == t.sum() for t, f in zip(truth, found, strict=True)):
            break
        beam *= 2
        if beam > widest:
            return None
    return beam


def reached(graph: Graph, queries: np.ndarray, own: np.ndarray | None, threshold: float, beam: int) -> np.ndarray:
    """One bit per query and member: the members that the walk of each query proposes."""
    bits = np.zeros((len(queries), (len(graph.vectors) + 7) // 8), np.uint8)
    for at in range(0, len(queries), 2048):
        found = graph.within(queries[at : at + 2048], threshold, beam, None if own is None else own[at : at + 2048])
        for i, members in enumerate(found, at):
            row = np.zeros(len(graph.vectors), bool)
            row[members] = True
            bits[i] = np.packbits(row)
    return bits


def proposed(one: Graph, two: Graph | None, threshold: float, slack: float, audit: int, widest: int):
    """Blocks of (rows of ``one``, proposed members of ``two`` for them), or None where an audit fails.

    A pair is proposed if the walk of either of its vectors finds the other. Without ``two`` the graph is asked by itself.
    """
    n, m = len(one.vectors), len((two or one).vectors)
    if two is None:
        own = np.arange(n)
        beam = audited(one, one.vectors, own, threshold, slack, audit, widest)
        if beam is None:
            return None
        there = back = reached(one, one.vectors, own, threshold - slack, beam)
    else:
        beams = audited(two, one.vectors, None, threshold, slack, audit, widest), audited(one, two.vectors, None, threshold, slack, audit, widest)
        if None in beams:
            return None
        there, back = reached(two, one.vectors, None, threshold - slack, beams[0]), reached(one, two.vectors, None, threshold - slack, beams[1])

    def blocks():
        for at in range(0, n, 256):
            part = np.arange(at, min(n, at + 256))
            hit = np.unpackbits(there[part], axis=1, count=m).astype(bool)
            hit |= np.unpackbits(back[:, at // 8 : (part[-1] >> 3) + 1], axis=1, count=len(part)).astype(bool).T
            yield part, hit

    return blocks()


def whole(one: np.ndarray, two: np.ndarray, threshold: float, slack: float):
    """Blocks as ``proposed`` gives them, from the products of all pairs."""
    for at in range(0, len(one), 256):
        part = np.arange(at, min(len(one), at + 256))
        yield part, one[part] @ two.T >= threshold - slack


def confirmed(base: np.ndarray, queries: np.ndarray, q: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of a query and a member have a cosine in double precision that reaches the threshold."""
    keep = np.zeros(len(q), bool)
    for at in range(0, len(q), 50_000):
        a, b = queries[q[at : at + 50_000]].astype(np.float64), base[m[at : at + 50_000]].astype(np.float64)
        cosine = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        keep[at : at + 50_000] = cosine >= threshold
    return keep


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each node when the links (a, b) are added to those already in ``root``."""
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return root
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in an order of their own, and the place of each row among them."""
    raw = np.ascontiguousarray(rows + np.float32(0)).view(np.dtype((np.void, rows.shape[1] * 4))).ravel()  # -0.0 becomes 0.0
    _, first, same = np.unique(raw, return_index=True, return_inverse=True)
    return rows[first], same


def unit_rows(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def near_pairs(unit_a: np.ndarray, unit_b: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    near = np.zeros(len(q), np.float32)
    for at in range(0, len(q), 50_000):
        near[at : at + 50_000] = np.einsum("ij,ij->i", unit_a[q[at : at + 50_000]], unit_b[m[at : at + 50_000]])
    return near


def counted(blocks, one: dict, two: dict | None, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each distinct vector of either shard, and the number of its component.

    ``times`` says how many rows a distinct vector stands for. Single precision decides but for the pairs that its
    rounding leaves open.
    """
    other = two or one
    n, m_first = len(one["single"]), 0 if two is None else len(one["single"])
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(other["single"]), np.int64)
    root = np.arange(n + (0 if two is None else len(other["single"])))
    for part, hit in blocks:
        if two is None:
            hit[np.arange(len(part)), part] = True
        q, m = np.nonzero(hit)
        near = near_pairs(one["unit"], other["unit"], part[q], m)
        keep = near >= threshold + slack
        open_ = np.flatnonzero((near >= threshold - slack) & ~keep)
        keep[open_] = confirmed(other["single"], one["single"], part[q[open_]], m[open_], threshold)
        q, m = part[q[keep]], m[keep]
        links_a += np.bincount(q, other["times"][m], n).astype(np.int64)
        if two is not None:
            links_b += np.bincount(m, one["times"][q], len(links_b)).astype(np.int64)
        root = merged(root, q, m_first + m)
    if two is None:
        itself = np.arange(n)
        links_a -= confirmed(one["single"], one["single"], itself, itself, threshold)
    return links_a, links_b, root


def packed(table: pa.Table, key: tuple, degree: int, beam: int) -> pa.Table:
    """One row: a shard's ids, row keys, distinct vectors and how often each occurs, and the layers of its graph."""
    ids = table.column("id").to_numpy()
    rows = np.array(table.column("v").combine_chunks().flatten(), np.float32).reshape(len(ids), -1)
    single, same = distinct(rows)
    times = np.bincount(same, table.column("n").to_numpy(), len(single)).astype(np.int64)
    layers = Graph(unit_rows(single), degree, beam).layers
    parts = {"ids": ids.astype(np.int64), "keys": table.column("key").to_numpy().astype(np.int64), "same": same.astype(np.int32), "single": single, "times": times}
    fields = {name: pa.array([x.tobytes()], pa.binary()) for name, x in parts.items()}
    for name, i, kind in (("members", 0, np.int32), ("links", 1, np.int32)):
        fields[name] = pa.array([[layer[i].astype(kind).tobytes() for layer in layers]], pa.list_(pa.binary()))
    place = {c: pa.array([k.as_py()], k.type) for c, k in zip(("label", "dim", "shard", "shards"), key, strict=True)}
    return pa.table({**place, **fields})


def unpacked(table: pa.Table, dim: int, degree: int, beam: int) -> tuple[dict, Graph]:
    row = {c: table.column(c)[0] for c in ("ids", "keys", "same", "single", "times", "members", "links")}
    kinds = {"ids": np.int64, "keys": np.int64, "same": np.int32, "single": np.float32, "times": np.int64}
    shard = {c: np.frombuffer(row[c].as_buffer(), kind) for c, kind in kinds.items()}
    shard["single"] = shard["single"].reshape(-1, dim)
    shard["unit"] = unit_rows(shard["single"])
    layers = []
    for members, links in zip(row["members"], row["links"], strict=True):
        nodes = np.frombuffer(members.as_buffer(), np.int32).astype(np.int64)
        layers.append((nodes, np.frombuffer(links.as_buffer(), np.int32).reshape(len(nodes), -1)))
    return shard, Graph(shard["unit"], degree, beam, layers=layers)


def usable(embedding: str) -> str:
    return f"size({embedding}) > 0 AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({embedding}, x -> x <> 0)"


def linked_vectors(
    vectors: DataFrame, threshold: float = 0.93, shard_rows: int = 16_384, shard_bytes: int = 4 << 20, degree: int = 16, beam: int = 64,
    widest: int = 512, audit: int = 512, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``.

    Two vectors are linked when their labels are equal and not null and their cosine in double precision is at least
    ``threshold``. ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id reachable.
    No pair below the threshold is linked. A link is missed only if neither of its vectors finds the other by a walk
    whose beam passed the audit: ``audit`` vectors of either shard, each of which must find all its links.

    * A vector that is null, empty, zero, or holds a null or non-finite component, and one with a null label, links with
      nothing. Vectors of different lengths are not compared.
    * Rows that repeat an id are one vector each with the links of its own; rows of one id share a component. A row without
      an id takes no part; its component is null and it is kept.
    * A label is cut into shards of about ``shard_rows`` vectors and ``shard_bytes`` by a hash of id and vector, so a label
      with a third of all rows has more shards, not larger ones. Each pair of shards meets in one task, which holds these two
      with their graphs and nothing else of the label. Rows equal in label, id and vector are one row with a count.
    * Other columns are not read. An empty table gives an empty result.
    """
    key = F.xxhash64("label", "v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("v"), F.col(label_column).alias("label"))
    good = rows.where(f"id IS NOT NULL AND label IS NOT NULL AND {usable('v')}")
    good = good.groupBy("label", "id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v"))
    most = F.greatest(F.least(F.lit(shard_rows), F.floor(F.lit(shard_bytes) / (4 * F.col("dim")))), F.lit(1))
    shards = good.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("shards"))
    number = F.pmod(F.xxhash64("id", "v"), F.col("shards").cast("long")).cast("int")
    # Few rows, one per label and length; adaptive execution broadcasts them when they are small.
    placed = good.join(shards, ["label", "dim"]).withColumns({"shard": number, "key": key})
    place = ["label", "dim", "shard", "shards"]
    binary = [StructField(c, BinaryType()) for c in ("ids", "keys", "same", "single", "times")] + [StructField(c, ArrayType(BinaryType())) for c in ("members", "links")]
    kinds = StructType([placed.schema[c] for c in place] + binary)

    def build(at, table):
        return packed(table, at, degree, beam)

    graphs = stored(placed.groupBy(*place).applyInArrow(build, kinds), "vector-graphs")
    # Shard s is the first of the pairs (s, s) to (s, last) and the second of (0, s) to (s - 1, s).
    first = graphs.withColumns({"one": F.col("shard"), "two": F.explode(F.sequence(F.col("shard"), F.col("shards") - 1))})
    second = graphs.where("shard > 0").withColumns({"one": F.explode(F.sequence(F.lit(0), F.col("shard") - 1)), "two": F.col("shard")})
    out = StructType([StructField(c, LongType()) for c in ("id", "key", "links", "other")])

    def run(at, left, right):
        dim, itself = at[1].as_py(), at[2] == at[3]
        if not left.num_rows or (not itself and not right.num_rows):  # one of the two shards got no vector
            return pa.table({c: pa.array([], pa.int64()) for c in out.names})
        slack = 1e-6 + (dim + 4) * 2.0**-23
        one, graph = unpacked(left, dim, degree, beam)
        two, across = (None, None) if itself else unpacked(right, dim, degree, beam)
        blocks = proposed(graph, across, threshold, slack, audit, widest)
        if blocks is None:
            blocks = whole(one["unit"], (two or one)["unit"], threshold, slack)
        links_a, links_b, root = counted(blocks, one, two, threshold, slack)
        parts = [(one, links_a, 0)] + ([] if itself else [(two, links_b, len(links_a))])
        ids = np.concatenate([shard["ids"] for shard, _, _ in parts])
        places = np.concatenate([root[offset + shard["same"]] for shard, _, offset in parts])
        links = np.concatenate([found[shard["same"]] for shard, found, _ in parts])
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, places, ids)
        keys = np.concatenate([shard["keys"] for shard, _, _ in parts])
        some = links > 0
        return pa.table({"id": ids[some], "key": keys[some], "links": links[some], "other": least[places][some]})

    pair = ["label", "dim", "one", "two"]
    answers = stored(first.groupBy(*pair).cogroup(second.groupBy(*pair)).applyInArrow(run, out), "vector-links")
    counts = answers.groupBy("id", "key").agg(F.sum("links").alias("n_links"))
    joined = components(answers, "id", "other").toDF("id", "component")
    return (
        rows.select("id", key.alias("key"))
        .join(counts, ["id", "key"], "left")
        .join(joined, "id", "left")
        .select(
            F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
            (F.col("id").isNull() | (F.col("id") == F.coalesce("component", "id"))).alias("kept"),
        )
    )
