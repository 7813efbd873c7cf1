"""Forests grown by tasks and kept as tables, for models whose trees grow with their rows.

Spark's own forest lives on the driver: noisy labels let a deep tree grow with the rows, and every pass sends the statistics of a
level there. Here a task grows a whole tree, its nodes go into a table in the shared folder, and the driver holds neither rows nor nodes.
The rules are those of Spark's forest: Poisson bootstraps, a random subset of the places of the vector at each node, at most 32 bins
of a number, one place per category, Gini impurity or variance, leaves joined where both say the same class, the mean of the
leaves' shares or values.

Rows become cells: the bins and codes of all columns as one key (several where one number does not hold them). Equal cells are
counted, and a bootstrap draws the number of times that a counted row is taken (the sum of n Poisson draws is one draw with mean n),
so trees see each cell once. Nothing needs cells to repeat. A task that has more than ``ROWS_AT_ONCE`` cells keeps them in files
and splits the largest nodes by reading these in pieces, until a node's cells fit; each other node is grown in memory, level by level.
"""

from __future__ import annotations

import math
import os
import tempfile
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.session import ship_by_value, stored

ship_by_value(__name__)

#: Bins of a number; cells that a task draws or grows in memory at once; nodes of a level looked at together; cells of a packed row.
BINS, ROWS_AT_ONCE, NODES_AT_ONCE, PACK = 32, 500_000, 16_384, 100_000
#: Training rows per task that draws bootstraps, cells that meet a group of trees in one task, bytes of the nodes of that group.
ROWS_A_DRAW, CELLS_A_TASK, GROUP_BYTES = 250_000, 1_000_000, 64_000_000
#: Gains and impurities up to this share of the numbers they come from are rounding.
TINY = 1e-12


@dataclass(frozen=True)
class Axes:
    """What a key means: limits of each number's bins, kinds of each category (with one for those never seen)."""

    limits: list[list[float]]
    kinds: list[int]

    @property
    def sizes(self) -> list[int]:
        return [len(x) + 1 for x in self.limits] + self.kinds

    @property
    def places(self) -> int:
        """Places of the vector: one per number, one per category."""
        return len(self.limits) + sum(self.kinds)

    @property
    def keys(self) -> list[list[int]]:
        """Columns that share a number of 63 bits."""
        groups, held = [[]], 1
        for c, size in enumerate(self.sizes):
            if held * size >= 2**62:
                groups, held = [*groups, []], 1
            groups[-1].append(c)
            held *= size
        return groups

    def columns(self, numeric: list[str], categorical: list[str]) -> list[Column]:
        """The keys of a row that the preprocessing has filled and indexed."""
        codes = []
        for c, limits in zip(numeric, self.limits, strict=True):
            code = F
            for i, limit in enumerate(limits):
                code = code.when(F.col(f"{c}_filled") <= limit, F.lit(i).cast("bigint"))
            # NaN is above all limits.
            most = F.lit(len(limits)).cast("bigint")
            codes.append(code.otherwise(most) if limits else most)
        codes += [F.col(f"{c}_index").cast("bigint") for c in categorical]
        found = []
        for k, group in enumerate(self.keys):
            value = F.lit(0).cast("bigint")
            for c in group:
                value = value * self.sizes[c] + codes[c]
            found.append(value.alias(f"key{k}_"))
        return found

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """The code of each column, from keys as columns of an array."""
        sizes = self.sizes
        out = np.empty((len(keys), len(sizes)), np.uint16 if max(sizes, default=0) < 2**16 else np.int32)
        for k, group in enumerate(self.keys):
            left = keys[:, k].copy()
            for c in reversed(group):
                left, out[:, c] = np.divmod(left, sizes[c])
        return out


@dataclass(frozen=True)
class Rules:
    """How a forest grows. ``classes`` is 0 for a number; ``subset`` is the number of places looked at per node."""

    trees: int
    depth: int
    leaf: int
    classes: int
    subset: int
    seed: int

    @property
    def width(self) -> int:
        """Statistics of a node: the weight of each class, or rows, sum and sum of squares."""
        return self.classes or 3

    def impurity(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.classes:
                weight = stats.sum(-1)
                share = stats / weight[..., None]
                return weight, 1 - (share * share).sum(-1)
            weight = stats[..., 0]
            mean = stats[..., 1] / weight
            return weight, np.maximum(stats[..., 2] / weight - mean * mean, 0)

    def gain(self, side: np.ndarray, total: np.ndarray, weight: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What a split gains, given one of its sides; -inf where a side has too few rows."""
        other = total - side
        (w1, i1), (w2, i2) = self.impurity(side), self.impurity(other)
        with np.errstate(divide="ignore", invalid="ignore"):
            gained = before - (w1 * i1 + w2 * i2) / weight
        least = np.full_like(weight, 0 if self.classes else self.leaf - 0.5)
        least = np.maximum(least, 1e-12 * weight)
        return np.where((w1 > least) & (w2 > least), gained, -np.inf)

    def splits(self, stats: np.ndarray, weight: np.ndarray, impurity: np.ndarray) -> np.ndarray:
        """Nodes that are worth a look."""
        scale = 1.0 if self.classes else np.maximum(stats[..., 2] / np.maximum(weight, 1), 0)
        return (impurity > TINY * 10 * scale) & (weight > 0)

    def values(self, stats: np.ndarray) -> np.ndarray:
        """Shares of the classes, or the mean."""
        if self.classes:
            return stats / stats.sum(-1, keepdims=True)
        return stats[..., 1:2] / stats[..., :1]


def chosen_places(rng, nodes: int, places: int, subset: int) -> np.ndarray:
    """A table of nodes by places that marks ``subset`` different places of each node."""
    if subset >= places:
        return np.ones((nodes, places), bool)
    marks, every = np.zeros((nodes, places), bool), np.arange(nodes)
    for _ in range(subset):
        left = every
        while len(left):
            place = rng.integers(0, places, len(left))
            again = marks[left, place]
            marks[left[~again], place[~again]] = True
            left = left[again]
    return marks


def counted(key: np.ndarray, stats: np.ndarray, size: int) -> np.ndarray:
    """Sums of the statistics by key."""
    return np.stack([np.bincount(key, stats[:, j], minlength=size) for j in range(stats.shape[1])], axis=1)


@dataclass
class Nodes:
    """The nodes of one tree: ``column`` is -1 in a leaf; its children are ``low`` and ``low + 1``."""

    column: list = field(default_factory=list)
    code: list = field(default_factory=list)
    low: list = field(default_factory=list)
    value: list = field(default_factory=list)
    ids: list = field(default_factory=list)
    count: int = 1

    def add(self, ids, column, code, low, value) -> None:
        self.ids.append(ids)
        self.column.append(column.astype(np.int16))
        self.code.append(code.astype(np.int32))
        self.low.append(low.astype(np.int32))
        self.value.append(value)

    def arrays(self) -> tuple[np.ndarray, ...]:
        order = np.argsort(np.concatenate(self.ids), kind="stable")
        return pruned(*(np.concatenate(x)[order] for x in (self.column, self.code, self.low, self.value)))


def pruned(column: np.ndarray, code: np.ndarray, low: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """As Spark does, a node becomes a leaf where both its children are leaves that say the same, from the lowest nodes up."""
    says = value.argmax(1) if value.shape[1] > 1 else value[:, 0]
    inner = np.flatnonzero(low >= 0)
    while len(inner):
        a, b = low[inner], low[inner] + 1
        merged = (low[a] < 0) & (low[b] < 0) & (says[a] == says[b])
        if not merged.any():
            break
        column[inner[merged]] = low[inner[merged]] = -1
        inner = inner[~merged]
    kept, level = np.zeros(len(low), bool), np.array([0])
    while len(level):
        kept[level] = True
        first = low[level][low[level] >= 0]
        level = np.concatenate((first, first + 1))
    number = np.cumsum(kept) - 1
    low = np.where(low >= 0, number[np.maximum(low, 0)], -1).astype(np.int32)
    return column[kept], code[kept], low[kept], value[kept]


class Grower:
    """Grows one tree from cells and their statistics."""

    def __init__(self, axes: Axes, rules: Rules, tree: int):
        self.axes, self.rules = axes, rules
        self.rng = np.random.default_rng([rules.seed, tree, 1])
        self.nodes = Nodes()
        numbers = len(axes.limits)
        self.numbers = [(c, size) for c, size in enumerate(axes.sizes[:numbers])]
        starts = numbers + np.concatenate(([0], np.cumsum(axes.kinds))).astype(int)
        self.categories = [(numbers + g, int(starts[g]), kinds) for g, kinds in enumerate(axes.kinds)]
        self.is_number = np.arange(len(axes.sizes)) < numbers

    def goes_high(self, codes: np.ndarray, column: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Rows of a node's second child: above the bin, or of the category."""
        at = codes[np.arange(len(codes)), column]
        return np.where(self.is_number[column], at > code, at == code)

    def best(self, codes, stats, sizes, total, weight, impurity):
        """The best split of each node whose rows come one after another: column, code (column -1: none)."""
        rules, nodes = self.rules, len(sizes)
        chosen = chosen_places(self.rng, nodes, self.axes.places, rules.subset)
        slot = np.repeat(np.arange(nodes), sizes)
        best = TINY * (np.ones(nodes) if rules.classes else impurity)
        column, code = np.full(nodes, -1), np.zeros(nodes, np.int64)

        def better(at, gained, c, value):
            won = gained > best[at]
            best[at[won]], column[at[won]], code[at[won]] = gained[won], c, value[won]

        for c, bins in self.numbers:
            asked = np.flatnonzero(chosen[:, c])
            if bins < 2 or not len(asked):
                continue
            mine = chosen[slot, c]
            place = np.cumsum(chosen[:, c]) - 1
            table = counted(place[slot[mine]] * bins + codes[mine, c], stats[mine], len(asked) * bins).reshape(len(asked), bins, -1)
            side = table.cumsum(1)[:, :-1]
            gained = rules.gain(side, total[asked, None], weight[asked, None], impurity[asked, None])
            value = gained.argmax(1)
            better(asked, gained[np.arange(len(asked)), value], c, value)
        for c, start, kinds in self.categories:
            at = codes[:, c].astype(np.int64)
            mine = chosen[slot, start + at]
            key, of = slot[mine] * kinds + at[mine], stats[mine]
            if not len(key):
                continue
            if nodes * kinds <= max(4 * len(key), 65_536):
                side = counted(key, of, nodes * kinds).reshape(nodes, kinds, -1)
                gained = rules.gain(side, total[:, None], weight[:, None], impurity[:, None])
                value = gained.argmax(1)
                better(np.arange(nodes), gained[np.arange(nodes), value], c, value)
            else:
                unique, place = np.unique(key, return_inverse=True)
                node = unique // kinds
                gained = rules.gain(counted(place, of, len(unique)), total[node], weight[node], impurity[node])
                first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                top = np.lexsort((-gained, node))[first]
                better(node[top], gained[top], c, unique[top] % kinds)
        return column, code

    def in_memory(self, root: int, depth: int, codes: np.ndarray, stats: np.ndarray) -> None:
        """Everything below one node, a level at a time; rows stay in the order of their nodes."""
        rules = self.rules
        ids, sizes = np.array([root]), np.array([len(codes)])
        while len(ids):
            total = np.add.reduceat(stats, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
            weight, impurity = rules.impurity(total)
            looked = rules.splits(total, weight, impurity) & (depth < rules.depth)
            column, code = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
            at = np.flatnonzero(looked)
            if len(at) < len(ids):
                held = np.repeat(looked, sizes)
                codes, stats = codes[held], stats[held]
            rows = np.concatenate(([0], np.cumsum(sizes[at])))
            for a in range(0, len(at), NODES_AT_ONCE):
                some = at[a : a + NODES_AT_ONCE]
                of = slice(rows[a], rows[min(a + NODES_AT_ONCE, len(at))])
                column[some], code[some] = self.best(codes[of], stats[of], sizes[some], total[some], weight[some], impurity[some])
            parts = column >= 0
            low = np.full(len(ids), -1)
            low[parts] = self.nodes.count + 2 * np.arange(parts.sum())
            self.nodes.count += 2 * int(parts.sum())
            self.nodes.add(ids, column, code, low, rules.values(total))
            if not parts.any():
                return
            held = np.repeat(parts[at], sizes[at])
            if not held.all():
                codes, stats = codes[held], stats[held]
            each = sizes[parts]
            slot = np.repeat(np.arange(len(each)), each)
            high = self.goes_high(codes, column[parts][slot], code[parts][slot])
            highs = np.bincount(slot, high, len(each)).astype(np.int64)
            order = np.argsort(2 * slot + high, kind="stable")
            codes, stats = codes[order], stats[order]
            sizes = np.stack((each - highs, highs), axis=1).ravel()
            ids = np.stack((low[parts], low[parts] + 1), axis=1).ravel()
            depth += 1

    def grow(self, rows: Rows) -> tuple[np.ndarray, ...]:
        """The tree of all rows. Nodes with too many rows for memory are split by reading them in pieces."""
        rules, waiting = self.rules, [(0, 0, rows)]
        while waiting:
            node, depth, rows = waiting.pop()
            if rows.n <= ROWS_AT_ONCE:
                self.in_memory(node, depth, *rows.all())
                continue
            total = sum(stats.sum(0) for _, stats in rows.pieces())[None]
            weight, impurity = rules.impurity(total)
            column = code = np.array([-1])
            if rules.splits(total, weight, impurity)[0] and depth < rules.depth:
                column, code = self.best_of_one(rows, total, weight, impurity)
            low = -1
            if column[0] >= 0:
                low, self.nodes.count = self.nodes.count, self.nodes.count + 2
                parts = rows.parted(lambda codes, c=column, v=code: self.goes_high(codes, np.repeat(c, len(codes)), v[0]))
                # The part with fewer rows is done first: of the parts that wait, only the last may be in memory.
                waiting += sorted(((low + i, depth + 1, part) for i, part in enumerate(parts)), key=lambda w: -w[2].n)
            self.nodes.add(np.array([node]), column, code, np.array([low]), rules.values(total))
            rows.drop()
        return self.nodes.arrays()

    def best_of_one(self, rows: Rows, total, weight, impurity):
        """``best`` for one node whose rows come in pieces."""
        rules, chosen = self.rules, chosen_places(self.rng, 1, self.axes.places, self.rules.subset)[0]
        columns = [(c, bins) for c, bins in self.numbers if chosen[c] and bins > 1] + [(c, kinds) for c, start, kinds in self.categories if chosen[start : start + kinds].any()]
        tables = {c: np.zeros((size, rules.width)) for c, size in columns}
        for codes, stats in rows.pieces():
            for c, size in columns:
                tables[c] += counted(codes[:, c].astype(np.int64), stats, size)
        best, column, code = TINY * (1.0 if rules.classes else impurity[0]), -1, 0
        starts = {c: start for c, start, _ in self.categories}
        for c, size in columns:
            side = tables[c].cumsum(0)[:-1] if self.is_number[c] else tables[c]
            gained = rules.gain(side, total, weight, impurity)
            if c in starts:
                gained = np.where(chosen[starts[c] : starts[c] + size], gained, -np.inf)
            top = int(gained.argmax())
            if gained[top] > best:
                best, column, code = gained[top], c, top
        return np.array([column]), np.array([code])


class Rows:
    """Cells of one node, in memory or in two files of a folder that the task removes when it ends."""

    def __init__(self, folder: str, columns: int, width: int, kind):
        self.folder, self.columns, self.width, self.kind, self.n, self.held, self.path = folder, columns, width, np.dtype(kind), 0, [], None

    def add(self, codes: np.ndarray, stats: np.ndarray) -> None:
        self.held.append((codes.astype(self.kind, copy=False), stats))
        self.n += len(codes)
        if self.path or self.n > ROWS_AT_ONCE:
            self.path = self.path or tempfile.mkstemp(dir=self.folder)[1]
            with open(self.path, "ab") as a, open(f"{self.path}-stats", "ab") as b:
                for codes, stats in self.held:
                    a.write(np.ascontiguousarray(codes).data)
                    b.write(np.ascontiguousarray(stats, "float64").data)
            self.held = []

    def pieces(self):
        if not self.path:
            yield from self.held
            return
        with open(self.path, "rb") as a, open(f"{self.path}-stats", "rb") as b:
            while len(codes := np.fromfile(a, self.kind, PACK * self.columns)):
                yield codes.reshape(-1, self.columns), np.fromfile(b, "float64", PACK * self.width).reshape(-1, self.width)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        found = [*self.pieces()] or [(np.zeros((0, self.columns), self.kind), np.zeros((0, self.width)))]
        self.drop()
        return np.concatenate([c for c, _ in found]), np.concatenate([s for _, s in found])

    def parted(self, high) -> tuple[Rows, Rows]:
        parts = tuple(Rows(self.folder, self.columns, self.width, self.kind) for _ in range(2))
        for codes, stats in self.pieces():
            up = high(codes)
            for part, mine in zip(parts, (~up, up), strict=True):
                part.add(codes[mine], stats[mine])
        return parts

    def drop(self) -> None:
        self.held = []
        if self.path:
            os.unlink(self.path)
            os.unlink(f"{self.path}-stats")
            self.path = None


def limits_of(rows: DataFrame, numeric: list[str]) -> list[list[float]]:
    """Limits of each number's bins: between all values where these are few, else at evenly spaced ranks."""
    if not numeric:
        return []
    names = [f"{c}_filled" for c in numeric]
    kinds = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    # Few values are listed whole; the error of the count is far below the room left.
    few = [c for c in names if kinds[c] <= 2 * BINS]
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(
        *[F.percentile_approx(c, shares, 10_000).alias(c) for c in names],
        *[F.max(F.nanvl(c, F.lit(None).cast("double"))).alias(f"most_{c}") for c in names],
        *[F.collect_set(c).alias(f"all_{c}") for c in few],
    ).first()
    limits = []
    for c in names:
        values = sorted(x for x in found[f"all_{c}"] if x == x) if c in few else []
        if c in few and len(values) <= BINS:
            limits.append([(a + b) / 2 if math.isfinite(a + b) else a for a, b in zip(values, values[1:], strict=False)])
        else:
            limits.append([x for x in dict.fromkeys(found[c] or []) if x < found[f"most_{c}"]])
    return limits


def drawn(axes: Axes, rules: Rules, n_keys: int):
    """The task that draws bootstraps: cells with counts in, packed cells with statistics per tree out."""
    width, seed = rules.width, rules.seed

    def flush(held, part, piece):
        keys, label, weight, n = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        of = np.arange(len(label)), label.astype(np.int64) if rules.classes else None
        once = n.max() == 1
        for tree in range(rules.trees):
            rng = np.random.default_rng([seed, tree, 0, part, piece])
            taken = (rng.poisson(1.0, len(n)) if once else rng.poisson(n)).astype(np.float64)
            stats = np.zeros((len(n), width))
            if rules.classes:
                stats[of] = taken * weight
            else:
                stats[:, 0], stats[:, 1], stats[:, 2] = taken, taken * label, taken * label * label
            stats = np.add.reduceat(stats, first, axis=0)
            some = stats[:, 0] > 0 if not rules.classes else stats.any(1)
            if some.any():
                yield [tree, part << 32 | piece, int(some.sum()), keys[first[some]].tobytes(), stats[some].T.tobytes()]

    def draw(batches):
        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

        def out(rows):
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["tree", "at", "n", "cells", "stats"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append((np.stack(columns[:n_keys], axis=1), *columns[n_keys:]))
            size += batch.num_rows
            if size >= ROWS_A_DRAW:
                yield from out(flush(held, part, piece))
                piece, held, size = piece + 1, [], 0
        if held:
            yield from out(flush(held, part, piece))

    return draw


def grown(axes: Axes, rules: Rules, n_keys: int):
    """The task that grows trees: packed cells of its trees in, packed nodes out."""
    kind = np.uint16 if max(axes.sizes) < 2**16 else np.int32

    def grow(batches):
        with tempfile.TemporaryDirectory() as folder:
            places = {}
            for batch in batches:
                for tree, at, n, cells, stats in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), batch.column(4), strict=True):
                    # Packs wait in one file per tree and are read in their order, however they arrive.
                    with open(f"{folder}/tree-{tree}", "ab") as file:
                        places.setdefault(tree, []).append((at, file.tell(), n))
                        file.write(cells.as_buffer())
                        file.write(stats.as_buffer())
            for tree in sorted(places):
                rows = Rows(folder, len(axes.sizes), rules.width, kind)
                with open(f"{folder}/tree-{tree}", "rb") as file:
                    for _, start, n in sorted(places[tree]):
                        file.seek(start)
                        keys = np.fromfile(file, np.int64, n * n_keys).reshape(n, n_keys)
                        rows.add(axes.codes(keys), np.ascontiguousarray(np.fromfile(file, np.float64, n * rules.width).reshape(rules.width, n).T))
                os.unlink(f"{folder}/tree-{tree}")
                column, code, low, value = Grower(axes, rules, tree).grow(rows)
                for a in range(0, len(column), 500_000):
                    some = slice(a, a + 500_000)
                    packs = [column[some].tobytes(), code[some].tobytes(), low[some].tobytes(), value[some].tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree], pa.int32()), pa.array([a], pa.int32()), pa.array([len(column[some])], pa.int32()), *[pa.array([x], pa.binary()) for x in packs]],
                        ["tree", "start", "n", "column", "code", "low", "value"],
                    )

    return grow


def voted(axes: Axes, width: int, n_keys: int):
    """The task in which packed cells meet a group of trees: the sum of what its trees say of each cell."""

    def vote(key, cells, nodes):
        group = key[1].as_py()
        names = [f"key{k}_" for k in range(n_keys)]
        keys = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, n_keys) for x in cells.column("cells")]
        if not keys:
            keys = [np.zeros((0, n_keys), np.int64)]
        keys = np.concatenate(keys)
        codes, said = axes.codes(keys), np.zeros((len(keys), width))
        is_number = np.arange(len(axes.sizes)) < len(axes.limits)
        packs = {}
        for i, (tree, start) in enumerate(zip(nodes.column("tree").to_pylist(), nodes.column("start").to_pylist(), strict=True)):
            packs.setdefault(tree, []).append((start, i))
        kinds = {"column": np.int16, "code": np.int32, "low": np.int32, "value": np.float64}
        for tree in sorted(packs):
            column, code, low, value = (
                np.concatenate([np.frombuffer(nodes.column(c)[i].as_buffer(), t) for _, i in sorted(packs[tree])]) for c, t in kinds.items()
            )
            value = value.reshape(-1, width)
            at, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
            while len(left):
                left = left[column[at[left]] >= 0]
                here = at[left]
                c, own = column[here], code[here]
                x = codes[left, c]
                at[left] = low[here] + np.where(is_number[c], x > own, x == own)
            said += value[at]
        votes = pa.ListArray.from_arrays(pa.array(np.arange(0, said.size + 1, width, dtype=np.int32)), pa.array(said.ravel()))
        return pa.table([*[pa.array(keys[:, k]) for k in range(n_keys)], pa.array(np.full(len(keys), group, np.int32)), votes], [*names, "group_", "votes"])

    return vote


def packed(n_keys: int):
    """The task that packs keys, ``PACK`` to a row."""

    def pack(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            keys = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([keys.tobytes()], pa.binary())], ["at", "n", "cells"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:n_keys]], axis=1))
                size += batch.num_rows
            if size >= PACK:
                yield row()
                seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    return pack


def fit(rows: DataFrame, numeric: list[str], categorical: list[str], kinds: list[int], rules: Rules, label: str, weight: str | None = None) -> GrownForest:
    """A forest over rows that the preprocessing has filled and indexed; ``kinds`` counts the places of each category.

    Labels and weights must not be null, as in Spark's forests.
    """
    axes = Axes(limits_of(rows, numeric), kinds)
    if rules.subset == 0:
        rules = Rules(rules.trees, rules.depth, rules.leaf, rules.classes, max(math.ceil(math.sqrt(axes.places)), 1) if rules.trees > 1 else axes.places, rules.seed)
    keys = [f"key{k}_" for k in range(len(axes.keys))]

    def required(name):
        value = F.col(name).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{name} must not be null or NaN")).cast("double")).otherwise(value)

    coded = rows.select(*axes.columns(numeric, categorical), required(label).alias("y_"), (required(weight) if weight else F.lit(1.0)).alias("w_"))
    cells = coded.groupBy(*keys, "y_", "w_").agg(F.count(F.lit(1)).alias("n_"))
    cells = stored(cells, "cells")
    n = cells.count()
    if not n:
        raise ValueError("no rows to grow a forest from")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_A_DRAW))
    dealt = cells.repartition(parts, *keys).sortWithinPartitions(*keys, "y_", "w_").select(*keys, "y_", "w_", "n_")
    drawn_cells = dealt.mapInArrow(drawn(axes, rules, len(keys)), "tree int, at bigint, n int, cells binary, stats binary")
    nodes = drawn_cells.repartitionById(rules.trees, "tree").mapInArrow(
        grown(axes, rules, len(keys)), "tree int, start int, n int, column binary, code binary, low binary, value binary"
    )
    return GrownForest(stored(nodes, "nodes"), axes, rules, numeric, categorical)


class GrownForest(Model, MLWritable, MLReadable):
    """A forest as a table of packed nodes. ``transform`` stores the different cells of its rows and votes on each once."""

    def __init__(self, nodes: DataFrame | None = None, axes: Axes | None = None, rules: Rules | None = None, numeric=(), categorical=()):
        super().__init__()
        self.nodes, self.axes, self.rules, self.numeric, self.categorical = nodes, axes, rules, list(numeric), list(categorical)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        axes, rules = self.axes, self.rules
        columns, keys = axes.columns(self.numeric, self.categorical), [f"key{k}_" for k in range(len(axes.keys))]
        width = rules.classes or 1
        cells = dataset.select(*columns).distinct().mapInArrow(packed(len(keys)), "at bigint, n int, cells binary")
        cells = stored(cells, "cells")
        n = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # A tree whose bootstrap is empty has no nodes.
        nodes, trees = self.nodes.agg(F.sum("n"), F.count_distinct("tree")).first()
        tree_bytes = nodes * (10 + 8 * width) / trees
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        buckets = max(math.ceil(n / CELLS_A_TASK), 1)
        per = max(1, min(int(GROUP_BYTES / tree_bytes), math.ceil(rules.trees / cores)))
        groups = math.ceil(rules.trees / per)
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = cells.select(F.pmod(F.xxhash64("at"), F.lit(buckets)).cast("int").alias("bucket"), "cells", all_of(groups).alias("group_"))
        right = self.nodes.withColumn("group_", F.floor(F.col("tree") / per).cast("int")).withColumn("bucket", all_of(buckets))
        schema = ", ".join([*[f"{k} bigint" for k in keys], "group_ int", "votes array<double>"])
        said = left.groupBy("bucket", "group_").cogroup(right.groupBy("bucket", "group_")).applyInArrow(voted(axes, width, len(keys)), schema)
        # Votes are added in the order of the groups, so that equal sums stay equal.
        in_order = F.sort_array(F.collect_list(F.struct("group_", "votes")))
        zero = F.array(*[F.lit(0.0)] * width)
        total = F.aggregate(in_order, zero, lambda sums, part: F.zip_with(sums, part.getField("votes"), lambda a, b: a + b))
        sums = said.groupBy(*keys).agg(total.alias("votes_"))
        votes = F.col("votes_")
        guess = (F.array_position(votes, F.array_max(votes)) - 1).cast("double") if rules.classes else votes[0] / trees
        guesses = sums.select(*keys, guess.alias("prediction"))
        return dataset.withColumns({k: c for k, c in zip(keys, columns, strict=True)}).join(guesses, keys, "left").select(*dataset.columns, "prediction")

    def copy(self, extra=None) -> GrownForest:
        return GrownForest(self.nodes, self.axes, self.rules, self.numeric, self.categorical)

    def write(self) -> MLWriter:
        return GrownForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return GrownForestReader()


class GrownForestWriter(MLWriter):
    def __init__(self, forest: GrownForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        forest = self.forest
        more = {"limits": forest.axes.limits, "kinds": forest.axes.kinds, "rules": vars(forest.rules), "numeric": forest.numeric, "categorical": forest.categorical}
        DefaultParamsWriter.saveMetadata(forest, path, self.sparkSession, extraMetadata=more)
        forest.nodes.write.parquet(f"{path}/nodes")


class GrownForestReader(MLReader):
    def load(self, path: str) -> GrownForest:
        more = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.parquet(f"{path}/nodes")
        forest = GrownForest(nodes, Axes(more["limits"], more["kinds"]), Rules(**more["rules"]), more["numeric"], more["categorical"])
        forest._resetUid(more["uid"])
        return forest
