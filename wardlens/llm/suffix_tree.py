"""Scoring texts with a probabilistic suffix tree over words.

A state is the end of what has been read: up to ``depth`` words, nothing at the
root. It is tested if it occurs often enough, and kept when its next-word
distribution differs from that of the state one word shorter by more than its
size explains. A token is scored in the longest state kept; words that a state
has not seen often enough fall back to shorter ones.

The tree is a Spark table of word sequences ("grams") by hash and grows with
the corpus; thresholds are counts, so what a corpus keeps it also keeps inside a
larger one, as far as the larger one does not speak against it. Each level is
one pass over the texts: a sequence is counted only if both its shorter ends
were frequent. Scores are sums of one term per gram, so that the grams of a
text meet their terms in one cogroup. Two things of fixed size spare most of the
shuffling and change no result: the most frequent words (those with a share of
the corpus, so at most 1 / share) and grams (at most 1 / share per size) are
looked up in arrays, and a bitmap of hashes keeps grams that are in no table at
home.

Grams travel in packs, one row per range of the hash and some millions of
tokens: sorted keys as steps, their bytes laid out by place and compressed, as
those of small steps and counts are mostly zeros. Ranges grow in number with the corpus,
so a task holds one of bounded size.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.samples import id_crc
from wardlens.llm.words import Words, mixed, text_slices
from wardlens.session import ship_by_value, stored

ship_by_value(__name__)

#: The token after the last word of a text.
END = mixed(np.array([0x5851F42D4C957F2D], np.uint64))[0]
#: Distinct entries a task gathers before it sends them.
GATHERED = 2_000_000
#: Tokens whose grams a task gathers before it packs them, and so of a block of texts that asks for terms together.
PACKED = 2_000_000
#: Texts of a block, and tokens of the corpus per range of the hash: for counting, which holds a range, and for asking, pack by pack.
BLOCK_TEXTS, PART_TOKENS, ASK_TOKENS = 200_000, 4_000_000, 12_000_000
#: Bits of the bitmaps of hashes: 8 MB for a table of any size, 1 MB for the frequent grams.
FILTER_BITS, OFTEN_BITS = 1 << 26, 1 << 23
#: Factors of a gram's hash.
BEFORE, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RARE = np.uint64(1 << 63)
#: Spark's setting that shuffles end with the query that made them, and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_alone(frame: DataFrame, label: str) -> DataFrame:
    """A stored table whose shuffles are gone once it is written; no later step reads them."""
    conf = frame.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return stored(frame, label)
    finally:
        conf.set(CLEANUP, before)


class Tokens:
    """The words of a slice of texts with one end per text: hashes, the text of each token, its place, and the texts' sizes."""

    def __init__(self, part: pa.RecordBatch):
        words = Words(part.column("text"), lower=True)
        counts = words.counts()
        self.first = words.first + np.arange(len(words.first))
        self.text = np.repeat(np.arange(len(counts)), counts + 1)
        self.hash = np.full(len(self.text), END, np.uint64)
        self.hash[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words.hash
        self.counts = counts + 1
        self.place = np.arange(len(self.text)) - np.repeat(self.first[:-1], self.counts)
        self.own = words.texts()
        self.train = ~part.column("held_out").to_numpy(zero_copy_only=False)


class Counts:
    """Sums per key with the columns that go with the key, folded when many have gathered."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, kept: list[np.ndarray], weights: list[np.ndarray]) -> None:
        names, first, at = np.unique(keys, return_index=True, return_inverse=True)
        self.parts.append((names, [k[first] for k in kept], [np.bincount(at, w, len(names)).astype(np.int64) for w in weights]))
        self.size += len(names)

    def fold(self) -> int:
        if len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            joined = lambda columns: [np.concatenate(c) for c in zip(*columns, strict=True)]
            self.add(np.concatenate([p[0] for p in parts]), joined(p[1] for p in parts), joined(p[2] for p in parts))
        return self.size


def counted(rows: DataFrame, entries, kept: list[str], sums: list[str]) -> DataFrame:
    """``kept`` and sums of ``sums`` over what ``entries`` (part -> keys, kept columns, weights) finds; folded in tasks first."""

    def run(batches):
        held = Counts()

        def out():
            _, names, totals = held.parts[0]
            held.parts, held.size = [], 0
            for at in range(0, len(totals[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000].view(np.int64)) for c in (*names, *totals)], [*kept, *sums])

        for batch in batches:
            for part in text_slices(batch, "text"):
                held.add(*entries(part))
                if held.size >= GATHERED and held.fold() >= GATHERED // 2:
                    yield from out()
        if held.fold():
            yield from out()

    found = rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in (*kept, *sums)))
    return found.groupBy(*kept).agg(*[F.sum(c).alias(c) for c in sums])


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def per_text(text: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of weights per text; doubles for no weights, too."""
    return np.bincount(text, weights, n).astype(np.float64)


def codes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A frequent word's place among them; a rarer word's hash with the highest bit set."""
    at = lookup(words, hashes)
    return np.where(at >= 0, at.astype(np.uint64), hashes | RARE)


def gram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a gram from the key of all its words but the last and the code of the last."""
    return mixed(mixed(before * BEFORE + LAST) + word * LAST)


def longer(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of the grams that end at each token from those one word shorter; of no meaning before a text's n-th token."""
    out = np.zeros_like(keys)
    out[1:] = gram(keys[:-1], word[1:])
    return out


def planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit values by place, all first bytes, then all second ones, compressed; before them their number."""
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unplaned(data: bytes, kind=np.uint64) -> np.ndarray:
    size = 8 * int.from_bytes(data[:8], "little")
    plain = pa.decompress(memoryview(data)[8:], decompressed_size=size, codec="zstd")
    return np.frombuffer(plain, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def steps(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def stepped(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range that a key is in; ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def turned(keys: np.ndarray) -> np.ndarray:
    """Keys with the highest bit last, as it is set in all codes of rarer words."""
    return (keys << np.uint64(1)) | (keys >> np.uint64(63))


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    return np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, [c[1:] != c[:-1] for c in columns]))))


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key may be in the bitmap; never false for one that is."""
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(table: DataFrame) -> np.ndarray:
    """One bit per remainder of the column ``key``: 8 MB whatever the table's size."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    blocks = table.select(F.shiftright(bit, 15).alias("block"), bit.bitwiseAND(F.lit(32767)).alias("bit"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[row.block * 4096 : row.block * 4096 + 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def count_grams(rows: DataFrame, words: np.ndarray, below: DataFrame, size: int, least: int, parts: int) -> DataFrame:
    """``prefix, word, n`` of the grams of ``size`` words that training texts hold at least ``least`` times.

    Such a gram's first and last ``size - 1`` words are as frequent, so they are in ``below``.
    """
    shared = rows.sparkSession.sparkContext.broadcast((words, bitmap(below)))

    def found(part):
        names, bits = shared.value
        tokens = Tokens(part)
        word = codes(names, tokens.hash)
        keys = word
        for _ in range(size - 2):
            keys = longer(keys, word)
        # A gram of size - 1 words may end here; one of size words may if it starts in the same text.
        known = marked(bits, keys)
        ok = (tokens.place >= size - 1) & tokens.train[tokens.text] & known
        ok[1:] &= known[:-1]
        at = np.flatnonzero(ok)
        return keys[at - 1], word[at]

    def packs(held):
        prefix, word = (np.concatenate(c) for c in zip(*held, strict=True))
        key = gram(prefix, word)
        order = np.argsort(key)
        key = key[order]
        starts = firsts(key)
        n, first, part = np.diff(np.append(starts, len(key))), order[starts], part_of(key[starts], parts)
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()
        prefix, word = prefix[first], word[first]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                by = np.argsort(prefix[a:b])
                yield p, steps(prefix[a:b][by]), planes(word[a:b][by]), planes(n[a:b][by])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                held.append(found(part))
                size += len(held[-1][0])
                if size >= PACKED:
                    yield from sent(packs(held))
                    held, size = [], 0
        if size:
            yield from sent(packs(held))

    def sent(rows):
        for p, *columns in rows:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], ["part", "prefix", "word", "n"])

    def settle(table):
        prefix, word, n = (np.concatenate([f(x.as_py()) for x in table.column(c)]) for c, f in (("prefix", stepped), ("word", unplaned), ("n", unplaned)))
        key = gram(prefix, word)
        order = np.argsort(key)
        starts = firsts(key[order])
        total = np.add.reduceat(n[order].view(np.int64), starts)
        often = total >= least
        at = order[starts[often]]
        return pa.table([pa.array(c.view(np.int64)) for c in (prefix[at], word[at], total[often])], ["prefix", "word", "n"])

    packed = rows.mapInArrow(run, "part int, prefix binary, word binary, n binary")
    return packed.groupBy("part").applyInArrow(settle, "prefix bigint, word bigint, n bigint")


def grow(found: DataFrame, below: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The grams ``key, suffix, n, logp, delta`` and the states kept, ``prefix, back``, of one level.

    ``logp`` is the probability of a gram's last word after the others in the tree so far, and ``delta`` what it differs by
    from the state one word shorter and from ``back``, which all words after the state get. Half an occurrence of each
    follower, and all followers too rare to be listed, are left to the other words in the proportions of the shorter state.
    The divergence test: the log-likelihood that the state wins over the shorter one on the training text must exceed half
    the logarithm of its count for each follower it lists.
    """

    def named(batches):
        for batch in batches:
            prefix, tail, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("prefix", "tail", "word"))
            key = gram(prefix, word).view(np.int64)
            suffix = (word if size == 2 else gram(tail, word)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("prefix"), pa.array(key), pa.array(suffix), batch.column("n"), batch.column("total")], ["prefix", "key", "suffix", "n", "total"])

    prefixes = below.select(F.col("key").alias("prefix"), F.col("n").alias("total"), F.col("suffix").alias("tail"))
    grams = found.join(prefixes, "prefix").mapInArrow(named, "prefix bigint, key bigint, suffix bigint, n bigint, total bigint")
    share = (F.col("n") - 0.5) / F.col("total")
    rows = stored_alone(
        grams.join(below.select(F.col("key").alias("suffix"), F.col("logp").alias("parent")), "suffix").withColumn("share", share), "suffix-tree-level"
    )
    parent = F.pow(F.lit(10.0), "parent")
    sums = rows.groupBy("prefix").agg(
        F.max("total").alias("total"),
        F.sum("n").alias("listed"),
        F.count(F.lit(1)).alias("followers"),
        F.greatest(1 - F.sum("share"), F.lit(1e-12)).alias("left"),
        F.greatest(1 - F.sum(parent), F.lit(1e-12)).alias("rest"),
        F.sum(F.col("n") * F.ln(F.col("share") / parent)).alias("won"),
    )
    gain = F.col("won") + (F.col("total") - F.col("listed")) * F.ln(F.col("left") / F.col("rest"))
    diverges = gain > F.col("followers") * F.ln(F.greatest("total", F.lit(2))) / 2
    kept = stored_alone(sums.where(diverges).select("prefix", F.log10(F.col("left") / F.col("rest")).alias("back")), "suffix-tree-states")
    own = F.log10("share")
    level = rows.join(kept, "prefix", "left").select(
        "key", "suffix", "n", F.when(F.col("back").isNull(), F.col("parent")).otherwise(own).alias("logp"), (own - F.col("parent") - F.col("back")).alias("delta")
    )
    return stored_alone(level, "suffix-tree-grams"), kept


def most_frequent(grams: DataFrame, share: float, most: int) -> int:
    """The least count from which on there are no more than ``most`` grams, at most ``share``."""
    at, left = math.ceil(share), most - grams.where(F.col("n") >= share).count()
    # Fewer rows than the share.
    for row in grams.where(F.col("n") < share).groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        left -= row["count"]
        if left < 0:
            break
        at = row.n
    return at


def fit(rows: DataFrame, vocabulary: DataFrame, words: np.ndarray, at_root: Column, depth: int, least: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Terms per gram: ``key, n, c, back`` of all words and ``key, n, term`` of the longer grams that have one."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def coded(batches):
        for batch in batches:
            key = codes(shared.value, batch.column("key").to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("c")], ["key", "c"])

    singles = vocabulary.select("key", "c").mapInArrow(coded, "key bigint, c bigint")
    frequent = singles.where(F.col("c") >= least)
    levels = [stored_alone(frequent.select("key", F.lit(0).cast("long").alias("suffix"), F.col("c").alias("n"), at_root.alias("logp"), F.lit(None).cast("double").alias("delta")), "suffix-tree-words")]
    states = []
    for size in range(2, depth + 2):
        level, kept = grow(count_grams(rows, words, levels[-1], size, least, parts), levels[-1], size)
        levels.append(level)
        states.append(kept.withColumnRenamed("prefix", "key"))
        if kept.isEmpty():
            break
    none = states[0].where("false") if states else rows.sparkSession.createDataFrame([], "key bigint, back double")
    states.append(none)
    first = singles.join(states[0], "key", "left").select("key", "c", F.coalesce("back", F.lit(0.0)).alias("term"))
    zero = F.lit(0.0)
    others = [
        level.join(kept, "key", "left").where("delta IS NOT NULL OR back IS NOT NULL")
        .select("key", "n", (F.coalesce("delta", zero) + F.coalesce("back", zero)).alias("term"))
        for level, kept in zip(levels[1:], states[1:], strict=True)
    ]
    longer_grams = reduce(DataFrame.unionByName, others) if others else none.select("key", F.lit(0).cast("long").alias("n"), F.col("back").alias("term"))
    return stored_alone(first, "suffix-tree-word-terms"), stored_alone(longer_grams, "suffix-tree-terms")


def score(
    docs: DataFrame, held_out=None, depth: int = 3, least: int = 8, word_share: float = 1e-6, gram_share: float = 4e-6,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The tree and all counts learn from the documents for which ``held_out`` (default: crc32 of the id modulo 7 is 2) is
    not true; every document is scored. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text ends in one more
    token. ``base_score`` sums log10((c + 1) / (N + V + 1)), ``score`` is the tree's log10 probability.

    * Null and empty texts are the end alone. A row without an id is a training row. Texts are read whole.
    * Repeated rows are rows of their own in counts and result. An empty table gives an empty result.
    * States have up to ``depth`` words; a state lists the followers it has at least ``least`` times.
    * Words with ``word_share`` of all tokens and the ``depth / gram_share`` most frequent grams are looked up in arrays, all
      others by range; the shares bound what tasks hold and change no result. Other columns are not read.
    """
    if held_out is None:
        held_out = id_crc(F.col(id_column)) % 7 == 2
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )

    def single(part):
        tokens = Tokens(part)
        return tokens.hash, [tokens.hash], [tokens.train[tokens.text].astype(np.float64), np.ones(len(tokens.hash))]

    vocabulary = stored_alone(counted(rows, single, ["key"], ["c", "n_all"]), "word-counts")
    totals = vocabulary.agg(F.sum("c").alias("n"), F.sum("n_all").alias("n_all"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, n_all = totals.n or 0, totals.n_all or 0
    at_root = F.log10((F.col("c") + 1) / F.lit(float(n + (totals.v or 0) + 1)))
    # At most 1 / word_share words have that share.
    table = vocabulary.where(F.col("n_all") >= max(word_share * n_all, 1)).select("key", "c", at_root.alias("base")).toArrow()
    words = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, count, base = words[order], table.column("c").to_numpy()[order], table.column("base").to_numpy()[order]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    singles, grams = fit(rows, vocabulary, words, at_root, depth, least, max(-(-n_all // PART_TOKENS), cores))
    parts = max(-(-n_all // ASK_TOKENS), cores)
    table = singles.where("key >= 0").toArrow()
    back = np.zeros(len(words))
    back[table.column("key").to_numpy()] = table.column("term").to_numpy()
    often = F.col("n") >= most_frequent(grams, max(gram_share * n, 1), int(depth / gram_share))
    table = grams.where(often).select("key", "term").toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, terms = keys[order], table.column("term").to_numpy()[order]
    few = np.zeros(OFTEN_BITS // 8, np.uint8)
    place = keys & np.uint64(OFTEN_BITS - 1)
    np.bitwise_or.at(few, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    # Arrays only: a broadcast is unpickled by name, and executors need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast((words, count, base, back, keys, terms, few, bitmap(grams.where(~often))))
    answers = asked(rows, shared, depth, parts).groupBy("part").cogroup(
        singles.where("key < 0").unionByName(grams.select("key", F.lit(-1).cast("long").alias("c"), "term"))
        .withColumn("part", F.expr(f"CAST(shiftright(shiftrightunsigned(shiftleft(key, 1), 32) * {parts}L, 32) AS INT)"))
        .groupBy("part")
    )
    kind, out_of = rows.schema["id"].dataType.simpleString(), float(n + (totals.v or 0) + 1)
    summed = answers.applyInArrow(answered(out_of), f"block bigint, {TEXT.format(kind)}, text binary, some_known binary, some_base binary, some_more binary")
    each = summed.groupBy("block").applyInArrow(gathered, TEXT.format(kind))
    return each.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("base") + F.col("more")).alias("score"),
    )


#: A text of a block, and what it has at home.
TEXT = "at bigint, id {}, held_out boolean, n_tokens bigint, known bigint, base double, more double"
TEXT_NAMES = ["at", "id", "held_out", "n_tokens", "known", "base", "more"]


def asked(rows: DataFrame, shared, depth: int, parts: int) -> DataFrame:
    """The texts with what they find in the arrays, and their other words and grams in packs: one per block of texts and range.

    Blocks are numbered by the task that makes them, so a task that is run again must read its rows in the same order, as scans do.
    """

    def parted(part, at):
        words, count, base, back, often, terms, few, bits = shared.value
        tokens = Tokens(part)
        ids = lookup(words, tokens.hash)
        word = np.where(ids >= 0, ids.astype(np.uint64), tokens.hash | RARE)
        frequent = np.flatnonzero(ids >= 0)
        text, ids = tokens.text[frequent], ids[frequent]
        n = len(tokens.counts)
        known, more = per_text(text, count[ids] > 0, n).astype(np.int64), per_text(text, back[ids], n)
        rare = np.flatnonzero(word >= RARE)
        away, keys, sent = [rare], word, [word[rare]]
        for size in range(2, depth + 2):
            keys = longer(keys, word)
            here = tokens.place >= size - 1
            may = np.flatnonzero(here & marked(few, keys))
            hit = lookup(often, keys[may])
            may, hit = may[hit >= 0], hit[hit >= 0]
            more += per_text(tokens.text[may], terms[hit], n)
            here &= marked(bits, keys)
            here[may] = False
            here = np.flatnonzero(here)
            away.append(here)
            sent.append(keys[here])
        at += np.arange(n)
        whole = [at, part.column("id"), part.column("held_out"), tokens.counts, known, per_text(text, base[ids], n), more]
        return whole, turned(np.concatenate(sent)), at[tokens.text[np.concatenate(away)]]

    def packs(held):
        keys, text = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, text = keys[order], text[order]
        starts = firsts(keys, text)
        keys, text, n = keys[starts], text[starts], np.diff(np.append(starts, len(keys)))
        cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64)).tolist()
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                yield p, steps(keys[a:b]), planes(text[a:b]), planes(n[a:b])

    def run(batches):
        block, texts, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                whole, *sent = parted(part, texts)
                yield record([(whole[0] % parts).astype(np.int32), np.full(part.num_rows, block), *whole, *[pa.nulls(part.num_rows, pa.binary())] * 3])
                held.append(sent)
                texts, size = texts + part.num_rows, size + len(sent[0])
                if size >= PACKED or texts >= BLOCK_TEXTS:
                    yield from out(block, held, part.schema)
                    block, texts, held, size = block + 1, 0, [], 0
        if size:
            yield from out(block, held, part.schema)

    def out(block, held, schema):
        none = [pa.nulls(1, t) for t in (pa.int64(), schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        for p, *columns in packs(held):
            yield record([pa.array([p], pa.int32()), pa.array([block]), *none, *(pa.array([c], pa.binary()) for c in columns)])

    def record(columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["part", "block", *TEXT_NAMES, "keys", "text", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"part int, block bigint, {TEXT.format(kind)}, keys binary, text binary, n binary")


def answered(out_of: float):
    """What the texts of each pack get from the terms of its range; the texts themselves pass."""

    def settle(asked, terms):
        keys = turned(terms.column("key").to_numpy().view(np.uint64))
        order = np.argsort(keys)
        keys, c, term = keys[order], terms.column("c").to_numpy()[order], terms.column("term").to_numpy()[order]
        base = np.where(c >= 0, np.log10((np.maximum(c, 0) + 1) / out_of), 0.0)
        is_text = pa.compute.is_valid(asked.column("at"))
        texts, found = asked.filter(is_text), asked.filter(pa.compute.invert(is_text))
        blocks, packs = [], []
        for block, *pack in zip(*(found.column(c) for c in ("block", "keys", "text", "n")), strict=True):
            asks, text, n = (f(x.as_py()) for f, x in zip((stepped, unplaned, unplaned), pack, strict=True))
            hit = lookup(keys, asks)
            at = np.flatnonzero(hit >= 0)
            if len(at):
                hit, n = hit[at], n[at].astype(np.float64)
                text, to = np.unique(text[at], return_inverse=True)
                blocks.append(block.as_py())
                packs.append([steps(text), *(planes(np.bincount(to, n * x[hit])) for x in (c > 0, base, term))])
        none = [pa.nulls(len(packs), texts.schema.field(c).type) for c in TEXT_NAMES]
        names = ["block", *TEXT_NAMES, "text", "some_known", "some_base", "some_more"]
        columns = [pa.array([p[i] for p in packs], pa.binary()) for i in range(4)]
        plain = [*(texts.column(c) for c in names[:8]), *[pa.nulls(texts.num_rows, pa.binary())] * 4]
        return pa.concat_tables([pa.table(plain, names), pa.table([pa.array(blocks, pa.int64()), *none, *columns], names)])

    return settle


def gathered(table: pa.Table) -> pa.Table:
    """The texts of one block with all that they have got."""
    is_text = pa.compute.is_valid(table.column("at"))
    texts, packs = table.filter(is_text), table.filter(pa.compute.invert(is_text))
    at = texts.column("at").to_numpy()
    sums = [np.zeros(texts.num_rows) for _ in range(3)]
    for text, *some in zip(*(packs.column(c) for c in ("text", "some_known", "some_base", "some_more")), strict=True):
        text = stepped(text.as_py())
        for total, values in zip(sums, some, strict=True):
            total[text] += unplaned(values.as_py(), np.float64)
    known, base, more = (total[at] + texts.column(c).to_numpy() for total, c in zip(sums, ("known", "base", "more"), strict=True))
    return pa.table([*(texts.column(c) for c in TEXT_NAMES[:4]), pa.array(known.astype(np.int64)), pa.array(base), pa.array(more)], TEXT_NAMES)
