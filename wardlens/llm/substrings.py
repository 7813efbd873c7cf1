"""Substring dedup by difference-cover anchors.

Short windows are hashed only at positions whose remainder by a period lies in
a difference cover. For any two positions some common shift brings both onto the
cover, so a long match always holds an anchor at the same place in both texts.
Shared anchors tell where to look; there the full windows are compared, and a
window goes when its words also start in a smaller document.

Keys meet in packed form: a task sends one row per key range with sorted hashes
and their places, at most one representative per key, so a passage that a third
of all documents hold arrives as one entry per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.words import OTHER_BASE, Words, mixed, text_slices
from wardlens.session import ship_by_value, stored

ship_by_value(__name__)

#: Differences of the cover give every remainder by the period: six places in 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Entries a task gathers before it sends them.
GATHERED = 1_500_000

# A packed row: places in documents, by key. ``doc`` and ``own`` are the documents of the row, ``at`` numbers them per entry.
PACKED = "part int, keys binary, check binary, at binary, pos binary, doc binary, own binary"
PLACES = "doc bigint, own bigint, pos binary"


def own_hash(words: Words) -> np.ndarray:
    """A hash of each text's words, which tells rows with the same id apart."""
    return words.texts()


def in_words(offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.searchsorted(first, offsets, side="right") - 1


def groups(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group starts in it."""
    order = np.lexsort((check, keys))
    k, c = keys[order], check[order]
    return order, np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))) if len(k) else np.zeros(0, int)


class Gathered:
    """Entries (key, check, text number, place) of one task, and the id and own hash of each text number."""

    def __init__(self):
        self.entries: list[tuple[np.ndarray, ...]] = []
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.n_texts = 0

    def add(self, keys, check, text, pos, doc, own) -> None:
        self.entries.append((keys, check, text + self.n_texts, pos))
        self.texts.append((doc, own))
        self.size += len(keys)
        self.n_texts += len(doc)

    def take(self) -> list[np.ndarray]:
        """Keys, checks, text numbers and places of all entries; ids and own hashes of all texts."""
        out = [np.concatenate(c) for c in (*zip(*self.entries, strict=True), *zip(*self.texts, strict=True))]
        self.__init__()
        return out


def packed(part: int, keys, check, text, pos, doc, own) -> dict:
    order = np.argsort(keys, kind="stable")
    names = np.unique(text)
    at = np.searchsorted(names, text[order])
    return {
        "part": part, "keys": keys[order].tobytes(), "check": check[order].tobytes(), "at": at.astype(np.uint32).tobytes(),
        "pos": pos[order].astype(np.uint32).tobytes(), "doc": doc[names].tobytes(), "own": own[names].tobytes(),
    }


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    at = np.frombuffer(row["at"], np.uint32).astype(np.int64)
    keys, check = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["check"], np.uint32)
    return keys, check, at, np.frombuffer(row["pos"], np.uint32), np.frombuffer(row["doc"], np.int64), np.frombuffer(row["own"], np.int64)


def places(doc: np.ndarray, own: np.ndarray, pos: np.ndarray) -> pa.Table:
    """One row per document (and own hash) with its sorted distinct places."""
    order = np.lexsort((pos, own, doc))
    doc, own, pos = doc[order], own[order], pos[order].astype(np.uint32)
    same = np.concatenate(([False], (doc[1:] == doc[:-1]) & (own[1:] == own[:-1]))) if len(doc) else np.zeros(0, bool)
    fresh = ~(same & np.concatenate(([False], pos[1:] == pos[:-1]))) if len(doc) else same
    doc, own, pos, same = doc[fresh], own[fresh], pos[fresh], same[fresh]
    starts = np.flatnonzero(~same)
    edges = (np.append(starts, len(pos)) * 4).astype(np.int64)
    lists = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(pos)])
    return pa.table({"doc": doc[starts], "own": own[starts], "pos": lists.cast(pa.binary())})


def decided(keys, check, doc, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """Within one set of entries: those known to be wanted, and those that must represent their key elsewhere.

    ``smaller``: wanted is an entry with a smaller document under its key. Otherwise wanted is every entry of a key that
    two documents have. The smallest document represents a key, with all its places: they may yet turn out wanted.
    """
    order, starts = groups(keys, check)
    wanted, stands = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(order):
        sizes = np.diff(np.append(starts, len(order)))
        sorted_doc = doc[order]
        least, most = np.minimum.reduceat(sorted_doc, starts), np.maximum.reduceat(sorted_doc, starts)
        wanted[order] = sorted_doc > np.repeat(least, sizes) if smaller else np.repeat(most > least, sizes)
        stands[order] = sorted_doc == np.repeat(least, sizes)
    return wanted, stands


def meet(rows: DataFrame, make, parts: int, smaller: bool) -> DataFrame:
    """``doc, own, pos`` (packed places) of the wanted entries among those that ``make`` finds in the texts of ``rows``.

    Entries decided within a task go out at once. The rest meet by key range: ``parts`` ranges, so that a range holds a
    bounded share of the input.
    """
    schema = pa.schema([("part", pa.int32()), *[(n, pa.binary()) for n in ("keys", "check", "at", "pos", "doc", "own")]])

    def send(held: Gathered):
        keys, check, text, pos, doc, own = held.take()
        wanted, stands = decided(keys, check, doc[text], smaller)
        out = []

        def deal(some: np.ndarray, part: np.ndarray, known: bool):
            order = np.argsort(part, kind="stable")
            some, part = some[order], part[order]
            edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                p, mine = int(part[a]), some[a:b]
                row = packed(p, keys[mine], check[mine], text[mine], pos[mine], doc, own)
                out.append(row | {"keys": b"", "check": b""} if known else row)

        # Decided entries only travel to their document, spread by it. Keys are even, so their high bits cut even ranges.
        known, open_ = np.flatnonzero(wanted), np.flatnonzero(stands)
        deal(known, (mixed(doc[text[known]].view(np.uint64)) % np.uint64(parts)).astype(np.int64), True)
        deal(open_, ((keys[open_] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), False)
        return pa.RecordBatch.from_pylist(out, schema)

    def gather(batches):
        held = Gathered()
        for batch in batches:
            for part in text_slices(batch, "text"):
                held.add(*make(part))
                if held.size >= GATHERED:
                    yield send(held)
        if held.size:
            yield send(held)

    def settle(key, table):
        found, held = [], Gathered()
        for row in table.to_pylist():
            columns = unpacked(row)
            if row["keys"]:
                held.add(*columns)
            else:
                _, _, at, pos, doc, own = columns
                found.append((doc[at], own[at], pos))
        if held.size:
            keys, check, text, pos, doc, own = held.take()
            wanted, _ = decided(keys, check, doc[text], smaller)
            found.append((doc[text[wanted]], own[text[wanted]], pos[wanted]))
        return places(*[np.concatenate(c) for c in zip(*found, strict=True)])

    return rows.mapInArrow(gather, PACKED).groupBy("part").applyInArrow(settle, PLACES)


def anchors(length: int):
    """Finds the anchors of a slice: windows of ``length`` words at the places of the cover."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def make(part: pa.RecordBatch):
        words = Words(part.column("text"))
        ids = part.column("id").to_numpy()
        start = words.windows(length)
        text = in_words(start, words.first)
        place = start - words.first[text]
        on = cover[place % PERIOD]
        start, text, place = start[on], text[on], place[on]
        return words.of(words.sums(), start, length), np.zeros(len(start), np.uint32), text, place.astype(np.uint32), ids, own_hash(words)

    return make


def windows(window: int, reach: int):
    """Finds the full windows of a slice that hold one of the text's shared anchors (column ``pos``)."""

    def make(part: pa.RecordBatch):
        words = Words(part.column("text"))
        ids = part.column("id").to_numpy()
        wanted = np.zeros(len(words) + 1, np.int64)
        counts = words.counts()
        for i, places_i in enumerate(part.column("pos").to_pylist()):
            at = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in places_i])).astype(np.int64)
            last = counts[i] - window
            if last < 0:
                continue
            low, high = np.maximum(at - reach, 0), np.minimum(at, last)
            ok = low <= high
            np.add.at(wanted, words.first[i] + low[ok], 1)
            np.add.at(wanted, words.first[i] + high[ok] + 1, -1)
        start = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
        text = in_words(start, words.first)
        check = (words.of(words.sums(OTHER_BASE), start, window, OTHER_BASE) >> np.uint64(32)).astype(np.uint32)
        return words.of(words.sums(), start, window), check, text, (start - words.first[text]).astype(np.uint32), ids, own_hash(words)

    return make


def removed_windows(docs: DataFrame, window: int, id_column: str, text_column: str, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``id, text`` of the documents that share an anchor, and ``id, own, gone``: the windows to remove of each text."""
    if window <= PERIOD:
        raise ValueError(f"window must be more than {PERIOD}")
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).where("id IS NOT NULL")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(-(-size // range_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    shared = meet(named, anchors(window - PERIOD + 1), parts, smaller=False)
    # A document has at most one row per key range.
    per_id = shared.groupBy(F.col("doc").alias("id")).agg(F.collect_list("pos").alias("pos"))
    touched = stored(named.join(per_id, "id"), "repeats-touched")
    found = meet(touched, windows(window, PERIOD - 1), parts, smaller=True)
    return touched.select("id", "text"), found.groupBy(F.col("doc").alias("id"), "own").agg(F.collect_list("pos").alias("gone"))


def kept_words(rows: DataFrame, window: int, digest: bool) -> DataFrame:
    """``id, own, n_words, n_removed, kept`` of ``id, text`` and, where they are given, ``own, gone`` of the same text."""
    with_gone = "gone" in rows.columns

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                own = own_hash(Words(part.column("text")))
                if with_gone:
                    # An id may come with several texts; what is gone belongs to one of them.
                    right = own == part.column("own").to_numpy()
                    part, own = part.filter(pa.array(right)), own[right]
                gone = part.column("gone").to_pylist() if with_gone else [[]] * part.num_rows
                n_words, n_removed, kept = [], [], []
                for text, lists in zip(part.column("text").to_pylist(), gone, strict=True):
                    words = text.encode().split()  # splits bytes at \x20 and \x09-\x0D only
                    n_words.append(len(words))
                    if lists:
                        cover = np.zeros(len(words) + 1, np.int64)
                        at = np.unique(np.frombuffer(b"".join(lists), np.uint32)).astype(np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    rest = b" ".join(words)
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
                columns = [part.column("id"), pa.array(own), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "own", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "id bigint, own bigint, n_words bigint, n_removed bigint, kept string")


def remove_repeats(
    docs: DataFrame, window: int = 50, digest: bool = False, id_column: str = "doc_id", text_column: str = "text", range_bytes: int = 64_000_000
) -> DataFrame:
    """One row per document: ``id, n_words, n_removed`` and ``kept_text``, or with ``digest`` its SHA-256 as ``kept_sha256``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``window`` (more than 31) consecutive words of a document;
    every word of a window whose words also start in a document with a smaller id is removed, judged on the input.
    ``kept_text`` joins the other words by one space.

    * Null and empty texts have no words. Texts with fewer words than a window lose none. Long texts are read whole.
    * A row without an id takes no part and keeps all its words.
    * Rows that repeat an id do not remove each other's words; each is judged by its own text, equal rows alike.
    * Other columns are not read. An empty table gives an empty result.
    * Anchors compare 64 bits and only propose; full windows compare 96 bits.
    """
    touched, gone = removed_windows(docs, window, id_column, text_column, range_bytes)
    changed = kept_words(touched.join(gone, "id"), window, digest).dropDuplicates(["id", "own"]).select("id", "own", "n_removed", F.col("kept").alias("rest"))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    every = kept_words(rows, window, digest).drop("n_removed").join(changed, ["id", "own"], "left")
    kept = F.coalesce("rest", "kept").alias("kept_sha256" if digest else "kept_text")
    return every.select(F.col("id").alias(id_column), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), kept)
