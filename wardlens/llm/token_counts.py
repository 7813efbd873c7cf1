"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

A piece of text starts as one symbol per byte. The pair of lowest rank is popped and joined until none is left, so a
piece's count is its bytes less its merges; no token identifiers are written. The merge table travels to the tasks as a
broadcast of plain integers whose size is the vocabulary's. Tasks stream Arrow batches and nothing is shuffled.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.session import ship_by_value

ship_by_value(__name__)

# White space as the tokenizer's own pattern engine has it (fixed values); Python's \s holds four more.
WHITE = r"\t-\r \x85\xa0  -     　"
# The library's byte-level pattern (fixed values).
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Letters of pieces that a task remembers; beyond it the older half is forgotten, which costs time, never results.
REMEMBERED_LETTERS = 4_000_000
#: Longer pieces are merged each time they occur.
LONGEST_REMEMBERED = 64
#: Rows turned into Python strings at a time.
SLICE = 256


def stand_ins() -> dict[str, int]:
    """The byte behind each printable letter of a byte-level vocabulary: itself, or the next free code point from 256."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_table(path: str) -> dict:
    """``first``: the symbol of each byte; ``pairs``: packed symbol pair to packed (rank, joined symbol); ``special``: added strings."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    vocabulary = whole["model"]["vocab"]
    first = [0] * 256
    for letter, byte in stand_ins().items():
        first[byte] = vocabulary[letter]
    pairs = {}
    for rank, (left, right) in enumerate(whole["model"]["merges"]):
        pairs[vocabulary[left] << 32 | vocabulary[right]] = rank << 32 | vocabulary[left + right]
    return {"first": first, "pairs": pairs, "special": [t["content"] for t in whole["added_tokens"]]}


def count_piece(raw: bytes, first: list[int], pairs: dict[int, int]) -> int:
    """Bytes less merges. A heap entry is (rank, place of the left symbol) in one integer; an entry whose pair has changed is skipped."""
    n = len(raw)
    symbols = [first[b] for b in raw]
    known = pairs.get
    heap = []
    for i in range(n - 1):
        hit = known(symbols[i] << 32 | symbols[i + 1])
        if hit is not None:
            heap.append(hit >> 32 << 32 | i)
    if not heap:
        return n
    heapify(heap)
    following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        j = following[i]
        if symbols[i] < 0 or j >= n:
            continue
        hit = known(symbols[i] << 32 | symbols[j])
        if hit is None or hit >> 32 != entry >> 32:
            continue
        merges += 1
        joined = symbols[i] = hit & 0xFFFFFFFF
        symbols[j] = -1
        k = following[i] = following[j]
        if k < n:
            preceding[k] = i
            hit = known(joined << 32 | symbols[k])
            if hit is not None:
                heappush(heap, hit >> 32 << 32 | i)
        h = preceding[i]
        if h >= 0:
            hit = known(symbols[h] << 32 | joined)
            if hit is not None:
                heappush(heap, hit >> 32 << 32 | h)
    return n - merges


class PieceCounts(dict):
    """Counts of pieces, with two generations of remembered ones bounded by their letters."""

    def __init__(self, table: dict):
        super().__init__()
        self.first, self.pairs, self.older, self.letters = table["first"], table["pairs"], {}, 0

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONGEST_REMEMBERED:
            return count_piece(piece.encode(), self.first, self.pairs)
        found = self.older.get(piece)
        if found is None:
            found = count_piece(piece.encode(), self.first, self.pairs)
        self.letters += len(piece) + 8
        if self.letters > REMEMBERED_LETTERS // 2:
            self.older, self.letters = dict(self), 0
            self.clear()
        self[piece] = found
        return found


def counter(table: dict):
    """A function from a text to its number of tokens; added strings inside the text count one each, as the library has it."""
    counts, pieces = PieceCounts(table), regex.compile(PIECE)
    special = regex.compile("|".join(regex.escape(s) for s in sorted(table["special"], key=len, reverse=True))) if table["special"] else None

    def count(text: str) -> int:
        if special is None or not any(s in text for s in table["special"]):
            return sum(map(counts.__getitem__, pieces.findall(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, pieces.findall(part))) for part in parts)

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``id, n_bytes, n_tokens, over_limit``.

    Null and empty texts have no bytes and no tokens. Texts are counted whole, however long; a long unbroken piece takes
    n log n steps. Repeated rows and rows without an id are counted like any other; other columns are not read, so they
    may have any name. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(merge_table(path))

    def run(batches):
        count = counter(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = pa.array([count(t) for t in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), found], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
