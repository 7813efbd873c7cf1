"""Byte-pair encoding by a queue of merge ranks over a linked list of symbols, and decoding.

The vocabulary file is read once on the driver and travels to the tasks as a
broadcast of fixed size. Tasks stream Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.words import text_slices
from wardlens.session import ship_by_value

ship_by_value(__name__)

# White space as the tokenizer's own pattern engine has it (fixed values); Python's \s holds four more.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Bytes of memory for the pieces that a task remembers; older ones are forgotten, which costs time, never results.
REMEMBERED = 64_000_000
#: What Python takes for a remembered piece besides its letters and ids: two objects and a place in a table.
PLACE_BYTES = 200
#: Longer pieces are merged each time they occur.
LONGEST_REMEMBERED = 256
#: Rows decoded at a time inside an Arrow batch; texts are encoded by slices of their bytes.
SLICE = 256


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that encoding and decoding need."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model = whole["model"]
    vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    names = {i: s for s, i in vocabulary.items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
    letters = byte_letters()
    merges = model["merges"]
    split = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "names": [names.get(i, "") for i in range(max(names) + 1)],
        "inner": [vocabulary[c] for c in letters],
        "last": [vocabulary[c + suffix] for c in letters],
        "ranks": {vocabulary[left] << 32 | vocabulary[right]: rank for rank, (left, right) in enumerate(merges)},
        "made": [vocabulary[left + right] for left, right in merges],
        "pattern": split.replace(r"\s", WHITE),
        "added": {t["content"]: t["id"] for t in whole["added_tokens"]},
    }


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Apply merges by rank, then position, until no pair is left that has one.

    A queue entry is a rank and the position of the left symbol, packed so that plain integer order is their order.
    """
    n = len(symbols)
    rank_of = ranks.get
    queue, left = [], -1
    for i, right in enumerate(symbols):
        rank = rank_of(left << 32 | right)
        if rank is not None:
            queue.append(rank << 32 | i - 1)
        left = right
    if not queue:
        return symbols
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
            continue  # the entry is stale: one of its symbols has been merged since
        new = symbols[i] = made[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(new << 32 | symbols[k])
            if rank is not None:
                heappush(queue, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] << 32 | new)
            if rank is not None:
                heappush(queue, rank << 32 | h)
    return [s for s in symbols if s >= 0]


class Pieces(dict):
    """Ids of a piece as little-endian bytes, with two generations of remembered pieces bounded by their bytes."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.vocabulary, self.older, self.bytes = vocabulary, {}, 0

    def merged(self, piece: str) -> bytes:
        raw = piece.encode()
        symbols = [*map(self.vocabulary["inner"].__getitem__, raw[:-1]), self.vocabulary["last"][raw[-1]]]
        return array("I", merge(symbols, self.vocabulary["ranks"], self.vocabulary["made"])).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST_REMEMBERED:
            return self.merged(piece)
        ids = self.older.get(piece)
        if ids is None:
            ids = self.merged(piece)
        self.bytes += PLACE_BYTES + len(piece) + len(ids)
        if self.bytes > REMEMBERED // 2:
            self.older, self.bytes = dict(self), PLACE_BYTES + len(piece) + len(ids)
            self.clear()
        self[piece] = ids
        return ids


def normal(text: str) -> str:
    """Composed and lower-cased letter by letter (a final sigma is no exception)."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()


def encoder(vocabulary: dict):
    """A function from text to its ids as little-endian unsigned 32-bit bytes."""
    pieces, pattern = Pieces(vocabulary), regex.compile(vocabulary["pattern"])
    added = {name: i.to_bytes(4, "little") for name, i in vocabulary["added"].items()}
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(text: str) -> bytes:
        return b"".join(map(pieces.__getitem__, pattern.findall(normal(text))))

    def encode(text: str) -> bytes:
        if special is None or not any(name in text for name in added):
            return plain(text)
        return b"".join(added[part] if part in added else plain(part) for part in special.split(text))

    return encode


def texts_of(ids: list[bytes | None], names: list[str]) -> list[str | None]:
    """The vocabulary strings of each row's ids, put together with one space between them."""
    name = names.__getitem__
    return [None if row is None else " ".join(map(name, array("I", row))) for row in ids]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", and_decode: bool = False) -> DataFrame:
    """Per document: ``id, n_tokens, ids`` (binary, little-endian unsigned 32-bit integers).

    Null and empty texts have no tokens. Texts are encoded whole. Added tokens written in a text become their ids, as in
    the library of the file. Repeated rows and rows without ids are encoded like any other; other columns are not read.
    With ``and_decode`` a column ``decoded`` follows, as :func:`decode` gives it: the worker that holds a slice's ids
    decodes them, so a task has one worker and one vocabulary, and ids do not travel for it.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    columns = ["id", "n_tokens", "ids", *["decoded"] * and_decode]

    def run(batches):
        to_ids = encoder(shared.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [to_ids(t) for t in part.column("text").to_pylist()]
                found = [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if and_decode:
                    found.append(pa.array(texts_of(ids, shared.value["names"]), pa.string()))
                yield pa.RecordBatch.from_arrays(found, columns)

    encoded = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary" + ", decoded string" * and_decode)
    return encoded.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the vocabulary strings of its ids, put together with one space between them.

    That is what a tokenizer without a decoder step gives. Null ids decode to null, no ids to the empty text.
    An id outside the vocabulary fails. A column of that name is replaced.
    """
    rows = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path)["names"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = texts_of(part.column(ids_column).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{columns}, `decoded` string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of both directions: ``id, n_tokens, ids_sha256, decoded_sha256``."""
    both = encode(docs, path, id_column, text_column, and_decode=True)
    return both.select(id_column, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
