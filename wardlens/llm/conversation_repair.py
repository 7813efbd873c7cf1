"""Repair of conversation structure by a run-length dynamic programme over min-plus transitions.

Every row of a conversation becomes one of sixteen symbols (initial of its role, first fault). Equal neighbours form a
run; a run of n rows is advanced by the cached binary powers of its symbol's min-plus matrix over the four states of
``(s?(ua)+)?``, and the cheapest edits are unrolled from the costs to go, halving each run by the same powers.

Conversations are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over
tasks. Rows are packed into chunks of bounded rows and bytes. A conversation inside one chunk is repaired where it is read;
for the others only symbols (a byte a row, as the audit) meet in one task, duplicates between chunks are found by a
join-free minimum per digest, and the repaired lines are hashed as a stream of chunks.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardlens.llm.digests import arrays, stream_digest
from wardlens.session import ship_by_value, stored

ship_by_value(__name__)

#: Rows and bytes of text that a chunk holds at most (a longer row makes a chunk of its own), bytes sent back at a time.
CHUNK_ROWS, CHUNK_BYTES, BATCH_BYTES = 4_096, 1_000_000, 4_000_000
#: Classes of a role's initial, faults of a row; a symbol is class * 4 + fault.
INITIALS = "sua"
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETE, INSERT, REROLE, UNENDED = 3, 2, 2, 1
# States: nothing yet, a system turn, a user turn, an assistant turn. The role that may come next, and its state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Cost of ending in a state, trailing inserts included.
ENDS = (0, 2 * INSERT, INSERT, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}


def keeps_to(kind: int, state: int) -> int | None:
    """The state after keeping a row of that class, or None where the order forbids it."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def choices(symbol: int, state: int):
    """(letter, cost, state after) of the edits that consume a row of that symbol."""
    kind, fault = divmod(symbol, 4)
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        extra = UNENDED if fault == TRUNCATED else 0
        kept = keeps_to(kind, state)
        if kept is not None:
            yield "K", extra, kept
        yield "R", REROLE + extra, NEXT[state]


def product(a, b):
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def advance(matrix, ahead):
    return tuple(min(m + v for m, v in zip(row, ahead, strict=True)) for row in matrix)


#: Matrices by (symbol, k), and solved conversations of few rows; plain tables, as cached functions do not travel by value.
POWERS: dict[tuple[int, int], tuple] = {}
SOLVED: dict[bytes, tuple[int, str]] = {}
SOLVED_ROWS, SOLVED_MOST = 32, 100_000


def power(symbol: int, k: int):
    """Cheapest costs from state to state over 2**k rows of one symbol, inserts before each row included."""
    found = POWERS.get((symbol, k))
    if found is None:
        half = power(symbol, k - 1) if k else None
        found = POWERS[symbol, k] = product(half, half) if k else one_row(symbol)
    return found


def one_row(symbol: int):
    inserted = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        at, cost = state, 0
        for _ in range(3):
            inserted[state][at] = min(inserted[state][at], cost)
            at, cost = NEXT[at], cost + INSERT
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in choices(symbol, state):
            row[state][after] = min(row[state][after], cost)
    return product(inserted, row)


def back(symbol: int, n: int, ahead):
    """Costs to go before n rows of a symbol, from those after them."""
    k = 0
    while n:
        if n & 1:
            ahead = advance(power(symbol, k), ahead)
        n, k = n >> 1, k + 1
    return ahead


def unroll(symbol: int, n: int, state: int, ahead, out: list[str]) -> int:
    """Append the ASCII-least of the cheapest edits of a run; the state after it."""
    if n > 1:
        k = (n - 1).bit_length() - 1
        state = unroll(symbol, n - (1 << k), state, advance(power(symbol, k), ahead), out)
        return unroll(symbol, 1 << k, state, ahead, out)
    here = advance(power(symbol, 0), ahead)
    while True:
        options = [(letter, cost + ahead[after], after) for letter, cost, after in choices(symbol, state)]
        options.append(("I", INSERT + here[NEXT[state]], None))
        letter, _, after = min(o for o in options if o[1] == here[state])
        out.append(letter)
        if letter != "I":
            return after
        state = NEXT[state]


def solve(symbols: bytes) -> tuple[int, str]:
    """The least cost of a conversation and its edits."""
    runs = [(symbol, sum(1 for _ in group)) for symbol, group in groupby(symbols)]
    ahead = [ENDS]
    for symbol, n in reversed(runs):
        ahead.append(back(symbol, n, ahead[-1]))
    ahead.reverse()
    state, out = START, []
    for (symbol, n), after in zip(runs, ahead[1:], strict=True):
        state = unroll(symbol, n, state, after, out)
    out.append("I" * (ENDS[state] // INSERT))
    return ahead[0][START], "".join(out)


def solve_short(symbols: bytes) -> tuple[int, str]:
    found = SOLVED.get(symbols)
    if found is None:
        if len(SOLVED) >= SOLVED_MOST:
            SOLVED.clear()
        found = SOLVED[symbols] = solve(symbols)
    return found


def judged(symbols: bytes) -> dict:
    """Faults, illegal neighbours, cost and audit of a conversation's symbols."""
    cost, audit = solve_short(symbols) if len(symbols) <= SOLVED_ROWS else solve(symbols)
    codes = np.frombuffer(symbols, np.uint8)
    kinds, faults = codes >> 2, np.bincount(codes & 3, minlength=4)
    pairs = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16) if len(codes) > 1 else np.zeros(16, np.int64)
    illegal = int(pairs.sum() - sum(pairs[a * 4 + b] for a, b in LEGAL))
    return {"blank": int(faults[BLANK]), "duplicate": int(faults[DUPLICATE]), "truncated": int(faults[TRUNCATED]), "illegal": illegal, "cost": cost, "audit": audit}


def replay(edits: str, state: int, kinds):
    """(letter, index of the row or None, state after) of every edit."""
    at = 0
    for letter in edits:
        if letter == "I":
            state = NEXT[state]
            yield letter, None, state
            continue
        if letter == "K":
            state = keeps_to(kinds[at], state)
        elif letter == "R":
            state = NEXT[state]
        yield letter, at, state
        at += 1


def repaired(edits: str, state: int, symbols: bytes, roles: list[str], texts: list[str]):
    """(role, text, letter) of the turns that a chunk's edits leave."""
    for letter, at, after in replay(edits, state, [s >> 2 for s in symbols]):
        if letter == "K":
            yield roles[at], texts[at], letter
        elif letter != "D":
            yield NAMES[after], "" if at is None else texts[at], letter


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with a fixed part of their rows damaged, as ``conv_id, turn, role, text, copies``.

    The checksum of ``conv_id:turn`` modulo 20 decides: 0 drops a row (no copies), 1 empties its text, 2 takes its sentence
    ends, 3 says it twice, 4 gives it to the user. Nulls count as one space, a null turn stays first in order.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    drawn = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    return drawn.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def chunks(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` in order, packed: one row per chunk, in a stored table.

    ``part, seq`` number the chunks of a task in order; ``open`` marks those of conversations that may have others: the first and last of a task and those of several chunks.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = F.when(F.length(trimmed) == 0, BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    ready = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("int").alias("copies"),
        (kind * 4 + fault).cast("int").alias("symbol"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("digest"),
    )
    ranged = ready.repartitionByRange("conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64))
    ordered = ranged.sortWithinPartitions("conv", "turn", "role", "text")
    kind = ordered.schema["conv"].dataType
    first_of = "array<struct<pos:int,digest:binary>>"
    schema = (
        f"conv {kind.simpleString()}, part int, seq int, open boolean, symbols binary, firsts {first_of}, low bigint, high bigint, turns bigint, roles array<string>, texts array<string>"
    )
    firsts = pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary())]))
    kinds = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), firsts, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["conv", "part", "seq", "open", "symbols", "firsts", "low", "high", "turns", "roles", "texts"]

    def run(batches):
        part = TaskContext.get().partitionId()
        out, out_bytes = [], 0
        conv, seq, several, first_conv, started = None, 0, False, True, False
        symbols, marks, seen, roles, texts, held = bytearray(), [], set(), [], [], 0
        low = high = None
        turns = 0

        def flush(is_open):
            nonlocal seq, symbols, marks, seen, roles, texts, held, low, high, turns
            row = (conv, part, seq, is_open, bytes(symbols), marks if is_open else [], low, high, turns, roles, texts)
            seq, symbols, marks, seen, roles, texts, held, low, high, turns = seq + 1, bytearray(), [], set(), [], [], 0, None, None, 0
            return row

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for c, turn, role, text, copies, symbol, digest in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if started and c != conv:
                    out.append(flush(first_conv or several))
                    first_conv = several = False
                elif started and (len(symbols) >= CHUNK_ROWS or held >= CHUNK_BYTES):
                    out.append(flush(True))
                    several = True
                conv, started = c, True
                for _ in range(copies):
                    if symbol & 3 != BLANK and digest in seen:
                        symbol = symbol | DUPLICATE
                    elif symbol & 3 != BLANK:
                        seen.add(digest)
                        marks.append({"pos": len(symbols), "digest": digest})
                    symbols.append(symbol)
                    roles.append(role)
                    texts.append(text)
                    held += len(text) + len(role)
                    out_bytes += len(text) + len(role) + 64
                if copies and turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if out_bytes >= BATCH_BYTES and out:
                    yield packed()
                    out, out_bytes = [], 0
        if started:
            out.append(flush(True))
        if out:
            yield packed()

    return stored(ordered.mapInArrow(run, schema), "conversation-chunks")


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
FIGURE_TYPES = [*[pa.int64()] * 6, pa.string()]
FIGURE_SCHEMA = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def rows_of(table: pa.Table | pa.RecordBatch):
    return zip(*[c.to_pylist() for c in table.columns], strict=True)


def open_edits(table: DataFrame) -> DataFrame:
    """For chunks of conversations of several: their part of the cheapest edits, the state in which they begin, their symbols
    with duplicates of earlier chunks marked and, on the first chunk, the figures of the conversation."""
    kind = table.schema["conv"].dataType
    split = table.where("open").select("conv", "part", "seq", "symbols", "low", "high", "turns", "firsts")
    # A digest of a conversation is a duplicate everywhere but at its first place.
    marks = split.select("conv", "part", "seq", F.explode("firsts").alias("mark")).select(
        "conv", F.col("mark.digest").alias("digest"), F.struct("part", "seq", "mark.pos").alias("place")
    )
    again = marks.groupBy(F.col("conv").alias("conv_"), F.col("digest").alias("digest_")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (
        marks.join(again, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")))
        .where(F.col("place") > F.col("first"))
        .groupBy("place.part", "place.seq")
        .agg(F.collect_list("place.pos").alias("repeats"))
    )
    split = split.join(later, ["part", "seq"], "left").select("conv", "part", "seq", "symbols", "low", "high", "turns", "repeats")
    types = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.binary(), *FIGURE_TYPES]
    names = ["conv", "part", "seq", "head", "entry", "edits", "fixed", *FIGURES]

    def together(group: pa.Table) -> pa.Table:
        rows = sorted(rows_of(group), key=lambda r: (r[1], r[2]))
        pieces, low, high, turns = [], None, None, 0
        for _, _, _, symbols, first, last, n, repeats in rows:
            codes = np.frombuffer(symbols, np.uint8).copy()
            if repeats:
                codes[repeats] |= DUPLICATE
            pieces.append(codes.tobytes())
            if first is not None:
                turns += n - (1 if high == first else 0)
                low, high = first if low is None else low, last
        found = judged(b"".join(pieces))
        audit = found["audit"]
        consuming = np.flatnonzero(np.frombuffer(audit.encode(), np.uint8) != ord("I"))
        out, state, done, at = [], START, 0, 0
        for i, (row, symbols) in enumerate(zip(rows, pieces, strict=True)):
            done += len(symbols)
            end = len(audit) if i + 1 == len(rows) else at if not symbols else int(consuming[done - 1]) + 1
            figures = (gaps(low, high, turns), *found.values()) if i == 0 else (None,) * 7
            out.append((*row[:3], i == 0, state, audit[at:end], symbols, *figures))
            for _, _, state in replay(audit[at:end], state, [s >> 2 for s in symbols]):
                pass
            at = end
        return pa.table(arrays(out, types), names)

    schema = f"conv {kind.simpleString()}, part int, seq int, head boolean, entry int, edits string, fixed binary, {FIGURE_SCHEMA}"
    return split.groupBy("conv").applyInArrow(together, schema)


def _with_edits(table: DataFrame, plan: DataFrame) -> DataFrame:
    """Texts of all chunks; those of open conversations with their edits, the others are solved where they are read."""
    whole = table.where("NOT open").select(
        "conv", "open", "part", "seq", F.lit(START).alias("entry"), F.lit(None).cast("string").alias("edits"), F.col("symbols").alias("fixed"), "low", "high", "turns", "roles", "texts"
    )
    texts = table.where("open").select("conv", "open", "part", "seq", "low", "high", "turns", "roles", "texts")
    split = texts.join(plan.select("part", "seq", "entry", "edits", "fixed"), ["part", "seq"])
    return whole.unionByName(split.select(*whole.columns))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns that the cheapest repair leaves: ``conv_id, part, seq, place, role, text, edit`` (the letter of its edit).

    ``rows`` as in ``repair_report``. ``part, seq, place`` order the turns of a conversation.
    """
    table = chunks(rows)
    kind = table.schema["conv"].dataType
    types = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "part", "seq", "place", "role", "text", "edit"]

    def run(batches):
        for batch in batches:
            for conv, _, part, seq, entry, edits, fixed, _, _, _, roles, texts in rows_of(batch):
                edits = judged(fixed)["audit"] if edits is None else edits
                out = [(conv, part, seq, i + 1, *t) for i, t in enumerate(repaired(edits, entry, fixed, roles, texts))]
                if out:
                    yield pa.RecordBatch.from_arrays(arrays(out, types), names)

    schema = f"conv_id {kind.simpleString()}, part int, seq int, place int, role string, text string, edit string"
    return _with_edits(table, open_edits(table)).mapInArrow(run, schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has ``conv_id, turn, role, text, copies``; other columns are not read. A null conversation is one of its own.
    Rows with 0 copies only name their conversation: without others it has zeros, no audit and the digest of nothing. Turns
    that are equal are ordered by role, then text; a null turn comes first. A role whose first letter is none of s, u and a
    (the empty one too) has to be given to another speaker or go. Texts are compared and hashed whole; two rows are
    duplicates when a 128-bit digest of role and text agrees. An empty table gives no rows.
    """
    table = chunks(rows)
    kind = table.schema["conv"].dataType
    plan = stored(open_edits(table), "conversation-edits")
    types = [to_arrow_type(kind), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *FIGURE_TYPES]
    names = ["conv", "open", "part", "seq", "n", "piece", *FIGURES]

    def lines(batches):
        for batch in batches:
            out = []
            for conv, is_open, part, seq, entry, edits, fixed, low, high, turns, roles, texts in rows_of(batch):
                figures = (None,) * 7
                if edits is None:
                    found = judged(fixed)
                    edits, figures = found["audit"], (gaps(low, high, turns), *found.values())
                said = [f"{role}:{text}" for role, text, _ in repaired(edits, entry, fixed, roles, texts)]
                whole = "\n".join(said).encode()
                out.append((conv, is_open, part, seq, len(said), whole if is_open else hashlib.sha256(whole).hexdigest().encode(), *figures))
            if out:
                yield pa.RecordBatch.from_arrays(arrays(out, types), names)

    schema = f"conv {kind.simpleString()}, open boolean, part int, seq int, n int, piece binary, {FIGURE_SCHEMA}"
    pieces = stored(_with_edits(table, plan).mapInArrow(lines, schema), "conversation-lines")
    alone = pieces.where("NOT open").select(F.col("conv").alias("conv_id"), *FIGURES, F.col("piece").cast("string").alias("repaired_sha256"))
    streamed = stream_digest(pieces.where("open AND n > 0"), ["conv"], ["part", "seq"], "piece", b"\n").withColumnRenamed("conv", "conv_")
    heads = plan.where("head").join(streamed, F.col("conv").eqNullSafe(F.col("conv_")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return alone.unionByName(heads.select(F.col("conv").alias("conv_id"), *FIGURES, F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256")))
