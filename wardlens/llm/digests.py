"""SHA-256 of groups of any size: rows are packed in order where they lie, and what spans tasks is hashed as a stream of packs."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardlens.session import ship_by_value, stored

ship_by_value(__name__)

#: Bytes that a pack holds before the next one begins, rows sent back at a time.
PACK_BYTES, BATCH_ROWS = 1_000_000, 10_000


def arrays(rows: list[tuple], types: list) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]


def stream_digest(pieces: DataFrame, keys: list[str], order: list[str], piece: str, between: bytes) -> DataFrame:
    """``keys, sha256`` of each key's pieces in order, joined by ``between``: one pass that holds a hash state and no text.

    A digest of one key is sequential by nature; what reaches its task is a row per piece.
    """
    kinds = [pieces.schema[k].dataType for k in keys]
    ordered = pieces.select(*keys, *order, piece).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        held, state, out = None, None, []

        def packed():
            return pa.RecordBatch.from_arrays(arrays([(*k, d) for k, d in out], [*map(to_arrow_type, kinds), pa.string()]), [*keys, "sha256"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for key, data in zip(zip(*columns, strict=True), batch.column(len(keys) + len(order)).to_pylist(), strict=True):
                if state is None or key != held:
                    if state is not None:
                        out.append((held, state.hexdigest()))
                        if len(out) >= BATCH_ROWS:
                            yield packed()
                            out = []
                    held, state = key, hashlib.sha256(data)
                else:
                    state.update(between)
                    state.update(data)
        if state is not None:
            out.append((held, state.hexdigest()))
        if out:
            yield packed()

    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in zip(keys, kinds, strict=True))
    return ordered.mapInArrow(run, f"{schema}, sha256 string")


def group_digest(rows: DataFrame, key: str, order: str, piece: str, between: bytes) -> DataFrame:
    """``key, sha256`` of the pieces (binary) of every key in order, joined by ``between``; the key is not null.

    Rows are dealt by ranges of (key, order), so a key of any size is spread. A key that lies inside one task and one pack
    is hashed there; of the others a row per pack goes on.
    """
    kind = rows.schema[key].dataType
    ordered = rows.select(key, order, piece).repartitionByRange(key, order).sortWithinPartitions(key, order)
    names, types = [key, "part", "seq", "open", "data"], [to_arrow_type(kind), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        at, held, size, first, several, out = None, [], 0, True, False, []

        def pack(is_open):
            nonlocal seq, held, size
            whole = between.join(held)
            out.append((at, part, seq, is_open, whole if is_open else hashlib.sha256(whole).hexdigest().encode()))
            seq, held, size = seq + 1, [], 0

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and k != at:
                    pack(first or several)
                    first = several = False
                elif held and size >= PACK_BYTES:
                    pack(True)
                    several = True
                at = k
                held.append(data)
                size += len(data) + len(between)
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays(arrays(out, types), names)
                    out.clear()
        if held:
            pack(True)
        if out:
            yield pa.RecordBatch.from_arrays(arrays(out, types), names)

    packs = stored(ordered.mapInArrow(run, f"{key} {kind.simpleString()}, part int, seq int, open boolean, data binary"), "digest-packs")
    done = packs.where("NOT open").select(key, F.col("data").cast("string").alias("sha256"))
    return done.unionByName(stream_digest(packs.where("open"), [key], ["part", "seq"], "data", between))
