"""Secret scan: patterns propose, structure confirms.

Base patterns report what they match. Further spans are reported only when a
base64 or hex candidate decodes to something with the structure of a secret:
a private key whose nested lengths add up, or a signed token whose header and
payload are JSON. One Arrow pass, no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.session import ship_by_value

ship_by_value(__name__)

# The kinds in report order and their patterns. Letters of ASCII only, in either case where (?i:) says so.
KINDS = ("assign", "access", "hex", "pem", "key64", "keyhex", "token")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
ANY_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){20,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
WORDS = ("password", "passwd", "secret", "token", "api")
OPENSSH = b"openssh-key-v1\0"
OPENSSH64 = base64.b64encode(OPENSSH).decode()


def elements(data: bytes, start: int, end: int):
    """Tag, content start and content end of each element of a DER sequence; ValueError if lengths do not add up."""
    while start < end:
        if start + 2 > end:
            raise ValueError("short element")
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            width = length & 0x7F
            if not 0 < width <= 4 or at + width > end:
                raise ValueError("bad length")
            length, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + length > end:
            raise ValueError("element passes its parent")
        yield tag, at, at + length
        start = at + length


def is_der_key(data: bytes) -> bool:
    """A sequence that fills the data and has the parts of a private key.

    Either a version, an algorithm with an object id and an octet string (PKCS 8), or at least nine integers
    (RSA), or six (DSA), or a version, an octet string of 16 bytes or more and tagged parameters (EC).
    """
    try:
        ((tag, start, end),) = elements(data, 0, len(data))
        if tag != 0x30:
            return False
        inner = list(elements(data, start, end))
        tags = [t for t, _, _ in inner]
        if not tags or tags[0] != 0x02 or inner[0][2] - inner[0][1] != 1:
            return False
        if len(inner) >= 6 and all(t == 0x02 and e > s for t, s, e in inner):
            return True
        if tags[1:3] == [0x30, 0x04]:
            return next(elements(data, *inner[1][1:]))[0] == 0x06 and inner[2][2] > inner[2][1]
        return len(tags) >= 3 and tags[1] == 0x04 and inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    except (ValueError, StopIteration):
        return False


def is_openssh_key(data: bytes) -> bool:
    """The mark, then three length-prefixed fields, a count of keys and that many public keys, each within the data."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def field() -> bool:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return at <= len(data) and at - size >= 4

    if not all(field() for _ in range(3)) or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 0 < count <= 64 and all(field() for _ in range(count + 1))


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def from_base64(text: str) -> bytes:
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return b""


def json_part(text: str) -> dict:
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns; cheap word tests spare the patterns most texts."""
    found = []
    if (":" in text or "=" in text) and any(map(text.lower().__contains__, WORDS)):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if is_key(from_base64(re.sub(r"\s+", "", m[2]))):
                found.append((m.start(), 3, m.end()))
    for m in BASE64.finditer(text):
        body = m[0]
        # A sequence tag and a length of 16 or more encode to M and B to I; other candidates need no decoding.
        if (body[0] == "M" and "B" <= body[1] <= "I" or body.startswith(OPENSSH64)) and is_key(from_base64(body + "=" * (-len(body) % 4))):
            found.append((m.start(), 4, m.end()))
    for m in ANY_HEX.finditer(text):
        if is_key(bytes.fromhex(m[0])):
            found.append((m.start(), 5, m.end()))
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            header = json_part(m[1])
            if isinstance(header.get("alg"), str) and json_part(m[2]):
                found.append((m.start(), 6, m.end()))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: ``id, n_assign, n_access, n_hex, n_confirmed, base_spans, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind in the order of ``KINDS``. Base
    matches are leftmost and do not overlap within a kind; one that is too short is dropped. ``spans`` holds the base
    spans and the confirmed ones. Null and empty texts have none. Texts are scanned whole; rows are independent, so
    repeated rows and rows without ids need no rule. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_spans", "spans"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                base, more = [], []
                for text in part.column("text").to_pylist():
                    base.append(base_spans(text))
                    more.append(confirmed_spans(text))
                counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), *counts, pa.array([len(x) for x in more], pa.int64()),
                        pa.array(map(written, base), pa.string()), pa.array([written(a + b) for a, b in zip(base, more, strict=True)], pa.string()),
                    ],
                    names,
                )

    schema = f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_spans string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
