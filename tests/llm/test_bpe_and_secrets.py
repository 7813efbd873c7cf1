import base64
import hashlib
import json
import re
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import LONG, ODD
from wardlens.llm import bpe, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbB'sdmlrvet 12ÀéΣσςİ\x1c\x85\xa0​!?%漢字한🙂\t\n<|>endoftext"), max_size=40))
def test_encoder_equals_library(text):
    encode, found = bpe.encoder(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)
    for t in (text, f"{text}<|endoftext|>{text}"):
        assert list(array("I", encode(t))) == found.encode(t, add_special_tokens=False).ids


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    few = bpe.encoder(bpe.read_vocabulary(PATH))
    monkeypatch.undo()
    many = bpe.encoder(bpe.read_vocabulary(PATH))
    assert few(LONG) == many(LONG)


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100_000)
    pieces = bpe.Pieces(bpe.read_vocabulary(PATH))
    for i in range(600):
        assert pieces[f"{'x' * 200}{i}"] == pieces.merged(f"{'x' * 200}{i}")
    assert pieces["y" * 5_000] == pieces.merged("y" * 5_000)
    kept = [*pieces.items(), *pieces.older.items()]
    assert kept and sum(len(piece) + len(ids) + bpe.PLACE_BYTES for piece, ids in kept) <= 100_000
    assert max(len(piece) for piece, _ in kept) < 5_000


def test_both_ways_take_one_worker(make_docs):
    rows = make_docs([*ODD, (30, "Don't <|startoftext|> STOP")])
    both, apart = bpe.encode(rows, PATH, and_decode=True), bpe.decode(bpe.encode(rows, PATH), PATH)
    assert both.columns == apart.columns and sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
    plan = bpe.round_trip(rows, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_round_trip_query(make_docs, library):
    rows = [*ODD, (30, "Don't <|startoftext|> STOP"), (31, "x" * 30_000)]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(make_docs(rows), PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(make_docs(rows).where("false"), PATH).count() == 0


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, b"".join(map(number, [0, 3**200, 65537, 5**100, 7**60, 11**50, 13**30, 17**30, 19**30])))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, bytes([42, 134, 72]))) + der(4, bytes(range(64))))
EC = der(0x30, number(1) + der(4, bytes(32)) + der(0xA0, der(6, bytes([42, 134]))))
field = lambda b: len(b).to_bytes(4, "big") + b
SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(bytes(40)) + field(bytes(60))


def part(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


@pytest.mark.parametrize("key", [RSA, PKCS8, EC, SSH])
def test_keys_are_confirmed_in_every_form(key):
    text = base64.b64encode(key).decode()
    assert [s[1] for s in secrets.confirmed_spans(f"x {text} y")] == [4] or not text.startswith(("M", "b3B"))
    assert [(s[1], s[0], s[2]) for s in secrets.confirmed_spans(f"é {key.hex()}.")] == [(5, 2, 2 + 2 * len(key))]
    lines = "\n".join(re.findall(".{1,64}", text))
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    assert (3, len(pem)) in [(s[1], s[2]) for s in secrets.confirmed_spans(pem)]


@pytest.mark.parametrize("spoilt", [RSA[:-1], RSA + b"x", b"\x30\x82\xff\xff" + RSA[4:], bytes(200), b"0" * 100])
def test_broken_structures_are_not_reported(spoilt):
    assert secrets.confirmed_spans(base64.b64encode(spoilt).decode()) == []
    assert secrets.confirmed_spans(spoilt.hex()) == []


def test_signed_tokens():
    good = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    assert secrets.written(secrets.confirmed_spans(f"a {good} b")) == f"token:2:{2 + len(good)}"
    assert secrets.confirmed_spans(f"{part({'a': 1})}.{part({'sub': '1'})}.x") == []


def plain_spans(text):
    """The base patterns written out, without the shortcuts of the operator."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "Paßword", "PASSWORD", "ſecret", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "x"]), max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert sorted(secrets.base_spans(text)) == sorted(plain_spans(text))


def test_scan_query(make_docs):
    rows = [*ODD, (40, "é token = abcdef12 AKIA" + "B" * 16 + " " + "0a" * 12), (41, "secret: short")]
    got = {(r.doc_id, r.base_spans, r.n_assign, r.n_access, r.n_hex) for r in secrets.scan(make_docs(rows)).collect()}
    want = set()
    for i, t in rows:
        spans = plain_spans(t or "")
        want.add((i, secrets.written(spans), *[sum(s[1] == k for s in spans) for k in range(3)]))
    assert got == want
    assert secrets.scan(make_docs(rows).where("false")).count() == 0
