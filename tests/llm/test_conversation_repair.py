import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlens.llm import conversation_repair as repair
from wardlens.llm.queries import QUERIES

GOAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"


def brute(rows):
    """Cheapest edits of (initial, fault) rows by trying all, up to two inserts at every place."""
    best = None
    options = []
    for kind, fault in rows:
        must, extra = fault >= 2, 1 if fault == 1 else 0
        keep = [] if must else [("K", extra, kind), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
        options.append([("D", 3, ""), *keep])
    inserts = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            made = "".join("".join(g) + e[2] for g, e in zip(gaps, [*edits, ("", 0, "")], strict=True))
            if GOAL.fullmatch(made):
                cost = sum(e[1] for e in edits) + 2 * sum(map(len, gaps))
                audit = "".join("I" * len(g) + e[0] for g, e in zip(gaps, [*edits, ("", 0, "")], strict=True))
                if best is None or (cost, audit) < best:
                    best = cost, audit
    return best


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suao"), st.integers(0, 3)), max_size=3))
def test_cheapest_edits_equal_brute_force(rows):
    symbols = bytes("suao".index(kind) * 4 + fault for kind, fault in rows)
    assert repair.solve(symbols) == brute(rows)


def step_by_step(symbols):
    """The same programme row by row, without runs and powers."""
    ahead = [repair.ENDS]
    for s in reversed(symbols):
        ahead.append(repair.advance(repair.power(s, 0), ahead[-1]))
    ahead.reverse()
    state, out = repair.START, []
    for s, after in zip(symbols, ahead[1:], strict=True):
        state = repair.unroll(s, 1, state, after, out)
    return ahead[0][repair.START], "".join(out) + "I" * (repair.ENDS[state] // 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(1, 70)), max_size=5))
def test_powers_equal_single_steps(runs):
    symbols = b"".join(bytes([s]) * n for s, n in runs)
    assert repair.solve(symbols) == step_by_step(symbols)


def expected(conversations):
    """The contract in plain Python, for any number of rows of each conversation."""
    out = {}
    for conv, turn, role, text in conversations:
        out.setdefault(conv, [])
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fate = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv] += [(turn is not None, turn or 0, role, text)] * (2 if fate == 3 else 1)
    found = {}
    for conv, rows in out.items():
        rows.sort()
        seen, symbols = set(), []
        for _, _, role, text in rows:
            body = text.rstrip(SPACE)
            fault = 2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            seen.add((role, text))
            symbols.append((role[:1] if role[:1] and role[0] in "sua" else "o", fault))
        cost, audit = step_by_step(bytes("suao".index(k) * 4 + f for k, f in symbols))
        left, at, last = [], 0, ""
        for letter in audit:
            other = "user" if last != "u" else "assistant"
            if letter == "I":
                left.append((other, ""))
            else:
                if letter == "K":
                    left.append(rows[at][2:])
                elif letter == "R":
                    left.append((other, rows[at][3]))
                at += 1
            last = left[-1][0][0] if left else ""
        assert at == len(rows) and GOAL.fullmatch("".join(r[0] for r, _ in left))
        turns = {t for known, t, _, _ in rows if known}
        pairs = ["".join(p) for p in itertools.pairwise(k for k, _ in symbols)]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[sum(f == i for _, f in symbols) for i in (2, 3, 1)],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(), left,
        )
    return found


def frame(spark, rows):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return made.withColumns({c: F.lit(1) for c in ("conv", "part", "seq", "open", "symbols", "copies", "audit", "place", "digest")})


ODD = [
    *[(1, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(9)],
    *[(2, i, "user", "the same") for i in range(200)],
    *[(3, None, r, t) for r, t in (("user", "a."), ("assistant", "b"), (None, None), ("tool", "c!"), ("", "d?"))],
    (4, 5, "system", None), (5, 7, "system", "Only."), (None, 1, "user", "Who?"), (None, None, "assistant", "x"),
    (6, 1, "user", "tie."), (6, 1, "user", "tie."), (6, 1, "assistant", "tie."), (6, 9, "assistant", "far\n"),
    *[(7, i * 3, ("user", "assistant", "system", "User")[i % 4], f"text {i % 17}" + ".!"[i % 2] * (i % 3)) for i in range(500)],
    (8, 0, "user", "long. " * 50_000), (8, 1, "assistant", "ä" * 100_000 + "."),
    *[(100 + i, j, "ua"[j % 2], "Yes.") for i in range(40) for j in range(2)],
]


@pytest.mark.parametrize("rows,size", [(4_096, 1_000_000), (7, 50)])
def test_report_equals_plain_python(spark, monkeypatch, rows, size):
    monkeypatch.setattr(repair, "CHUNK_ROWS", rows)
    monkeypatch.setattr(repair, "CHUNK_BYTES", size)
    damaged = repair.damage(frame(spark, ODD))
    want = expected(ODD)
    got = repair.repair_report(damaged)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {c: v[:-1] for c, v in want.items()}
    turns = {}
    for r in sorted(repair.repaired_turns(damaged).collect(), key=lambda r: (r["part"], r["seq"], r["place"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: v[-1] for c, v in want.items() if v[-1]}


def test_empty_table(spark):
    assert repair.repair_report(repair.damage(frame(spark, ODD).where("false"))).count() == 0


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert got == {c: v[:-1] for c, v in expected(rows).items()}
