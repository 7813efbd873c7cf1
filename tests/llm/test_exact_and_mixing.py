import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from wardlens.llm import exact, mixing


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    out = []
    for i, t, *_ in rows:
        members = groups[normal(t)]
        keep = min((m for m in members if m is not None), default=None)
        out.append((i, keep, len(members), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("content_hash", [exact.hash128, lambda body: F.crc32(body.cast("binary")) % 3])
def test_exact_groups(make_docs, content_hash):
    rows = [*ODD, (9, "x  y"), (10, "x\ty"), (11, "x y "), (12, "É"), (13, "é"), (None, "only")]
    got = [tuple(r) for r in exact.exact_groups(make_docs(rows), content_hash=content_hash).collect()]
    assert sorted(got, key=repr) == expected_groups(rows)


def test_exact_dedup_keeps_one_row_per_text(make_docs):
    docs = make_docs([*ODD, (None, "only"), (None, "only"), (20, "b"), (20, "c")])
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, normal(r.text)) for r in kept.collect()), key=repr)
    texts = [t for _, t in got]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t in ODD}) + 3
    assert (1, "") in got and (4, "a") in got and (20, "b") in got and (20, "c") in got and (None, "only") in got


def test_empty_tables(make_docs):
    empty = make_docs([(1, "a")]).where("false")
    assert exact.exact_groups(empty).count() == 0
    assert exact.exact_dedup(empty).count() == 0
    assert mixing.mix_report(empty).count() == 0
    assert mixing.mix_rows(empty).count() == 0


def water(sizes, weights, share, most):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def test_mix_targets_and_takes(make_docs):
    rows = [(i, "w " * (i % 17), "abcdefg"[i % 7] if i % 11 else None) for i in range(600)]
    rows += [(i, "hot words here", "a") for i in range(600, 1000)] + [(1000, None, "zero"), (None, "no id", "b"), (7, "repeat", "a"), (7, "repeat", "a")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = water(dict(sizes), (3, 1, 2), 1.5, 2.0)
    docs = make_docs(rows)
    report = mixing.mix_report(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in mixing.mix_report(docs).collect():
        assert r.taken <= 2 * r.size
    for r in report:
        assert r.target == pytest.approx(targets[r.source]) or r.doc_id == 7
    for r in mixing.mix_rows(docs).collect():
        taken[r.source] += len((r.text or "").split())
    for _, t, s in rows:
        largest[s] = max(largest[s], len((t or "").split()))
    for s, target in targets.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-9
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_is_repeatable_and_keeps_columns(make_docs):
    docs = make_docs([(i, "w " * (i % 5), "ab"[i % 2]) for i in range(50)])
    one, two = (sorted(map(tuple, mixing.mix_report(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == two
    assert mixing.mix_rows(docs).columns == docs.columns
