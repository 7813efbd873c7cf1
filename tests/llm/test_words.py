import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from wardlens.llm import minhash, substrings, suffix_tree
from wardlens.llm.words import Words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB \té漢\n", max_size=60), min_size=1, max_size=6))
def test_hashes_tell_words_and_texts_apart(texts):
    for lower in (False, True):
        words = Words(pa.array(texts), lower)
        fold = lambda t: t.translate({i: i + 32 for i in range(65, 91)}) if lower else t  # noqa: B023, E731
        said = [w for t in texts for w in fold(t).split()]
        assert len(words) == len(said)
        for hashes in (words.hash, words.other):
            assert len(set(zip(said, hashes.tolist(), strict=True))) == len(set(said)) == len(set(hashes.tolist()))
        whole = words.texts().tolist()
        rows = [tuple(fold(t).split()) for t in texts]
        assert len(set(zip(rows, whole, strict=True))) == len(set(rows)) == len(set(whole))


def test_patterned_words_and_texts():
    made = ["".join(thue_morse(n, a, b)) for n in (64, 256, 512, 513, 1_024, 4_096) for a, b in ("ab", "ba")]
    made += [" ".join(thue_morse(4_096, a, b)) for a, b in ("ab", "ba")]
    words = Words(pa.array(made[:-2]))
    assert len(set(words.hash.tolist())) == len(set(words.other.tolist())) == len(made) - 2
    assert len(set(Words(pa.array(made)).texts().tolist())) == len(made)
    assert np.array_equal(Words(pa.array(["x " + made[0]])).hash[1:], words.hash[:1])


def test_patterned_words_in_operators(make_docs):
    one, two = ("".join(thue_morse(1_024, a, b)) for a, b in ("ab", "ba"))
    rows = [(1, " ".join([one] * 50)), (2, " ".join([two] * 50)), (3, " ".join(thue_morse(2_048, "a", "b"))), (4, " ".join(thue_morse(2_048, "b", "a")))]
    docs = make_docs(rows)
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs, window=50).collect()}
    assert removed[1] == removed[2] == 0
    assert all(r.component_id == r.doc_id for r in minhash.near_groups(docs.where("doc_id < 3"), shingle=4, percent=80).collect())
    known = {r.doc_id: r.n_known for r in suffix_tree.score(docs.where("doc_id < 3"), held_out=docs["doc_id"] == 2).collect()}
    assert known == {1: 51, 2: 1}


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import corpus_pipeline
from wardlens.llm.queries import QUERIES
from wardlens.session import get_spark
spark = get_spark(master="local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.checkpoint.dir": sys.argv[3]})
spark.sparkContext.setLogLevel("ERROR")
try:
    spark.range(1).rdd.map(lambda _: __import__("wardlens")).count()
    raise SystemExit("workers see the package")
except Exception as e:
    assert "No module named" in str(e), e
for name, build in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
    assert build(spark, sys.argv[2]).count() > 0, name
    print("ran", name)
"""


@pytest.mark.filterwarnings("ignore")
def test_executors_without_the_package(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, SMALL, str(tmp_path)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3_000:]
    assert done.stdout.count("ran ") == 14
