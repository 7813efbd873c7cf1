import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import LONG, ODD
from wardlens.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
COUNT = token_counts.counter(token_counts.merge_table(PATH))


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbB'sdmlrvet 12ÀéΣς\x1c\x85\xa0 ​!?%漢字한🙂\t\n<|>endoftext"), max_size=60))
def test_counts_equal_library(text):
    for t in (text, f"{text}<|endoftext|>{text}"):
        assert COUNT(t) == library(t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_letters(text):
    assert COUNT(text) == library(text)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED_LETTERS", 100)
    few = token_counts.counter(token_counts.merge_table(PATH))
    assert few(LONG) == COUNT(LONG) == library(LONG)


def test_query_rows(make_docs):
    rows = [*ODD, (30, "<|endoftext|>x <|endoftext|>"), (31, "ab" * 20_000), (32, " " * 5_000 + "z")]
    want = sorted([(i, len((t or "").encode()), library(t or ""), library(t or "") > 1024) for i, t in rows], key=repr)
    got = token_counts.token_counts(make_docs(rows), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    assert token_counts.token_counts(make_docs(rows).where("false"), PATH).count() == 0
