import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diagtab.llm import tokencount as T

public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")
PROCESSOR = T._loaded(MODEL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\t", "\r", "▁", "é", "①", "\x00", "<s>", "</s>", "<0x0A>", ");\r", "the", "ing"]),
                          st.text(st.characters(exclude_categories=["Cs"]), max_size=3)), max_size=16))
def test_sums_over_pre_tokens(parts):
    text = "".join(parts)
    assert sum(T.lengths(PROCESSOR, T.pre_tokens(text))) == len(PROCESSOR.encode(text))


@pytest.mark.parametrize("table", [4, 32768])
def test_whole_table(docs, rows, table):
    got = sorted([(r.doc_id, r.text, r.n_tokens) for r in T.count_tokens(docs, MODEL, table, 100).collect()], key=repr)
    assert got == sorted([(r[0], r[1], len(PROCESSOR.encode(r[1] or ""))) for r in rows], key=repr)


def test_pieces_across_words_fall_back_to_whole_texts(docs, rows, monkeypatch):
    monkeypatch.setattr(T, "splits_at_words", lambda _: False)
    got = sorted([(r.doc_id, r.text, r.n_tokens) for r in T.count_tokens(docs, MODEL).collect()], key=repr)
    assert got == sorted([(r[0], r[1], len(PROCESSOR.encode(r[1] or ""))) for r in rows], key=repr)


def test_empty(no_docs):
    assert T.count_tokens(no_docs, MODEL).collect() == []


def test_model_is_not_in_the_repository():
    assert not os.path.abspath(MODEL).startswith(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) + os.sep)
