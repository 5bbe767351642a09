import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diagtab.llm import substrings as S


def expected(rows):
    """(n_words, n_removed, kept) per row: words of windows that start in a text of a smaller id."""
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - 49) if doc is not None else ():
            window = tuple(words[k:k + 50])
            first[window] = min(first.get(window, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = bytearray(len(words))
        for k in range(len(words) - 49) if doc is not None else ():
            if first[tuple(words[k:k + 50])] < doc:
                gone[k:k + 50] = b"\1" * 50
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=repr)


def test_whole_table_against_windows(docs, rows):
    got = [tuple(r) for r in S.drop_repeats(docs).collect()]
    want = expected([(r[0], r[1]) for r in rows])
    assert sorted(got, key=repr) == want
    assert sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("letters", [1024, 4096])
def test_words_that_collide_under_polynomials(spark, letters):
    """Words and word patterns whose sums modulo 2^64 are equal for every base are told apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(letters))
    other = word.translate(str.maketrans("ab", "ba"))
    rnd = random.Random(6)
    first, last = ([f"w{rnd.random()}" for _ in range(n)] for n in (30, 29))
    pattern, inverse = ([x[(bin(i).count("1") & 1) ^ k] for i in range(letters)] for k in (0, 1) for x in [("yes", "no")])
    rows = [(1, " ".join([*first, word, *last])), (2, " ".join([*first, other, *last])), (3, " ".join(["x", *pattern, "y"])),
            (4, " ".join(["z", *inverse, "y"])), (5, " ".join([*first, other, *last]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.drop_repeats(docs).collect()), key=repr)
    assert got == expected(rows) and [r[2] for r in got[:2]] == [0, 0] and got[4][2] == 60


def test_rows_of_one_id_with_equal_32_bit_digests(spark):
    """Rows of one id are told apart by 64 bits of their texts."""
    rnd = random.Random(7)
    passage = " ".join(f"p{rnd.random()}" for _ in range(60))
    rows = [(1, passage), *[(2, f"n{i} {passage} {i}" if i % 2 else f"own{i} " * 60) for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.drop_repeats(docs).collect()), key=repr) == expected(rows)


def test_empty(no_docs):
    assert S.drop_repeats(no_docs).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(50, 90))
def test_equal_passages_have_equal_anchors(seed, letters, length):
    """A passage has the same anchor and window digests in any surroundings, long runs and periods included."""
    rnd = random.Random(seed)
    passage = [rnd.choice("abcdef"[:letters]) for _ in range(length)]
    if seed % 3 == 0:
        passage = (passage[:rnd.randint(1, 5)] * length)[:length]
    found = []
    for _ in range(2):
        before = [rnd.choice("abcdefxyz") for _ in range(rnd.randint(0, 60))]
        text = " ".join(before + passage + [rnd.choice("abcxyz") for _ in range(rnd.randint(0, 60))]).encode()
        names, counts = S.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0)
        starts = np.arange(len(names) - 49)
        digests = S.Sequence(names, S._WORD1).digest(starts, starts + 50)
        anchor, _ = S.anchors(names, counts, starts, digests)
        found.append((anchor[len(before):len(before) + length - 49], digests[len(before):len(before) + length - 49]))
    assert (found[0][0] == found[1][0]).all() and (found[0][1] == found[1][1]).all()


def test_words_do_not_run_into_the_next_text():
    texts = [b"ab c", b"", b"d  e", b" ", b"f"]
    offsets = np.cumsum([0, *map(len, texts)])
    names, before = S.words_of(np.frombuffer(b"".join(texts), np.uint8), offsets, 0)
    assert before.tolist() == [0, 2, 2, 4, 4, 5]
    alone = [S.words_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]), 0)[0][0] for w in (b"ab", b"c", b"d", b"e", b"f")]
    assert names.tolist() == alone
