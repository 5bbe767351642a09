import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diagtab.llm import periodic
from diagtab.llm.queries import op12_periodic_runs


def every_run(words, least=24, exponent=3):
    """Runs by comparing all words at every distance."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        first = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                first = i if first is None else first
            elif first is not None:
                length = i + q - first
                if length >= max(least, exponent * q):
                    found.setdefault((first, length), q)  # the smallest period comes first
                first = None
    return sorted((s, n, q) for (s, n), q in found.items())


def kept_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def searched(texts):
    before = np.cumsum([0, *map(len, texts)])
    ids = {}
    names = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for s, n, q in periodic.find_runs(names, before):
        doc = int(np.searchsorted(before, s, "right")) - 1
        out[doc].append((s - int(before[doc]), n, q))
    return out


def thue_morse(n):
    return ["ab"[bin(i).count("1") & 1] for i in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_all_runs_of_random_texts(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(rnd.randint(1, 5)):
        text = []
        for _ in range(rnd.randint(0, 6)):
            piece = [rnd.choice("abcdefgh"[:rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 30))]
            times = rnd.choice((1, 1, 2, 3, 4, 9))
            text += (piece * times)[:len(piece) * times - rnd.randint(0, len(piece) - 1)]
        texts.append(text)
    assert searched(texts) == [every_run(t) for t in texts]


def test_runs_side_by_side_nested_and_across_texts():
    ab, inner = list("ab") * 20, (list("aaaaaaaaaaaaaaaaaaaaaaaaab") * 3)
    texts = [ab, ab, list("ab") * 12, list("ab") * 11 + ["a"], ab + list("cd") * 15, inner, ["x"] * 24, ["x"] * 23, [],
             thue_morse(512), ["b"] + ab + ["b"] * 30 + ab, list("abcdefghij") * 2 + list("abcdefghij")]
    assert searched(texts) == [every_run(t) for t in texts]
    assert searched(texts)[5] and len(searched(texts)[5]) == 4


def test_one_word_a_million_times():
    assert searched([["x"] * 10**6]) == [[(0, 10**6, 1)]]


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = every_run(words) if n <= 3000 else searched([words])[0]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = b" ".join(kept_words(words, runs))
        out.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_query_against_plain_python(spark, rows, docs, tmp_path):
    docs.drop("id", "row", "n", "score", "size", "at", "key").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = expected([(r[0], r[1]) for r in rows])
    assert sorted(got, key=repr) == want
    assert sum(r[1] for r in want) > 5


def test_clashing_columns_and_empty_tables(docs, no_docs, rows):
    got = periodic.collapse_runs(docs.withColumnRenamed("at", "runs").withColumnRenamed("key", "kept"))
    assert got.count() == len(rows) and got.columns == ["doc_id", "n_words", "runs", "kept"]
    assert periodic.collapse_runs(no_docs).collect() == []


@pytest.mark.parametrize("text", [None, "", " \t\n "])
def test_texts_without_words(spark, text):
    row = periodic.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row) == (1, 0, [], "")
