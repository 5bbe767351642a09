import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diagtab.llm import collocations as C
from diagtab.llm.queries import op11_collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, keep=2000):
    """Collocations of (lang, text) rows from counters of tuples."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                own.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: c for p, c in f.items() if len(p) >= 2 and c >= least}
        gone = {p[i:j] for p, c in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and f[p[i:j]] == c}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def sentences(rnd, n):
    vocabulary = ["New", "york", "city", "of", "the", "aé", "É", "x" * 90, "in", "and", "1", "-", "\x00", "\x1f"]
    out = []
    for _ in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.4:
            words[2:2] = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"][:rnd.randint(2, 6)]
        out.append("".join(w + rnd.choice((" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0c")) for w in words))
    return out


@pytest.mark.parametrize("chunk", [200, 1 << 23])
def test_against_counters(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "HELD", 50)
    rnd = random.Random(chunk)
    texts = sentences(rnd, 220) + ["", " ", None, ".", "the " * 900, " ".join(["New york"] * 300)]
    rows = [(i if i % 7 else None, t, (None, "en", "en", "en", "de", "")[i % 6], 1, "n", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[8], (3, "another text of the same id", "en", 1, "n", 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k long, t string, n int, c int").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(docs, least=4).collect())
    want = brute([(r[2], r[1]) for r in rows], 4)
    assert got == want and len(want) > 60
    assert sorted(tuple(r) for r in C.collocations(docs, least=4, longest=3, keep=5).collect()) == brute([(r[2], r[1]) for r in rows], 4, 3, 5)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """All words have one of three values, so that nearly all fingerprints collide."""
    monkeypatch.setattr(C, "value_of", lambda word: len(word) % 3 + 1)
    monkeypatch.setattr(C, "CHUNK", 300)
    rnd = random.Random(9)
    rows = [(i, t, "en") for i, t in enumerate(sentences(rnd, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in C.collocations(docs, least=4).collect())
    assert got == brute([(r[2], r[1]) for r in rows], 4) and got


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op11_collocations(spark, folder).collect()) == brute(rows, 100)


def test_empty(no_docs):
    assert C.collocations(no_docs).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, C.PRIME - 1), min_size=1, max_size=40), st.integers(0, C.PRIME - 1))
def test_arithmetic_modulo_the_prime(values, other):
    a, b = np.array(values, np.uint64), np.full(1, other, np.uint64)
    assert C.times(a, b).tolist() == [v * other % C.PRIME for v in values]
    prefix = C.Prefix(a)
    for n in range(1, min(5, len(values)) + 1):
        at = np.arange(len(values) - n + 1)
        got = prefix.fingerprints(at, n, np.zeros(len(at), np.uint64)).tolist()
        salt = n * 0x9E3779B97F4A7C15 % C.PRIME
        assert got == [(sum(v * pow(C.BASE, k, C.PRIME) for k, v in enumerate(values[i:i + n])) + salt) % C.PRIME for i in range(len(got))]
