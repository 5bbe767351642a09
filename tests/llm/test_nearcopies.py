"""Groups of near copies against plain Python over all pairs."""

import random
import re

import corpus_pipeline as P
import numpy as np
import pytest
from conftest import prose
from test_simhash import groups

from diagtab.llm import nearcopies as N


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.fixture(scope="module")
def copies(spark, vocabularies):
    """Texts, each with copies in which a few words differ: near ones, and ones that are far enough."""
    rnd = random.Random(8)
    out = []
    for _ in range(30):
        words = prose(rnd, rnd.randint(150, 400), vocabularies["en"]).split()
        out.append(" ".join(words))
        for share in (0.004, 0.01, 0.018, 0.02, 0.04, 0.1):
            near = list(words)
            for at in rnd.sample(range(len(near)), max(1, int(share * len(near)))):
                near[at] = f"changed{rnd.random()}"
            out.append(" ".join(near))
    out += ["", " \n", "a b", "A  b", "a b c"]
    return out


def test_all_pairs_above_the_similarity_link(spark, copies):
    sets = [shingles(t) for t in copies]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])]
    want = groups(range(len(sets)), links)
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == want
    assert 30 < len(set(want.values())) < len(want) - 60


def test_stage_drops_copies_far_apart_in_bits(spark, copies):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(copies)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()}
    assert not any(similar(shingles(copies[a]), shingles(copies[b])) for a in left for b in left if a < b and a // 7 == b // 7 < 30)
    assert {7 * i for i in range(30)} <= left


def test_pairs_hidden_behind_a_smaller_text(spark, vocabularies):
    """Many texts of one template share buckets; near copies among them still link."""
    rnd = random.Random(9)
    base = prose(rnd, 300, vocabularies["en"]).split()
    texts = []
    for _ in range(40):
        own = list(base)
        for at in rnd.sample(range(300), 14):
            own[at] = f"own{rnd.random()}"
        near = list(own)
        near[rnd.randrange(300)] = "changed"
        texts += [" ".join(own), " ".join(near)]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(80) for b in range(a) if similar(sets[a], sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == groups(range(80), links)


@pytest.mark.parametrize("block", [8, 256])
def test_groups_larger_than_a_unit(spark, monkeypatch, vocabularies, block):
    """Copies of one text that are near it but not near each other, and chains of copies: all links of all pairs."""
    monkeypatch.setattr(N, "BLOCK", block)
    rnd = random.Random(10)
    base = prose(rnd, 150, vocabularies["en"]).split()
    texts = []
    for _ in range(150):
        own = list(base)
        for at in rnd.sample(range(150), rnd.randint(0, 4)):
            own[at] = f"own{rnd.random()}"
        texts.append(" ".join(own))
    for _ in range(40):  # away from the text itself, some near each other
        own = texts[rnd.randrange(len(texts))].split()
        for at in rnd.sample(range(150), 2):
            own[at] = f"own{rnd.random()}"
        texts.append(" ".join(own))
    rnd.shuffle(texts)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])]
    want = groups(range(len(sets)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == want
    assert len(links) < len(sets) ** 2 / 5 and 5 < len(set(want.values())) < 150


def test_shared_counts_and_links():
    rnd = random.Random(1)
    sets = [np.array(sorted(rnd.sample(range(40), rnd.randint(0, 20))), np.int64) for _ in range(9)]
    got = N.shared_counts(sets[:4], sets[4:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[4:]] for a in sets[:4]]
    assert N.connecting(np.ones((3, 4), bool)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0)]


def test_empty(no_docs):
    assert N.near_copies(no_docs).collect() == []
