import random
import re

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from diagtab.llm import simhash as S
from diagtab.llm.common import components


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(nodes, linked):
    """Smallest node reachable from each."""
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def expected(rows):
    prints = [(doc, slow_print(text)) for doc, text in rows]
    reps = {}
    for doc, fp in prints:
        if doc is not None:
            reps[fp] = min(reps.get(fp, doc), doc)
    fps = sorted(reps)
    links = [(reps[a], reps[b]) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 2]
    named = groups(reps.values(), links)
    return sorted(((doc, fp, named.get(reps.get(fp))) for doc, fp in prints), key=repr), links


def test_whole_table_against_all_pairs(docs, rows):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs).collect()]
    want, links = expected([(r[0], r[1]) for r in rows])
    assert sorted(got, key=repr) == want and links


def test_links_of_made_fingerprints(spark):
    """Clusters, chains and far fingerprints: what is connected is what all pairs connect."""
    rnd = random.Random(3)
    prints = set()
    for _ in range(25):
        fp = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            prints.add(fp)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                fp ^= 1 << b
    prints = sorted(prints)
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    df = spark.createDataFrame([(fp, i) for i, fp in enumerate(signed)], "fp long, rep long")
    found = {r.id: r.component for r in components(S.linked(df)).collect()}
    links = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and (a ^ b).bit_count() <= 2]
    want = groups(range(len(prints)), links)
    assert links and {i: found.get(i, i) for i in want} == want


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_a_chain_keeps_within_its_budget(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    apart = [((fp ^ other) >> at & ((1 << n) - 1)).bit_count() for at, n in S.SEGMENTS]
    assert any(apart[i] == 0 and apart[(i + 1) % 3] <= 1 for i in range(3))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(500, 900)] + [(5000, 4000), (None, 3), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 500 for i in (*range(500, 900), 1000)} | {4000: 4000, 5000: 4000}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty(no_docs):
    assert S.near_duplicates(no_docs).collect() == []
