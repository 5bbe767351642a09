from collections import defaultdict

import pytest

from diagtab.llm import mixing as M


def poured(sizes, weights=(1, 2, 3), most=3):
    """Targets by pouring round after round: bound sources leave, the rest share what is left."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, bound = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in bound]
        left = total - sum(bound.values())
        weight = sum(w[f] for f in free)
        over = [s for s in free if left * w[s] > most * sizes[s] * weight]
        if not over:
            return bound | {s: left * w[s] / weight for s in free}
        bound |= {s: most * sizes[s] for s in over}


def test_targets_against_pouring(spark):
    cases = [{"a": 100, "b": 1, "c": 5, None: 7}, {"a": 1}, {"a": 0, "b": 9}, {"z": 1000, "ä": 1, "Z": 1, "zz": 400, "y": 3},
             {f"s{i}": (i * 7919) % 1000 for i in range(60)}, {"a": 0, "b": 0}]
    for sizes in cases:
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r for r in M.source_targets(df).collect()}
        assert {s: r.source_size for s, r in got.items()} == sizes
        if sum(sizes.values()):
            assert {s: r.target for s, r in got.items()} == pytest.approx(poured(sizes))


def test_as_many_sources_as_hosts(spark):
    """A hundred thousand sources: targets as by pouring, no window over all of them."""
    df = spark.range(100_000).selectExpr("concat('host', lpad(id, 6, '0')) AS source", "pmod(id * 7919, 1013) AS source_size")
    got = M.source_targets(df)
    sizes = {r.source: r.source_size for r in df.collect()}
    want = poured(sizes)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(want)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_mix_of_whole_table(docs, rows):
    got = M.mix(docs).collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=repr) == sorted(((r[0], r[3]) for r in rows), key=repr)
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += len((text or "").encode().split())
    want = poured(size)
    taken, expected = defaultdict(int), {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        share = r.target / r.source_size if r.source_size else 0
        assert share - 1 < r.copies < share + 1
        taken[r.source] += r.copies
        expected[r.source] = expected.get(r.source, 0) + share
    assert len(got) == len(rows)
    # systematic: the number of copies of a source misses its sum by less than one
    assert all(abs(taken[s] - expected[s]) < 1 for s in expected)
    again = M.mix(docs.repartition(5)).collect()
    key = [(r.doc_id, r.source, r.size, r.copies) for r in got]
    assert sorted(key, key=repr) == sorted([(r.doc_id, r.source, r.size, r.copies) for r in again], key=repr)


def test_empty(no_docs):
    assert M.mix(no_docs).collect() == []
