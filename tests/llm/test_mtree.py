import math
import random

import numpy as np
import pytest

from diagtab.llm import mtree
from diagtab.llm.queries import op13_exact_top_k


def brute(rows, k=20, every=20):
    """Highest products of all pairs, ties to smaller ids."""
    points = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        points[vec_id] = min(points.get(vec_id, q), q)
    out = []
    for a, x in points.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b) for b, y in points.items() if b != a and len(y) == len(x))
        out += [(a, n + 1, b, -s) for n, (s, b) in enumerate(scored[:k])]
    return sorted(out)


def clusters(rnd, n, size, spread):
    centres = [[rnd.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [[float(np.float32(c + rnd.gauss(0, spread))) for c in rnd.choice(centres)] for _ in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, rep long, size int, v string, away double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 0.5) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("page", [8, 1024])
def test_against_all_pairs(spark, monkeypatch, page):
    """Clusters, copies of one vector, ties, other lengths, vectors that take no part, repeated and negative ids."""
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "SAMPLE", 100)
    monkeypatch.setattr(mtree, "FAN", 5)
    monkeypatch.setattr(mtree, "WAVE", 3)
    monkeypatch.setattr(mtree, "GROUP", 7)
    rnd = random.Random(3)
    rows = list(enumerate(clusters(rnd, 300, 8, 0.1)))
    rows += [(i, [0.5] * 8) for i in range(300, 420)] + [(i, [0.0] * 8) for i in range(420, 450)]
    rows += [(i, [rnd.uniform(-9, 9) for _ in range(3)]) for i in range(450, 480)] + [(500, []), (501, []), (520, [1.0])]
    rows += [(540, None), (560, [1.0, None]), (580, [float("nan")] * 8), (600, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(20, rows[20][1]), (40, rows[41][1]), (-20, [3.0] * 8), (-40, [1e5] * 8), (-60, [-1e5] * 8)]
    got = sorted(tuple(r) for r in mtree.top_products(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_numbers_beyond_doubles_and_64_bits(spark):
    rows = [(0, [1e7] * 4), (1, [1e7, 1e7, 1e7, 9999999.0]), (2, [-1e7] * 4), (20, [3e15] * 4), (21, [1e30] * 4)]
    got = {(r.query_id, r.vec_id): r.score for r in mtree.top_products(frame(spark, rows)).collect()}
    x = [[math.floor(64 * float(np.float32(c))) for c in v] for _, v in rows]
    assert got[0, 1] == sum(a * b for a, b in zip(x[0], x[1])) and got[0, 2] == -sum(a * a for a in x[0])
    assert got[20, 21] == 2**63 - 1


def test_few_rows_and_empty_tables(spark):
    assert mtree.top_products(frame(spark, [])).collect() == []
    assert mtree.top_products(frame(spark, [(0, [1.0])])).collect() == []
    assert [tuple(r) for r in mtree.top_products(frame(spark, [(0, [1.0]), (7, [-0.01])])).collect()] == [(0, 1, 7, -64)]


def test_query_reads_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op13_exact_top_k(spark, folder).collect()) == brute(rows)


def test_far_pages_are_never_visited(spark, monkeypatch):
    """Separate clusters: the plan of the last wave holds a small share of all pairs of query and page."""
    monkeypatch.setattr(mtree, "PAGE", 16)
    rnd = random.Random(4)
    rows = list(enumerate([[float(c) for c in rnd.choice(np.eye(8) * 50).tolist()] for _ in range(2000)]))
    rows = [(i, [x + rnd.uniform(-0.5, 0.5) for x in v]) for i, v in rows]
    seen = []
    original = mtree.written
    monkeypatch.setattr(mtree, "written", lambda df: (lambda out: seen.append(out) or out)(original(df)))
    got = sorted(tuple(r) for r in mtree.top_products(frame(spark, rows)).collect())
    plans = [df.count() for df in seen if "least" in df.columns]
    pages = next(df for df in seen if "longest" in df.columns).count()
    assert got == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert sum(plans) < 0.35 * 100 * pages
