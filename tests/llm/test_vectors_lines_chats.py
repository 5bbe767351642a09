"""Near-duplicate vectors, line dedup and chat formatting against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from diagtab.llm import chatformat as C
from diagtab.llm import embeddup as E
from diagtab.llm import lines as N
from diagtab.llm.common import prefix_sum


def made_vectors():
    rnd = np.random.default_rng(8)
    out = [rnd.normal(size=64) for _ in range(60)]
    for i in range(12):  # a dense group
        out.append(out[0] + 0.05 * rnd.normal(size=64))
    for i in range(6):  # a chain
        out.append(out[-1] + 0.2 * rnd.normal(size=64))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    rows += [(100 + i, rows[5][1]) for i in range(7)] + [(200, [2 * x for x in rows[5][1]]), (201, [-x for x in rows[5][1]])]
    rows += [(300, None), (301, []), (302, [0.0] * 64), (303, [float("nan")] + [1.0] * 63), (304, [None] + [1.0] * 63),
             (305, [float("inf")] + [1.0] * 63), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, rows[5][1]), (308, [1e30] * 64), (309, [1e-30] * 64)]
    return rows


def brute(rows):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, np.float64) / np.abs(v).max()) for i, v in rows if i is not None and usable(v)]
    links, low = defaultdict(int), {i: i for i, _ in rows if i is not None}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, (i, v) in enumerate(good):
        for j, w in good[a + 1:]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i] += 1
                links[j] += 1
                low[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, links[i], root(i), root(i) == i) for i, _ in rows if i is not None)


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = made_vectors()
    df = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, size int, class string, t int")
    got = [tuple(r) for r in E.near_vectors(df.repartition(3)).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute(rows)
    assert [r for r in got if r[0] is None] == [(None, 0, None, None)]


def test_no_vectors(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_long_vectors(spark):
    """Vectors of 1,024 components; most share no bucket, and only those that do are sent."""
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 1024))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (base[i] + 0.05 * rnd.normal(size=1024)).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, E.near_vectors(df).collect())) == brute(rows)


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(1)
    a = E.unit(rnd.normal(size=(3000, 64)))
    b = rnd.normal(size=(3000, 64))
    b = E.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    for cosine, least in ((0.951, 0.95), (0.97, 0.99)):
        near = cosine * a + np.sqrt(1 - cosine ** 2) * b
        assert (E.buckets(a) == E.buckets(near)).any(axis=1).mean() > least


def test_lines_against_counts(docs, rows):
    sites, first = defaultdict(set), {}
    seen = {}
    for doc, text, _, source, _ in rows:
        for at, line in enumerate(text.split("\n") if text is not None else []):
            bare = line.strip(" \t\n\r\x0b\x0c")
            if bare:
                sites[bare].add(source)
                place = (doc if doc is not None else 1 << 63, at)
                first[bare] = min(first.get(bare, place), place)
    want = []
    for doc, text, lang, source, _ in rows:
        each = text.split("\n") if text is not None else []
        kept = []
        for at, line in enumerate(each):
            bare = line.strip(" \t\n\r\x0b\x0c")
            if not bare or len(sites[bare]) < N.MIN_SITES or (doc if doc is not None else 1 << 63, at) == first[bare]:
                kept.append(line)
        want.append((doc, None if text is None else "\n".join(kept), len(each), len(each) - len(kept)))
    got = N.drop_spread_lines(docs)
    assert got.columns == docs.columns + ["n_lines", "n_removed"]
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 5


def test_near_threshold_lines_are_counted_exactly(spark):
    """Lines on 7 to 14 sites, the threshold being 10, hot lines on one site, and lines on thousands."""
    rows = [(f"line {n}", f"site {s}", s, 0) for n in range(7, 15) for s in range(n)]
    rows += [("one site", "a", i, 0) for i in range(500)] + [("many", f"x{i}", i, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "line string, site string, id long, at int")
    assert {r.line for r in N.spread_lines(df).collect()} == {f"line {n}" for n in range(10, 15)} | {"many"}


def test_lines_under_clashing_names(spark):
    """Columns named like the operator's own, in any case, come through."""
    rows = [(i, "shared line\nown " + str(i), f"site {i}", 1, "r", 2, 3, 4) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __gone int, __row string, __ID int, N_lines int, line int")
    got = N.drop_spread_lines(df).collect()
    assert {(r["__gone"], r["__row"], r["__ID"], r["line"]) for r in got} == {(1, "r", 2, 4)}
    assert sorted(r.text for r in got) == sorted(["shared line\nown 0"] + [f"own {i}" for i in range(1, 12)])


def test_a_document_of_very_many_shared_lines(spark):
    """Work on one document grows with its lines, not with lines times removed lines."""
    page = "\n".join(f"boilerplate {i % 50}" for i in range(100_000))
    rows = [(1, page, "s0"), *[(2 + i, "\n".join(f"boilerplate {k}" for k in range(50)), f"s{1 + i}") for i in range(12)]]
    got = {r.doc_id: r for r in N.drop_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].n_removed == 100_000 - 50 and got[1].text == "\n".join(f"boilerplate {k}" for k in range(50))
    assert all(got[i].text == "" for i in range(2, 14))


def test_no_lines(no_docs):
    assert N.drop_spread_lines(no_docs).collect() == []


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def chats():
    rnd = random.Random(6)
    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<|turn|><|body|>x<|end|>", "<<s>", "\\<|turn|>", "", "<|im_start|>é\n", "[[INST]]", "<<SYS>>\n<</SYS>>", "</s", "😀 <s>"]
    rows = []
    for c in range(60):
        common = [("system", "one first turn for all"), ("user", rnd.choice(hard))][:rnd.randint(0, 2)]
        turns = common + [(rnd.choice(["user", "assistant"]), rnd.choice(hard)) for _ in range(rnd.randint(1, 6))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(70, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(300)]
    rows += [(71, t, r, x) for c, t, r, x in rows if c == 3]  # a copy
    rows += [(72, 0, None, None), (72, 0, None, None), (72, 5, "assistant", "late"), (72, None, "user", "no number"), (None, 1, "user", "no id"),
             (73, 0, "<|body|>", "odd role")]
    return rows


def told(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_chats_round_trip(spark, chats):
    df = spark.createDataFrame([(*r, "x", 1) for r in chats], "conv_id long, turn long, role string, text string, path string, n int").repartition(3)
    nodes, members = C.prefix_tree(df)
    want = told(chats)
    got = {r.conv_id: r for r in C.read_back(nodes, members).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(x for r, x in turns if r == "assistant")
        inner = got[c].formatted.split(C.TURN)[1:]
        assert len(inner) == len(turns) and all(p.count(C.BODY) == 1 and p.endswith(C.END) and p.count(C.END) == 1 for p in inner)
        assert not any(s in got[c].formatted for s in C.CONTROLS if s not in (C.TURN, C.BODY, C.END))


def test_tree_is_packed_once_depth_first(spark, chats):
    df = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")
    nodes = sorted(C.prefix_tree(df)[0].collect(), key=lambda r: r.start)
    prefixes = {tuple(t[:k + 1]) for t in told(chats).values() for k in range(len(t))}
    assert len(nodes) == len(prefixes)
    by, open_path, end = {r.node_id: r for r in nodes}, [], 0
    for r in nodes:
        assert r.start == end and r.n == len(r.formatted)
        end += r.n
        while open_path and open_path[-1] != r.parent_id:
            open_path.pop()
        assert (r.parent_id is None) == (not open_path)  # the parent is the last open node: depth first
        line = [by[i] for i in open_path]
        assert r.position == sum(a.n for a in line) and r.depth == len(line)
        assert {p for s in r.attends for p in range(s.start, s.start + s.n)} == {p for a in line for p in range(a.start, a.start + a.n)}
        assert all(a.start + a.n < b.start for a, b in zip(r.attends, r.attends[1:]))
        open_path.append(r.node_id)


def test_sums_over_many_blocks(spark, monkeypatch):
    rows = [(i, (i * 7919) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "at long, n long").repartition(3)
    got = {r.at: r.start for r in prefix_sum(df, "at", "n", "start", block=4).collect()}
    assert got == {i: sum(n for _, n in rows[:i]) for i in range(500)}


def test_a_very_long_conversation(spark):
    """Ten thousand turns, of which another conversation shares half: one linear pass, exact round trip."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(10_000)]
    rows += [(2, t, r, x if t < 5000 else x + "!") for _, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    nodes, members = C.prefix_tree(df)
    assert nodes.count() == 15_000
    got = {r.conv_id: r for r in C.read_back(nodes, members).collect()}
    for c in (1, 2):
        assert [t.text for t in got[c].turns] == [x for i, _, _, x in rows if i == c]


def test_no_chats(spark):
    nodes, members = C.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.collect() == [] and C.read_back(nodes, members).collect() == []
