"""Language identification and quality scores: held-out accuracy and edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from diagtab.llm import bytecnn as B
from diagtab.llm import langid as L


@pytest.fixture(scope="module")
def spoken(spark, vocabularies):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(vocabularies[lang]) for _ in range(rnd.randint(8, 120))).capitalize() + ".", lang)
            for i, lang in enumerate(["en", "de", "fr", "en", "en"] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_language(spoken):
    model = L.fit(spoken.where("doc_id % 3 != 1"))
    assert model.languages == ["de", "en", "fr"] and (model.false_rate < 0.01).all()
    got = L.predict(spoken.where("doc_id % 3 = 1"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.coverage <= 1 for r in got)


def test_filters_answer_for_all_languages_at_once(spoken):
    """The bits of a bucket lookup are those of one set of n-grams per language, but for false positives."""
    model = L.fit(spoken)
    texts = [r.text.lower().encode() for r in spoken.where("lang = 'fr'").limit(20).collect()]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    total, found = L._hits(model, data, offsets)
    for i, text in enumerate(texts):
        one_total, one = L._hits(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        keys = L.grams(np.frombuffer(text, np.uint8))
        assert total[i] == one_total[0] == (keys != 0).sum() and (found[i] == one[0]).all()
        assert found[i][2] >= 0.9 * total[i] > found[i][0]


def plain_grams(text):
    """N-grams of a text as tuples of bytes, with repeats."""
    data = [b if b >= 128 or 97 <= b <= 122 else 32 for b in b" " + text.lower().encode() + b" " * (L.GRAM - 2)]
    found = [tuple(data[i:i + L.GRAM]) for i in range(len(data) - L.GRAM + 1)]
    return [g for g in found if g[:2] != (32, 32)]


def test_predictions_against_plain_sets(spoken, docs):
    """Profiles by counters, one set of n-grams per language: the same language, score and coverage but for false positives."""
    model = L.fit(spoken)
    counts = {lang: Counter() for lang in model.languages}
    for r in spoken.collect():
        counts[r.lang].update(plain_grams(r.text))
    shares = {lang: {g: n / sum(c.values()) for g, n in c.items() if n > 1} for lang, c in counts.items()}
    most = Counter()
    for own in shares.values():
        for g, share in own.items():
            most[g] = max(most[g], share)
    sets = {lang: {g for g, share in own.items() if share >= L.RATIO * most[g]} for lang, own in shares.items()}
    assert max(map(len, sets.values())) < L.PROFILE
    rows = [r for r in L.predict(docs, model, n_grams="looked").collect() if r.text and any(c.isalpha() for c in r.text)]
    for r in rows:
        told = plain_grams(r.text)
        hits = {lang: sum(g in own for g in told) for lang, own in sets.items()}
        assert r.looked == len(told)
        best = max(hits.values())
        if sorted(hits.values())[-2] < best - 2:
            assert hits[r.lang_pred] == best
            assert r.coverage == pytest.approx(best / len(told), abs=0.02) and r.score == pytest.approx(best / sum(hits.values()), abs=0.02)
    assert len(rows) > 80


def test_a_hundred_languages_in_one_pass(spark):
    rnd = random.Random(3)
    words = {f"l{i:03d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20)] for i in range(100)}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate([*words] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    model = L.fit(docs)
    assert len(jobs.getJobIdsForGroup(None)) - before < 40
    assert {r.lang == r.lang_pred for r in L.predict(docs, model).collect()} == {True}


def test_chunks_do_not_change_counts(spoken, monkeypatch):
    model = L.fit(spoken)
    texts = [r.text.lower().encode() for r in spoken.limit(40).collect()] + [b"", b"ab", b"abcd"]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    want = L._hits(model, data, offsets)
    monkeypatch.setattr(L, "CHUNK", 37)
    assert all((a == b).all() for a, b in zip(L._hits(model, data, offsets), want, strict=True))


def test_language_of_odd_rows(docs, rows, no_docs):
    model = L.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    got = L.predict(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "coverage"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.coverage) == ("und", 0.0, 0.0)
        else:
            assert r.lang_pred in model.languages
    assert L.predict(no_docs, model).collect() == []
    empty = L.fit(no_docs)
    assert empty.languages == [] and {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}


@pytest.fixture(scope="module")
def marked(spark, vocabularies):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        words = [rnd.choice(vocabularies["en"]) for _ in range(rnd.randint(20, 150))]
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w for w in words[:6] for _ in range(25)]
        rows.append((i, " ".join(words).capitalize() if not bad else " ".join(words), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_quality(marked):
    model = B.fit(marked.where("doc_id % 5 != 0").drop("quality"), marked.where("doc_id % 5 != 0").select("doc_id", "quality"), 400)
    got = B.score(marked.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in got]) > 0.95
    again = B.fit(marked.where("doc_id % 5 != 0").repartition(7), marked.where("doc_id % 5 != 0").select("doc_id", "quality"), 400)
    assert (again.table == model.table).all() and again.base == model.base


def test_quality_of_odd_rows(spark, docs, rows, no_docs):
    rnd = np.random.default_rng(0)
    net = B.Network(rnd.normal(size=(B.WIDTH, 256, B.FILTERS)).astype(np.float32), np.zeros(B.FILTERS, np.float32),
                    rnd.normal(size=B.FILTERS), rnd.normal(size=B.FILTERS), 0.1)
    got = B.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got[::9]:
        assert r.score == pytest.approx(B.probability(net, (r.text or "").encode()), abs=1e-5)
    assert B.score(no_docs, net).collect() == []
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 5)], "doc_id long, quality int")
    assert B.fit(docs, labels) == 1.0 and B.fit(docs, labels.limit(0)) == 0.5
    assert {r.score for r in B.score(docs, 0.5).collect()} == {0.5}


def test_scores_against_plain_loops(spark):
    """The network as sums over bytes, places, filters and chunks."""
    rnd = np.random.default_rng(3)
    net = B.Network(rnd.normal(size=(B.WIDTH, 256, B.FILTERS)).astype(np.float32), rnd.normal(size=B.FILTERS).astype(np.float32),
                    rnd.normal(size=B.FILTERS), rnd.normal(size=B.FILTERS), 0.3)
    texts = ["", "a", "né" * 100, "word " * 51 + "x", "The quick brown fox. " * 40, None]

    def plain(text):
        data = (text or "").encode().ljust(B.CHUNK, b" ")
        starts = [0]
        while starts[-1] + B.CHUNK < len(data):
            starts.append(min(starts[-1] + B.STEP, len(data) - B.CHUNK))
        z = net.base
        for f in range(B.FILTERS):
            each = [max(0.0, max(sum(float(net.table[k][data[s + p + k]][f]) for k in range(B.WIDTH))
                                 for p in range(0, B.CHUNK - B.WIDTH + 1, B.STRIDE)) + float(net.bias[f])) for s in starts]
            z += net.mean[f] * sum(each) / len(each) + net.most[f] * max(each)
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in B.score(docs, net).collect()}
    assert got == {i: pytest.approx(plain(t), abs=1e-5) for i, t in enumerate(texts)}


def test_all_chunks_of_long_texts_train(marked, monkeypatch):
    """What tells the labels apart stands at the very end of long texts."""
    rows = [(i, "x" * 9000 + (" good" if i % 2 else " ?!?!"), i % 2) for i in range(60)]
    docs = marked.sparkSession.createDataFrame(rows, "doc_id long, text string, quality int")
    model = B.fit(docs.drop("quality"), docs.select("doc_id", "quality"))
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in B.score(docs, model).collect())


def test_chunks_cover_the_whole_text():
    for size in (0, 1, 255, 256, 257, 448, 449, 1000, 120_000):
        starts = B.chunk_starts(max(size, B.CHUNK))
        seen = np.zeros(max(size, B.CHUNK), bool)
        for s in starts:
            seen[s:s + B.CHUNK] = True
        assert seen.all() and (np.diff(starts) <= B.STEP).all() and (starts >= 0).all()


def test_gradient_steps_lower_the_loss():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdef ") for _ in range(400)).encode() for _ in range(40)]
    texts += ["".join(rnd.choice("uvwxyz ") for _ in range(400)).encode() for _ in range(40)]
    labels = np.array([1.0] * 40 + [0.0] * 40)
    net = B.train([B.chunks_of(t) for t in texts], labels, 0.5)
    p = B.probabilities(net, texts)
    assert p[:40].min() > 0.8 and p[40:].max() < 0.2
