import random

import pytest
from pyspark.sql import functions as F

from diagtab.operators import extract as R
from diagtab.operators import lexmatch as L
from diagtab.operators import textprofile as P
from diagtab.operators import treepath as D


def test_text_features(spark):
    df = spark.createDataFrame([("d", "1", "Éa b_1 b_1. C! "), ("d", "2", "")], "dataset string, id string, nlt string")
    a, b = P.text_features(df).orderBy("id").collect()
    assert (a.n_chars, a.n_words, a.n_sentences, a.n_unique_words_lower, a.type_token_ratio) == (15, 4, 2, 3, 0.75)
    assert (a.avg_word_length, a.avg_sentence_length_words) == (2.25, 2.0)
    assert (b.n_words, b.n_sentences, b.type_token_ratio, b.avg_word_length) == (0, 0, 0.0, 0.0)


def test_match_levels(spark):
    records = spark.createDataFrame([("d", "1", "Passengers board a game area. The car stops.")], "dataset string, id string, nlt string")
    elements = spark.createDataFrame(
        [("d", "1", "class", None, n) for n in ("Area", "Passenger", "GameZone", "Automobile", "Sky", "___")],
        "dataset string, id string, kind string, owner string, name string")
    lemmas = spark.createDataFrame([("passengers", "passenger"), ("stops", "stop")], "token string, lemma string")
    inflections = spark.createDataFrame([("area", "area", "areas")], "token string, singular string, plural string")
    synonyms = spark.createDataFrame([("automobile", "car"), ("sky", "heavens")], "token string, synonym string")
    index = L.build_text_index(records, L.build_lexicon(lemmas, inflections))
    got = {r.name: r for r in L.match_levels(elements, index, synonyms, records).collect()}
    levels = {n: (r.l1, r.l2, r.l3, r.l4, r.absent) for n, r in got.items()}
    assert levels["Area"] == (True, True, True, False, False)
    assert levels["Passenger"] == (False, True, False, False, False)
    assert levels["GameZone"] == (True, True, True, False, False)
    assert levels["Automobile"] == (False, False, False, True, False) and got["Automobile"].matched_tokens == "automobile"
    assert levels["Sky"] == levels["___"] == (False, False, False, False, True)
    assert got["Area"].sent_indices == [0] and got["Sky"].sent_indices == []


def test_hand_checked_paths(spark, tokens):
    rel = spark.createDataFrame([("d", "air", "Aircraft", "Flight"), ("d", "bank", "Bank", "Account"), ("d", "air", "Aircraft", "Pilot")],
                                "dataset string, id string, source string, target string")
    got = {(r.source, r.target): r for r in D.relationship_bindings(rel, tokens).collect()}
    assert set(got) == {("Aircraft", "Flight"), ("Bank", "Account")}
    assert got[("Aircraft", "Flight")].hop == 2 and got[("Aircraft", "Flight")].path_text == "aircraft performs flights"
    assert got[("Bank", "Account")].path_text == "bank consists of accounts" and got[("Bank", "Account")].n_sentences == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_depths_against_search(spark, seed):
    rnd = random.Random(seed)
    n = 60
    heads = [0] + [rnd.choice([rnd.randrange(i), i - 1]) for i in range(1, n)]
    rows = [("d", "1", 0, i, f"w{i}", f"w{i}", "X", "", "x", h) for i, h in enumerate(heads)]
    schema = "dataset string, id string, sent_i int, i int, text string, lemma string, pos string, tag string, dep string, head_i int"
    t = spark.createDataFrame(rows, schema)
    pairs = [(a, b) for a in range(0, n, 3) for b in range(0, n, 4)]
    wanted = spark.createDataFrame([("d", "1", 0, a, b) for a, b in pairs], "dataset string, id string, sent_i int, src_i int, tgt_i int")
    got = {(r.src_i, r.tgt_i): (r.hop, r.path) for r in D.bounded_tree_paths(t, wanted, 5).collect()}

    def up(i):
        chain = [i]
        while heads[chain[-1]] != chain[-1]:
            chain.append(heads[chain[-1]])
        return chain

    expected = {}
    for a, b in pairs:
        ua, ub = up(a), up(b)
        meet = next(x for x in ua if x in ub)
        path = ua[: ua.index(meet) + 1] + list(reversed(ub[: ub.index(meet)]))
        if len(path) - 1 <= 5:
            expected[(a, b)] = (len(path) - 1, path)
    assert got == expected
    depth = sum(min(32, len(up(i)) - 1) for i in range(n)) / n
    assert P.mean_root_distance(t).first().mean_root_distance == pytest.approx(depth)


def test_root_distance_is_capped(spark):
    rows = [("d", "1", 0, i, "w", "w", "X", "", "x", max(0, i - 1)) for i in range(100)]
    schema = "dataset string, id string, sent_i int, i int, text string, lemma string, pos string, tag string, dep string, head_i int"
    got = P.mean_root_distance(spark.createDataFrame(rows, schema)).first().mean_root_distance
    assert got == pytest.approx(sum(min(i, 32) for i in range(100)) / 100)


def test_rules(spark, tokens):
    got = {(r.rule, r.source, r.label, r.target, r.source_card, r.target_card) for r in R.extract_relations(tokens).collect()}
    assert got == {
        ("aggregation", "Bank", "consist of", "Accounts", "1", "1..*"), ("aggregation", "Bank", "consist of", "Clients", "1", "1..*"),
        ("association", "Customers", "buy", "Books", "1..*", "1..*"), ("association", "Customers", "send to", "Letters", "1..*", "1..*"),
        ("association", "Customers", "send to", "Friends", "1..*", "1..*"), ("generalization", "Dog", None, "Animal", None, None),
        ("generalization", "Cat", None, "Pet", None, None), ("generalization", "Car", None, "Vehicle", None, None),
        ("aggregation", "Order", "include", "Items", "1", "1..*"), ("aggregation", "Order", "include", "Order", "1", "1"),
        ("include", "Items", "include", "Order", "1..*", "1")}
    records = tokens.select("dataset", "id").distinct()
    out = {r.id: r for r in R.relations_to_diagram(records, tokens).collect()}
    assert out["air"].failed and out["air"].error == "no_relations" and out["air"].generated == ""
    assert out["kind"].generated.count("<|--") == 3


def test_promoted_names(spark):
    rows = [("d", "1", 0, 0, "etc", "etc", "NOUN", "NN", "nsubj", 1), ("d", "1", 0, 1, "take", "take", "VERB", "VB", "ROOT", 1),
            ("d", "1", 0, 2, "al", "al", "NOUN", "NN", "dobj", 1), ("d", "2", 0, 0, "etc", "etc", "NOUN", "NN", "nsubj", 1),
            ("d", "2", 0, 1, "take", "take", "VERB", "VB", "ROOT", 1), ("d", "2", 0, 2, "cars", "car", "NOUN", "NNS", "dobj", 1)]
    schema = "dataset string, id string, sent_i int, i int, text string, lemma string, pos string, tag string, dep string, head_i int"
    t = spark.createDataFrame(rows, schema)
    assert {(r.id, r.name_lower) for r in R.class_names(t).collect()} == {("1", "etc"), ("1", "al"), ("2", "cars")}


def test_annotate_with_a_user_function(spark):
    df = spark.createDataFrame([("d", "1", "b a")], "dataset string, id string, nlt string")

    def words(text):
        return [{"sent_i": 0, "i": i, "text": w, "lemma": w, "pos": "X", "tag": "", "dep": "ROOT", "head_i": i} for i, w in enumerate(text.split())]

    assert [r.text for r in P.annotate(df, words).orderBy("i").collect()] == ["b", "a"]
    assert P.annotate(df).agg(F.count("*")).first()[0] == 2


def test_annotate_keeps_failures_as_rows(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["b a", "bad", "", "c"])], "dataset string, id long, nlt string").repartition(1)

    def words(text):
        if text == "bad":
            raise ValueError("no")
        return [{"sent_i": 0, "i": i, "text": w, "lemma": w, "pos": "X", "tag": "", "dep": "ROOT", "head_i": i} for i, w in enumerate(text.split())]

    got = sorted((r.id, r.text, r.i, r.error) for r in P.annotate(df, words, errors=True).collect() if r.text) + [
        (r.id, r.error) for r in P.annotate(df, words, errors=True).collect() if not r.text]
    assert got == [(0, "a", 1, None), (0, "b", 0, None), (3, "c", 0, None), (1, "exception: ValueError: no")]
    with pytest.raises(Exception):
        P.annotate(df, words).collect()


def test_token_numbers_with_gaps_and_missing_heads(spark, tokens):
    """Without punctuation and determiners, numbers have gaps; a token whose head is gone is a root."""
    rows = [("d", "g", 0, i, w, w, "NOUN", "NN", "conj", h) for i, w, h in ((1, "x", 3), (3, "y", 5), (5, "z", 5), (9, "q", 7))]
    t = spark.createDataFrame(rows, tokens.schema)
    chains = {r.i: [n.i for n in r.chain] for r in D.ancestor_chains(t, 4).collect()}
    assert chains == {1: [1, 3, 5], 3: [3, 5], 5: [5], 9: [9]}
    assert P.mean_root_distance(t).first().mean_root_distance == pytest.approx(3 / 4)
    pairs = spark.createDataFrame([("d", "g", 0, 1, 5), ("d", "g", 0, 1, 9)], "dataset string, id string, sent_i int, src_i int, tgt_i int")
    assert [(r.hop, list(r.path)) for r in D.bounded_tree_paths(t, pairs, 4).collect()] == [(2, [1, 3, 5])]
    fewer = tokens.where("pos not in ('PUNCT', 'DET', 'ADJ')")
    shifted = fewer.withColumns({c: F.col(c) * 5 + 40 for c in ("i", "head_i")})
    shown = lambda df: {tuple(r)[3:] for r in R.extract_relations(df).collect()}
    assert shown(fewer) == shown(shifted) and len(shown(fewer)) > 8


def test_levels_with_and_without_an_index(spark):
    records = spark.createDataFrame([("d", "1", "Cars stop. A bicycle stops"), ("d", "2", None), ("d", "3", "")], "dataset string, id string, nlt string")
    names = [("d", i, "class", None, n) for i in "123" for n in ("Car", "stopSign", "Bike", "cars", "42", "")]
    elements = spark.createDataFrame(names, "dataset string, id string, kind string, owner string, name string")
    lemmas = spark.createDataFrame([("cars", "car"), ("stops", "stop")], "token string, lemma string")
    inflections = spark.createDataFrame([("cars", "car", "cars"), ("stop", "stop", "stops")], "token string, singular string, plural string")
    synonyms = spark.createDataFrame([("bike", "bicycle"), ("car", "stop")], "token string, synonym string")
    for lexicon in (None, L.build_lexicon(lemmas, inflections)):
        for words in (None, synonyms):
            by_index = L.match_levels(elements, L.build_text_index(records, lexicon), words)
            probed = L.match_levels(elements, None, words, records, lexicon=lexicon, sentences=False)
            assert sorted(map(str, by_index.collect())) == sorted(map(str, probed.collect()))
