"""Names, words and tokens of a record meet in one row: fewer exchanges, the same rows."""

from diagtab.operators import extract, lexmatch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def matched(spark):
    elements = spark.createDataFrame(
        [("d", 1, "class", None, "BankAccount"), ("d", 1, "class", None, "BankAccount"), ("d", 1, "attribute", "BankAccount", "cars_x"),
         (None, 2, "class", None, "Bank"), ("d", 3, "class", None, "--"), ("d", 4, "class", None, None)],
        "dataset string, id long, kind string, owner string, name string")
    records = spark.createDataFrame(
        [("d", 1, "A bank. A car! No."), ("d", 1, "Bank two. Money."), (None, 2, "bank"), ("d", 3, None)], "dataset string, id long, nlt string")
    synonyms = spark.createDataFrame([("account", "Money"), ("x", "autos")], "token string, synonym string")
    lemmas = spark.createDataFrame([("car", "car"), ("cars", "car")], "token string, lemma string")
    inflections = spark.createDataFrame([("car", "car", "cars"), ("cars", "car", "carss")], "token string, singular string, plural string")
    return lexmatch.match_levels(elements, None, synonyms, records, lexicon=lexmatch.build_lexicon(lemmas, inflections))


def test_match_levels_rows(spark):
    found = {(r.id, r.name): (r.l1, r.l2, r.l3, r.l4, r.absent, r.matched_tokens, r.sent_indices) for r in matched(spark).collect()}
    assert found == {
        (1, "BankAccount"): (True, True, True, True, False, "account", [0]),
        (1, "cars_x"): (False, True, False, False, False, "", []),
        (2, "Bank"): (False, False, False, False, True, "", []),
        (3, "--"): (False, False, False, False, True, "", []),
        (4, None): (False, False, False, False, True, "", []),
    }


def test_match_levels_needs_no_exchange_by_word_of_a_record(spark):
    plan = plan_of(matched(spark))
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(dataset" in line and ("token#" in line or "part#" in line)]


def test_sentence_trees_one_pass(spark):
    rows = [("d", 1, 0, 1, "Bank", "bank", "NOUN", "NN", "nsubj", 4), ("d", 1, 0, 4, "has", "have", "VERB", "VB", "ROOT", 4),
            ("d", 1, 0, 7, "cars", "car", "NOUN", "NNS", "dobj", 4), ("d", 1, 0, 7, "cats", "cat", "NOUN", "NNS", "dobj", 4),
            ("d", 1, 1, 2, "of", "of", "ADP", "IN", "prep", 9), (None, 2, 0, 0, "x", "x", "NOUN", "NN", "ROOT", None)]
    tokens = spark.createDataFrame(
        rows, "dataset string, id long, sent_i int, i int, text string, lemma string, pos string, tag string, dep string, head_i int")
    trees = extract.sentence_trees(tokens)
    assert plan_of(trees).count("ObjectHashAggregate") == 2  # one grouping: before and after the exchange
    found = {(r.id, r.sent_i): [(n["at"], n["own"] and n["own"]["text"], [k["text"] for k in n["kids"]]) for n in r.nodes] for r in trees.collect()}
    assert found[1, 0] == [(1, "Bank", []), (4, "has", ["Bank", "cars", "cats"]), (7, "cats", [])]
    assert found[1, 1] == [(2, "of", []), (9, None, ["of"])]
    assert [n[1] for n in found[2, 0] if n[0] is not None] == ["x"]
