"""Words of a sentence meet the names of its record in one row: words are never joined."""

from diagtab.operators import textprofile


def test_sentence_stats(spark):
    records = spark.createDataFrame([("d", 1, "A bank holds a bank. Cash! ..."), ("d", 1, "Bank x."), ("d", 2, None), (None, 3, "bank")],
                                    "dataset string, id long, nlt string")
    names = spark.createDataFrame([("d", 1, "class", "BankCash"), ("d", 1, "attribute", "holds_a"), ("d", 1, "endpoint", "Bank"), ("d", 1, "class", "BANK"),
                                   ("d", 1, "class", None), ("d", 1, "other", "x"), (None, 3, "class", "Bank")],
                                  "dataset string, id long, kind string, name string")
    found = textprofile.sentence_stats(records, names)
    assert sorted((r.id, r.sent_i, r.n_words, r.n_class_hits, r.n_attr_hits, r.n_rel_endpoint_hits) for r in found.collect()) == [
        (1, 0, 2, 1, 0, 1), (1, 0, 5, 1, 2, 1), (1, 1, 1, 1, 0, 0), (1, 2, 0, 0, 0, 0), (3, 0, 1, 0, 0, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "part#" in line]
