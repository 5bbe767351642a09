"""The rules read packed tokens once, whatever is made of their relations."""

from diagtab.operators import extract as R


def test_relations_are_found_once_for_a_diagram(spark, tokens):
    records = tokens.select("dataset", "id").distinct().unionByName(spark.createDataFrame([("d", "none"), (None, "bank")], "dataset string, id string"))
    out = R.relations_to_diagram(records, tokens)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow ruled") == 1
    found = {(r.dataset, r.id): (r.generated, r.error) for r in out.collect()}
    assert found["d", "bank"][0].split("\n") == [
        "@startuml", "class Accounts { }", "class Bank { }", "class Clients { }",
        'Bank "1" o-- "1..*" Accounts', 'Bank "1" o-- "1..*" Clients', "@enduml"]
    assert found["d", "none"] == found[None, "bank"] == ("", "no_relations")


def test_rules_in_small_stretches_and_with_shared_numbers(spark, tokens, monkeypatch):
    """Two tokens of one number are both children; the last in order of their words stands for the number."""
    twice = spark.createDataFrame(
        [("e", "x", 0, 0, t, t, "NOUN", tag, "nsubj", 1) for t, tag in (("cat", "NNS"), ("dog", "NN"), ("dog", "NNS"))]
        + [("e", "x", 0, 1, "has", lemma, "VERB", "VBZ", "ROOT", 1) for lemma in ("have", "be")]
        + [("e", "x", 0, 2, "tail", "tail", "NOUN", "NN", "dobj", 1)], tokens.schema)
    every = tokens.unionByName(twice)
    rows = sorted(map(repr, R.extract_relations(every).collect()))
    assert sorted(tuple(r)[3:] for r in R.extract_relations(twice).collect()) == [
        ("composition", "Tail", "have", "Cat", "1", "1..*"), ("composition", "Tail", "have", "Dog", "1", "1..*")]
    monkeypatch.setattr(R, "_RULED_AT_ONCE", 1)
    assert sorted(map(repr, R.extract_relations(every).collect())) == rows and len(rows) > 10
