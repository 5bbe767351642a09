"""Tokens and pairs of a record travel as one row: no join or grouping by token or sentence, the same rows."""

import re

from diagtab.operators import treepath
from diagtab.plans import fixtures

TOKEN = "dataset string, id long, sent_i int, i int, text string, lemma string, head_i int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged_by(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


def made(spark):
    rows = [("d", 1, 0, 2, "Banks", "bank", 5), ("d", 1, 0, 5, "hold", "hold", 5), ("d", 1, 0, 9, None, "the", 5), ("d", 1, 0, 11, "cash", "cash", 9),
            ("d", 1, 3, 0, "bank", "bank", 77), ("d", 1, 3, 1, "cash", "cash", 0), ("d", 2, 0, 0, "a", "a", 1), ("d", 2, 0, 1, "b", "b", 0),
            (None, 3, 0, 0, "bank", "bank", 0), ("d", 1, 4, 0, "dup", "x", 0), ("d", 1, 4, 0, "dup", "x", 0), ("d", 1, 4, 1, "y", "y", 0)]
    return spark.createDataFrame(rows, TOKEN).repartition(3)


def test_tree_paths(spark):
    pairs = [("d", 1, 0, 2, 11), ("d", 1, 0, 2, 11), ("d", 1, 0, 11, 11), ("d", 1, 0, 2, 77), ("d", 1, 3, 0, 1), ("d", 2, 0, 0, 1), (None, 3, 0, 0, 0),
             ("d", 1, 4, 1, 0), ("d", 1, None, 0, 0), ("d", 9, 0, 0, 0)]
    asked = spark.createDataFrame(pairs, "dataset string, id long, sent_i int, src_i int, tgt_i int")
    found = treepath.bounded_tree_paths(made(spark), asked, 3)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("d", 1, 0, 0, 11, 11, [11], "cash"), ("d", 1, 0, 3, 2, 11, [2, 5, 9, 11], "Banks hold cash"), ("d", 1, 3, 1, 0, 1, [0, 1], "bank cash"),
        ("d", 1, 4, 1, 1, 0, [1, 0], "y dup"), ("d", 2, 0, 1, 0, 1, [0, 1], "a b")]
    assert {(r.src_i, r.tgt_i) for r in treepath.bounded_tree_paths(made(spark), asked, 2).collect() if r.id == 1} == {(11, 11), (0, 1), (1, 0)}
    assert not [e for e in exchanged_by(found) if "sent_i" in e or "src_i" in e or "tgt_i" in e]


def test_bindings_of_relationships(spark):
    links = spark.createDataFrame([("d", 1, "Bank", "Cash", "association", None), ("d", 1, "Bank", "Cash", "composition", "x"),
                                   ("d", 1, "Cash", "Gold", "association", None), (None, 3, "Bank", "Bank", "association", None)],
                                  "dataset string, id long, source string, target string, kind string, label string")
    found = treepath.relationship_bindings(links, made(spark))
    row, = found.collect()
    assert (row.source, row.target, row.n_sentences, row.hop, row.sent_i, row.path, row.path_text) == ("Bank", "Cash", 2, 1, 3, [0, 1], "bank cash")
    assert [tuple(s) for s in row.all_sentences] == [(0, 3, 2, 11, [2, 5, 9, 11], "Banks hold  cash"), (3, 1, 0, 1, [0, 1], "bank cash")]
    assert not [e for e in exchanged_by(found) if "source" in e or "target" in e]


def test_tokens_are_packed_before_they_are_grouped(spark):
    elements = spark.createDataFrame([("d", 1, "class", None, "Bank"), ("d", 1, "attribute", "Bank", "cash"), ("d", 1, "attribute", "NoClass", "cash")],
                                     "dataset string, id long, kind string, owner string, name string")
    found = treepath.class_attr_bindings(elements, made(spark))
    assert plan_of(found).count("MapInArrow") == 2
    assert [(r["class"], r.attribute, r.hop, r.path_text) for r in found.collect()] == [("Bank", "cash", 1, "bank cash")]


def test_placed_texts_keep_their_partitions(spark, tmp_path):
    spark.createDataFrame([(1, "A b.", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    plan = plan_of(fixtures.placed_records(spark, str(tmp_path)))
    assert "REPARTITION_BY_NUM" in plan and re.search(r"hashpartitioning\(source#\d+, doc_id#\d+L", plan)
