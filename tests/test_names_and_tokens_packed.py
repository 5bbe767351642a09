"""Names and tokens are made, packed and counted many records at a time; none of their rows is exchanged."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from diagtab.functions import text as T
from diagtab.operators import packs, textprofile, treepath
from diagtab.plans import catalog, fixtures

TOKEN = "dataset string, id long, sent_i int, i int, text string, lemma string, pos string, dep string, head_i int"


def exchanged_by(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def stored(spark, folder):
    texts = [(1, "Zoo, been 9x to. Takes it!　s s aS 2béc.\n\nEnd İx", "a"), (2, "", "a"), (3, None, "b"), (4, "Ab abc. " + "Wolves hunt foxes of night by stars " * 9, "b"),
             (4, "wolves Hunt Abc Def ghi jkl mno", "b"), (4, "wolves Hunt Abc Def ghi jkl mno", "b"), (None, "Some more text", None), (5, "fooBar bar foo barBar xyz", None)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_token_rows_are_the_tokens(spark, tmp_path):
    d = stored(spark, tmp_path)
    rows = lambda df: sorted(map(repr, df.collect()))
    tokens = fixtures.tokens(spark, d)
    assert rows(fixtures.token_rows(spark, d)) == rows(tokens) and tokens.count() > 90
    assert rows(fixtures.token_rows(spark, d, ("i", "dep"))) == rows(tokens.select("dataset", "id", "i", "dep"))
    assert rows(fixtures.chunks(spark, d)) == rows(
        tokens.filter(F.col("dep").isin("nsubj", "dobj", "pobj")).select("dataset", "id", "sent_i", F.col("i").alias("root_i"), "text"))


def test_names_are_distinct_without_an_exchange_of_names(spark, tmp_path):
    d = stored(spark, tmp_path)
    e, r = fixtures.elements(spark, d), fixtures.element_relationships(spark, d)
    assert sorted(tuple(x) for x in e.where("id = 4").select("kind", "owner", "name").collect()) == sorted(
        [("class", None, "FooBarBar"), ("attribute", "FooBarBar", "FooBarBar")], key=str) and e.where("id = 3 AND kind = 'class'").count() == e.where("id = 3 AND kind = 'class'").distinct().count()
    assert e.count() == e.distinct().count() and r.count() == r.distinct().count() > 0
    assert not [x for df in (e, r) for x in exchanged_by(df) if "name" in x or "source#" in x and "target" in x]


def test_packs_keep_numbers_and_words():
    numbers, words = [5, -2**31 + 1, 2**31 - 1, None, 7, 7], ["a", None, "b", "a", "", "a"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["d"] * 6), pa.array([1, 1, 1, 1, 2, 2]), pa.array(numbers, pa.int32()), pa.array(words), pa.array(words[::-1])], ["dataset", "id", "n", "w", "v"])
    packed = packs._pack(batch, ("n",), ("w", "v"))
    lists = pa.ListArray.from_arrays(pa.array([0, 1, 2], pa.int32()), packed.column("pack"))
    record, of, held = packs.unpacked(lists, ("n",), ("w", "v"))
    shown = lambda c: [None if x < 0 else held[x].as_py() for x in of[c].tolist()]
    assert record.tolist() == [0, 0, 0, 0, 1, 1] and of["n"].tolist() == [packs.NULL if n is None else n for n in numbers]
    assert shown("w") == words and shown("v") == words[::-1] and packs.rows_until(lists).tolist() == [4, 6]
    steps = pa.RecordBatch.from_arrays([pa.array(["d"] * 5000), pa.array([1] * 5000), pa.array(np.arange(5000, dtype=np.int32))], ["dataset", "id", "n"])
    assert len(packs._pack(steps, ("n",), ()).column("pack").field("data")[0].as_py()) < 500


def test_names_and_tokens_meet_in_one_grouping(spark):
    tokens = spark.createDataFrame([("d", 1, 0, 0, "Banks", "bank", "NOUN", "nsubj", 1), ("d", 1, 0, 1, "hold", "hold", "VERB", "ROOT", 1), (None, 2, 0, 0, "Bank", "bank", "", "", 0)], TOKEN)
    elements = spark.createDataFrame(
        [("d", 1, "class", None, "Bank"), ("d", 1, "attribute", "Bank", "hold"), ("d", 1, "attribute", "Bank", "hold"), ("d", 1, "attribute", "Bank", None),
         (None, 2, "class", None, "Bank"), (None, 2, "attribute", "Bank", "bank")], "dataset string, id long, kind string, owner string, name string")
    links = spark.createDataFrame([("d", 1, "Bank", "hold", "association", None)], "dataset string, id long, source string, target string, kind string, label string")
    bound = treepath.record_bindings(elements, links, tokens)
    assert exchanged_by(bound) == [x for x in exchanged_by(bound) if re.fullmatch(r"dataset#\d+, id#\d+L, \d+", x)] and len(exchanged_by(bound)) == 1
    assert sorted((r.id, r.n_attrs_total, r.n_rels_total, [(f.sort, f.second, f.hop) for f in r.found]) for r in bound.collect()) == [
        (1, 3, 1, [(0, "hold", 1), (1, "hold", 1)]), (2, 1, 0, [])]


def test_kinds_are_counted_in_one_grouping(spark):
    schema = "dataset string, id long, source string, target string, kind string"
    links = spark.createDataFrame([("d", 1, "A", "B", "association"), ("d", 1, "A", "B", "association"), ("d", 1, "A", "B", "odd"), ("d", 1, "A", None, "association"),
                                   ("d", 1, "B", "A", "composition"), (None, 2, "A", "B", "association"), ("d", 3, "A", "B", None)], schema)
    bound = spark.createDataFrame([("d", 1, "A", "B"), ("d", 1, "A", None), (None, 2, "A", "B")], "dataset string, id long, source string, target string")
    records = spark.createDataFrame([("d", 1), ("d", 1), (None, 2), ("d", 3)], "dataset string, id long")
    found = treepath.kind_coverage(records, links, bound)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 28 and sorted((r for r in rows if r[3]), key=str) == 2 * [("d", 1, "association", 3, 2, 66.67)] + 2 * [("d", 1, "composition", 1, 0, 0.0)]
    assert not [x for x in exchanged_by(found) if "source" in x or "target" in x]


def test_features_exchange_runs_not_tokens(spark):
    tokens = spark.createDataFrame(
        [("d", 1, 0, 0, "Ana", "ANA", "NOUN", "nsubj", 1), ("d", 1, 0, 1, "is", "be", "VERB", "ROOT", 1), ("d", 2, 0, 0, "x", None, None, None, None),
         ("d", 1, None, 2, "ana", "ana", "ADJ", "dobj", 1), ("d", 1, 1, 3, "3a", "3a", "NOUN", "nsubjpass", None)], TOKEN).coalesce(1)
    found = textprofile.token_features(tokens)
    shown = ("id", "n_tokens", "n_sents", "n_nsubj", "n_nsubjpass", "n_dobj", "n_verbs", "n_nouns", "n_adjectives", "mean_children", "n_unique_lemmas")
    assert sorted(tuple(r[c] for c in shown) for r in found.collect()) == [(1, 4, 2, 1, 1, 1, 1, 2, 1, 0.5, 2), (2, 1, 1, 0, 0, 0, 0, 0, 0, 0.0, 0)]
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_root_distance_with_gaps_is_linear(spark):
    n = 60000  # one sentence: a search of each head along the sentence would take minutes
    chain = spark.range(n).select(F.lit("d").alias("dataset"), F.lit(1).cast("long").alias("id"), F.lit(0).alias("sent_i"), (3 * F.col("id") + 5).cast("int").alias("i"),
                                  F.when(F.col("id") == 0, 5).otherwise(3 * F.col("id") + 2).cast("int").alias("head_i"))
    found = textprofile.mean_root_distance(chain)
    assert found.collect()[0].mean_root_distance == (sum(range(32)) + 32 * (n - 32)) / n
    assert not [x for x in exchanged_by(found) if "sent_i" in x]
    odd = spark.createDataFrame([("d", 1, None, 4, 7), ("d", 1, None, 7, 4), ("d", 2, 0, None, 1), ("d", 2, 0, 1, None), ("d", 2, 0, 9, 1), ("d", 2, 0, 8, 77)], "dataset string, id long, sent_i int, i int, head_i int")
    assert sorted((r.id, r.mean_root_distance) for r in textprofile.mean_root_distance(odd).collect()) == [(1, 32.0), (2, 0.5)]


def test_identifier_parts_by_one_pattern(spark):
    cases = {"fooBarBAZ9Qux-1a_b": ["foo", "bar", "baz9", "qux", "a", "b"], "9A1B": ["a1", "b"], "": [], None: None, "__": [], "ÉtatCivil x": ["tat", "civil", "x"], "ABc": ["abc"]}
    rows = spark.createDataFrame([(c,) for c in cases], "name string").select("name", T.split_identifier("name").alias("parts"))
    assert {r.name: r.parts for r in rows.collect()} == cases
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "flatten" not in plan


def test_named_queries_use_rows_made_at_once(spark, tmp_path):
    d = stored(spark, tmp_path)
    for name in ("token_features", "token_graph", "mean_root_distance_gapped", "class_attr_bindings", "kind_coverage", "split_identifier"):
        catalog.queries()[name](spark, d).collect()
        assert "MapInArrow" in catalog.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_digests_of_rows_that_travel_as_packs(spark):
    rows = [("d", 1, "A", "z"), ("d", 1, "B", "y"), ("d", 1, "A", "é"), ("d", 2, "A", None), (None, 1, None, "b"), (None, 1, None, "a"), ("d", 1, "A", "B")]
    df = spark.createDataFrame(rows, "dataset string, id long, name string, shown string").repartition(3)
    found = packs.digests(df, "name", "shown")
    assert not [x for x in exchanged_by(found) if "shown" in x or "name" in x]
    listed = F.array_join(F.sort_array(F.collect_list("shown")), "|")
    plain = df.groupBy("dataset", "id", "name").agg(F.count("*").alias("n"), F.md5(listed).alias("digest"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect())) and found.count() == 4


def test_case_study_tokens_and_bindings_are_packed(spark, tmp_path):
    d = stored(spark, tmp_path)
    spark.createDataFrame([(4,), (4,), (9,), (None,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    only = spark.read.parquet(f"{tmp_path}/labels.parquet")
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(fixtures.token_rows(spark, d, only=only)) == shown(fixtures.tokens(spark, d, only)) == shown(fixtures.tokens(spark, d).where("id = 4"))
    exchanged = exchanged_by(catalog.queries()["case_study_rows"](spark, d))
    assert not [x for x in exchanged if "dataset" in x and ("part" in x or "name" in x or "token" in x)]
