"""Names meet the words of their records in blocks: word lists are asked for once a block, rows of names are not exchanged."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from diagtab.functions import scan
from diagtab.functions.text import ASCII_WORD, SPACE_CHARACTERS
from diagtab.operators import lexmatch as L

ELEMENT = "dataset string, id long, kind string, owner string, name string"


def test_words_and_parts_of_columns_are_those_of_the_expressions():
    gap, word = re.compile(f"(?<=[.!?])[{re.escape(SPACE_CHARACTERS)}]+"), re.compile(ASCII_WORD)
    part = re.compile("([A-Za-z](?:[a-z0-9]|(?<![a-z0-9])[A-Z])*)")
    rnd = random.Random(1)
    for _ in range(100):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choices("aB9. !?_é\u0085  　\n-Zx1", k=rnd.randrange(40))) for _ in range(rnd.randrange(9))]
        column = pa.array(["before", *texts], pa.string()).slice(1)
        words, text, sentence = scan.words_of(column)
        assert list(zip(words.to_pylist(), text.tolist(), sentence.tolist(), strict=True)) == [
            (x.lower(), i, k) for i, t in enumerate(texts) if t is not None for k, s in enumerate(gap.split(t.strip(SPACE_CHARACTERS))) for x in word.findall(s)]
        parts, name = scan.parts_of(column)
        assert list(zip(parts.to_pylist(), name.tolist(), strict=True)) == [(x.lower(), i) for i, t in enumerate(texts) if t for x in part.findall(t)]


def some(spark):
    names = [("d", i, "class", None, n) for i in range(40) for n in ("CarPark", f"Wolf{i}", "night_Stars", "Zoo", "Zoo")]
    elements = spark.createDataFrame([*names, (None, 1, "class", None, "Car"), ("d", 2, "attribute", None, None)], ELEMENT)
    texts = [("d", i, f"A car. Wolves{i} ran! {'Night falls. ' * (i % 5)}") for i in range(40)]
    records = spark.createDataFrame([*texts, ("d", 3, "Park star"), (None, 1, "car"), ("d", 4, None)], "dataset string, id long, nlt string")
    lemmas = spark.createDataFrame([("stars", "star"), ("parks", "park")], "token string, lemma string")
    inflections = spark.createDataFrame([("star", "star", "stars")], "token string, singular string, plural string")
    synonyms = spark.createDataFrame([("zoo", "park"), ("zoo", "night"), ("park", "Ran")], "token string, synonym string")
    return elements, records, L.build_lexicon(lemmas, inflections), synonyms


def rows(df):
    return sorted(map(repr, df.collect()))


def test_levels_in_blocks(spark, monkeypatch):
    elements, records, lexicon, synonyms = some(spark)
    found = L.match_levels(elements, None, synonyms, records, lexicon=lexicon)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # names and texts are exchanged by block, once each; lists meet what a block asks for
    assert not re.findall(r"Exchange hashpartitioning\(dataset", plan) and "Exchange hashpartitioning(_block" in plan
    at = {(r.id, r.name): (r.l1, r.l2, r.l4, r.matched_tokens, r.sent_indices) for r in found.where("dataset IS NOT NULL").collect()}
    assert at[1, "CarPark"] == (True, True, True, "park", [0]) and at[3, "Zoo"] == (False, False, True, "zoo", [])
    assert at[3, "night_Stars"] == (True, True, False, "", [2, 3, 4]) and at[4, "CarPark"] == (True, True, True, "park", [0])
    assert at[2, None] == (False, False, False, "", []) and len(at) == 161 and found.where("dataset IS NULL AND absent").count() == 1
    whole = rows(found)
    monkeypatch.setattr(L, "_AT_ONCE", 1)
    assert rows(L.match_levels(elements, None, synonyms, records, lexicon=lexicon)) == whole
    assert rows(L.match_levels(elements, L.build_text_index(records, lexicon), synonyms, records)) == whole


def test_an_index_meets_the_lexicon_in_blocks(spark):
    _, records, lexicon, _ = some(spark)
    index = L.build_text_index(records, lexicon)
    assert not re.findall(r"Exchange hashpartitioning\(dataset", index._jdf.queryExecution().executedPlan().toString())
    assert {(r.form, r.is_token, r.is_lemma) for r in index.where("id = 3").collect()} == {
        ("a", True, True), ("car", True, True), ("wolves3", True, True), ("ran", True, True), ("night", True, True), ("falls", True, True),
        ("park", True, True), ("star", True, False), ("stars", False, False)}
    assert index.where("dataset IS NULL").count() == 1 and index.where("id = 4").count() > 0


def test_tables_of_elements_and_relationships_exchange_no_names(spark):
    elements, records, lexicon, synonyms = some(spark)
    more = spark.createDataFrame([("d", 1, "enum_value", "a.b", "c"), ("d", 1, "enum_value", "a", "b.c"), ("d", 1, "enum_value", "a", "Car")], ELEMENT)
    links = spark.createDataFrame(
        [("d", 1, "CarPark", "Zoo", "association", "ran"), ("d", 1, "CarPark", "Zoo", "association", "ran"), ("d", 1, "Zoo", None, "x", "car"),
         (None, 1, "Car", "Car", "x", None), ("d", 77, "Car", "Zoo", "x", "Ran")], "dataset string, id long, source string, target string, kind string, label string")
    table = L.per_element_table(elements.unionByName(more), links, None, records, synonyms, lexicon)
    pairs = L.match_relationships(links, None, records, synonyms, lexicon)
    for df in (table, pairs):
        assert not re.findall(r"Exchange hashpartitioning\(dataset", df._jdf.queryExecution().executedPlan().toString())
    found = [tuple(r)[2:] for r in table.where("dataset = 'd' AND id = 1 AND kind IN ('enum_value', 'rel_endpoint')").collect()]
    nothing = (False, False, False, False, True, "")
    assert sorted(found) == sorted(
        [("enum_value", "a.b.c", *nothing)] * 2 + [("enum_value", "a.Car", True, True, True, False, False, "0")]
        + [("rel_endpoint", "CarPark-(association)->Zoo", True, True, True, True, False, "0")] * 2
        + [("rel_endpoint", "CarPark-(association)->Zoo (tgt)", False, False, False, True, False, "")] * 2)
    assert table.where("kind = 'rel_endpoint' AND dataset IS NULL AND absent").count() == 2
    wide = {(r.dataset, r.source, r.target): r for r in pairs.collect()}
    assert pairs.count() == 5 and wide[None, "Car", "Car"].source_absent is None and wide[None, "Car", "Car"].common_sentences is None
    first = wide["d", "CarPark", "Zoo"]
    assert (first.source_l1, first.target_l1, first.target_l4, first.label_l1, first.label_sent_indices, first.common_sentences) == (True, False, True, True, [1], [])
    assert wide["d", "Zoo", None].target_l1 is None and wide["d", "Zoo", None].label_l1 and wide["d", "Car", "Zoo"].label_absent
    assert rows(L.endpoint_elements(links).select("kind", "name").distinct().where(F.col("kind") == "rel_label")) == [
        "Row(kind='rel_label', name='Ran')", "Row(kind='rel_label', name='car')", "Row(kind='rel_label', name='ran')"]
