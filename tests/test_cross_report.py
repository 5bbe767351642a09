"""Sizes and sets of two datasets come from one parse; trimming takes every white space character."""

import re

from pyspark.sql import functions as F

from diagtab.functions import text as T
from diagtab.operators import compare as X
from diagtab.operators import markup as M

A = "@startuml\n\u3000class A {\n  x : Int\n}\nB : y\nA : z\nclass B {\n}\nA -- C\nA *-- B : has\nC : late\n@enduml"
B = "@startuml\nclass A {\n  x : Int\n}\nA -- B\n@enduml"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(spark):
    rows = [("a", 1, A), ("b", 1, B), ("a", 2, A), ("a", 3, "no diagram"), ("b", 3, B), ("a", 4, A), ("a", 4, B), ("b", 4, B), ("b", 4, B),
            ("a", None, A), ("b", None, B), ("c", 1, A), (None, 1, A), ("a", 5, None), ("b", 5, "@startuml\n@enduml")]
    return spark.createDataFrame(rows, "dataset string, id long, puml string").repartition(3)


def test_sizes_and_sets(spark):
    both = made(spark)
    found = X.cross_dataset_report(both, "a", "b", rounded=False)
    sides = {d: both.where(F.col("dataset") == d) for d in "ab"}
    want = X.cross_report(sides["a"], sides["b"], rounded=False)
    for d, name in (("a", "first"), ("b", "second")):
        n = M.diagram_counts(M.explode_lines(sides[d]))
        want = want.join(n.select("id", F.col("n_classes").alias(f"{name}_n_classes"), F.col("n_relationships").alias(f"{name}_n_rels")), "id", "left")
    assert found.schema.names == want.schema.names
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    of = {r.id: (r.first_n_classes, r.first_n_rels, r.second_n_classes, r.second_n_rels) for r in found.collect()}
    assert of == {1: (4, 2, 1, 1), 3: (None, None, 1, 1), 4: of[4], None: (None,) * 4, 5: (None,) * 4}


def test_diagrams_are_parsed_once(spark):
    found = X.cross_dataset_report(made(spark), "a", "b")
    kept = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Generate inline", kept)) == 3 and "Join" not in kept


def test_trimming_takes_all_space(spark):
    spaces = [chr(c) for c in range(1, 0x3100) if re.match(r"[\t-\r\x1c-\x1f\x85\s]", chr(c)) or chr(c) in T.SPACE_CHARACTERS]
    texts = [f"{s}a{s}b{s}" for s in spaces] + ["\u200bx\u200b", "", " \u3000\n", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = rf"^{T.SPACE}+|{T.SPACE}+\z"
    rows = df.select(T.strip("t").alias("now"), F.regexp_replace("t", every, "").alias("was"), T.rstrip("t").alias("end"),
                     F.regexp_replace("t", rf"{T.SPACE}+\z", "").alias("end_was")).collect()
    assert all(r.now == r.was and r.end == r.end_was for r in rows)
    assert "regexp_replace" not in plan_of(df.select(T.strip("t")))
