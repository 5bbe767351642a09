import pytest
from pyspark.sql import functions as F

from diagtab.functions import text as T
from diagtab.operators import compare as X
from diagtab.operators import markup as M
from diagtab.operators import quality as V


def lines_of(spark, *bodies):
    rows = [("d", str(i), "@startuml\n" + body + "\n@enduml") for i, body in enumerate(bodies)]
    return M.explode_lines(spark.createDataFrame(rows, "dataset string, id string, puml string"))


def rels(spark, *lines, legacy=False):
    found = M.extract_relationships(lines_of(spark, "\n".join(lines)), legacy).orderBy("line_no").collect()
    return [(r.source, r.target, r.kind, r.source_card, r.target_card, r.label) for r in found]


# arrow, kind, does the right-hand name become the source
ARROWS = [
    ("<|--", "inheritance", False), ("--|>", "inheritance", True), ("<|-", "inheritance", False), ("-|>", "inheritance", True),
    ("*-->", "composition", False), ("<--*", "composition", True), ("*--", "composition", False), ("--*", "composition", True),
    ("o-->", "aggregation", False), ("<--o", "aggregation", True), ("o--", "aggregation", False), ("--o", "aggregation", True),
    ("-->", "directed", False), ("<--", "directed", True), ("->", "directed", False), ("<-", "directed", True),
    ("..", "dependency", False), ("--", "association", False), ("-", "association", False),
]


def test_every_arrow(spark):
    assert rels(spark, *[f'A "1" {a} "*" B : l' for a, _, _ in ARROWS]) == [
        ("B", "A", kind, "*", "1", "l") if swap else ("A", "B", kind, "1", "*", "l") for _, kind, swap in ARROWS
    ]
    assert [r[2] for r in rels(spark, *[f"A {a} B" for a, _, _ in ARROWS])] == [k for _, k, _ in ARROWS]


def test_legacy_direction_and_names_ending_in_o(spark):
    assert rels(spark, "Zoo-- Bar", 'A "1" *--> "2" B') == [
        ("Zoo", "Bar", "association", None, None, None), ("A", "B", "composition", "1", "2", None)]
    assert rels(spark, "Zoo-- Bar", 'A "1" *--> "2" B', legacy=True) == [
        ("Zo", "Bar", "aggregation", None, None, None), ("B", "A", "composition", "2", "1", None)]


def test_odd_relationship_lines(spark):
    assert rels(spark, 'A "1 -- "*" B', "(A,B)..N : x", '"" A', 'A "" -- "1" B', "A -- B :  two words ") == [
        ("A", "B", "association", "1 ", "*", None), ("(A, B)", "N", "association_class", None, None, "x"),
        ("A", "B", "association", None, "1", None), ("A", "B", "association", None, None, "two words")]


def test_class_forms_and_attributes(spark):
    body = """class A
class B {}
abstract class C { x; String y; }
ABSTRACT CLASS D {
  name
  age : Integer
  status : Status = Active
  List<Item> bad
  String title = "t"
  const Integer MAX = 10
  +method()
  enum Mode { on, off }
}
E : later
E : other
class E {
  own : int
}
class F extends A"""
    lines = lines_of(spark, body)
    classes = [(r.name, r.is_abstract, r.declared) for r in M.extract_classes(lines).orderBy("line_no").collect()]
    assert classes == [("A", False, True), ("B", False, True), ("C", True, True), ("D", True, True),
                       ("E", False, False), ("E", False, True)]
    got = [(r["class"], r.name, r.type, r.default_value, r.is_constant)
           for r in M.extract_attributes(lines).orderBy("line_no", "pos").collect()]
    assert got == [
        ("C", "x", None, None, False), ("C", "y", "String", None, False), ("D", "name", None, None, False),
        ("D", "age", "Integer", None, False), ("D", "status", "Status", "Active", False),
        ("D", "title", "String", '"t"', False), ("D", "MAX", "Integer", "10", True),
        ("E", "later", None, None, False), ("E", "other", None, None, False), ("E", "own", "int", None, False)]
    assert [r.warning for r in M.parse_warnings(lines).collect()] == ["Line 20: Skipped 'class F extends A'"]
    counts = M.diagram_counts(lines).first()
    assert (counts.n_classes, counts.n_attributes, counts.n_enums) == (6, 10, 0)


def test_enums_and_notes(spark):
    body = """enum S { a, b }
enum Big {
  X
  ...
  not valid here

}
class C {
  enum Mode { on, off }
}
note right of C
 two
lines
end note
note left : short"""
    lines = lines_of(spark, body)
    enums = [(r.name, r["values"], r.is_inline, r.owner_class) for r in M.extract_enums(lines).orderBy("line_no").collect()]
    assert enums == [("S", ["a", "b"], True, None), ("Big", ["X", "..."], False, None), ("Mode", ["on", "off"], True, "C")]
    notes = [(r.position, r.content) for r in M.extract_notes(lines).orderBy("line_no").collect()]
    assert notes == [("right of C", "two\nlines"), ("left", "short")]


def test_unclosed_bodies_fail_only_in_strict_mode(spark):
    bodies = ["class A {\n x : int", "enum E {\n a", "note right of X\n text", "A -- B", "?? bad"]
    df = spark.createDataFrame([("d", str(i), f"@startuml\n{b}\n@enduml") for i, b in enumerate(bodies)] + [("d", "5", "none")],
                               "dataset string, id string, puml string")
    strict = {r.id: r.error for r in M.parse_status(df).collect()}
    assert strict == {
        "0": "Class 'A' at line 2 not properly closed", "1": "Enum 'E' at line 2 not properly closed",
        "2": "Note at line 2 not properly closed", "3": None, "4": "Unrecognized line 2: '?? bad'",
        "5": "No UML blocks found in input (missing @startuml/@enduml markers)"}
    loose = {r.id: r.error is None for r in M.parse_status(df, strict=False).collect()}
    assert loose == {"0": True, "1": True, "2": True, "3": True, "4": True, "5": False}


def test_body_like_lines_inside_a_note(spark):
    lines = lines_of(spark, "note right of A\nclass of {\n}\nend note\nclass B {\nx\n}")
    assert [r.name for r in M.extract_classes(lines).collect()] == ["B"]
    assert [r.name for r in M.extract_attributes(lines).collect()] == ["x"]


def test_comments_keep_line_numbers(spark):
    body = "' whole\nA -- B ' tail\n// slash\n/' block\nA -- C\n'/ A -- D\nA -- E /' in '/ : x\nA -- F : it's"
    df = spark.createDataFrame([("d", "0", f"@startuml\n{body}\n@enduml")], "dataset string, id string, puml string")
    got = [(r.line_no, r.target, r.label) for r in M.extract_relationships(M.explode_lines(df)).orderBy("line_no").collect()]
    assert got == [(3, "B", None), (7, "D", None), (8, "E", "x"), (9, "F", "it")]
    comments = sorted((r.line_no, r.comment) for r in M.extract_comments(df).collect())
    assert comments == [(2, "whole"), (3, "tail"), (4, "slash"), (5, "block A -- C"), (8, "in"), (9, "s")]


def test_round_trip(spark):
    body = 'enum S {\n  a\n}\nclass A {\n  x : int\n}\nA "1" *-- "2" B : l\nA <|-- C\n(A, B) .. D'
    lines = lines_of(spark, body)
    text = V.render_diagram(M.extract_classes(lines), M.extract_attributes(lines), M.extract_enums(lines), M.extract_relationships(lines))
    again = M.explode_lines(text)
    cols = ["source", "target", "kind", "source_card", "target_card", "label"]
    assert M.extract_relationships(again).select(*cols).collect() == M.extract_relationships(lines).orderBy("line_no").select(*cols).collect()
    assert sorted(r.name for r in M.extract_classes(again).collect()) == ["A", "B", "C", "D"]


def test_validate(spark):
    rows = [("d", "ok", "```\n@startuml\nA \"1\" -- B : x\n@enduml\n```"), ("d", "bad", "@startuml\nclass yes {\n}\nA -- B\n@enduml"),
            ("d", "none", "  "), ("d", "nomark", "class A"), ("d", "empty", "@startuml\n@enduml"),
            ("d", "open", "@startuml\nclass A {\n x\n@enduml")]
    got = {r.id: r for r in V.validate(spark.createDataFrame(rows, "dataset string, id string, puml string")).collect()}
    assert got["ok"].ok and got["ok"].repaired == '@startuml\nclass A { }\nclass B { }\nA "1" -- "" B : x\n@enduml'
    assert got["bad"].errors == ["L2 bad class: yes", "L3 unknown: }"]
    assert got["bad"].repaired is not None
    assert got["none"].errors == ["no_text"] and got["nomark"].errors == ["no_start"]
    assert got["empty"].errors == ["nothing_left"]
    assert got["open"].errors == ["L2 open class: A"]


def test_cleaning_rules(spark):
    text = ("enum A <<enum>> {\n(A, B) . C\nX . (A, B)\nA .. (B, C)\n<> diamond\nA *-> B\nnote \"t\" as N1\n"
            "A <--> B\nA 1*-B\nA \"1\" -* \"2\" B\nA -- B\nA *-- B")
    df = spark.createDataFrame([(text,)], "t string").select(V.clean_diagram_markup("t").alias("c"))
    assert df.first().c.split("\n") == ["enum A {", "A -- B", "A 1-B", 'A "1" - "2" B', "A -- B", "A *-- B"]


def test_compare_empty_sets_and_self_loops(spark):
    a = spark.createDataFrame([("d", "1", "@startuml\nclass A\nA -- A\n@enduml"), ("d", "2", "@startuml\n@enduml")],
                              "dataset string, id string, puml string")
    b = spark.createDataFrame([("d", "1", "@startuml\nclass a\nclass B\n@enduml"), ("d", "2", "@startuml\n@enduml")],
                              "dataset string, id string, puml string")
    got = {(r.id, r.kind): r.jaccard for r in X.jaccard(X.element_sets(a), X.element_sets(b)).collect()}
    assert got[("1", "classes")] == 0.5 and got[("1", "relationships")] == 0.0 and got[("1", "attributes")] == 1.0
    assert {v for (i, _), v in got.items() if i == "2"} == {1.0}
    diff = {r.kind: r for r in X.set_diff(X.element_sets(a), X.element_sets(b)).filter("id = '1'").collect()}
    assert diff["relationships"].only_in_first == ["a"] and diff["classes"].only_in_second == ["b"]


@pytest.mark.parametrize("name,parts", [
    ("GameArea", ["game", "area"]), ("firstName", ["first", "name"]),
    ("grid_horizontal-position", ["grid", "horizontal", "position"]), ("", []), ("ID2Name", ["id2", "name"])])
def test_split_identifier(spark, name, parts):
    assert spark.createDataFrame([(name,)], "n string").select(T.split_identifier("n").alias("p")).first().p == parts


def test_scalar_text(spark):
    df = spark.createDataFrame([("a.  b (é*c)", "```json\nx\n```", "gpt/4:b ", "hello WORLD")], "a string, b string, c string, d string")
    r = df.select(T.clean_requirement_text("a").alias("a"), T.strip_code_fences("b").alias("b"), T.sanitize_token("c").alias("c"),
                  T.camel_term("d").alias("d"), T.quote_cardinality(F.lit(' "1" ')).alias("q"), T.quote_cardinality(F.lit(" ")).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.q, r.e) == ("a . b c", "json\nx\n", "gpt_4_b", "HelloWorld", '"1"', '""')
