"""Arrays cut into splits of any size give the records that a JSON parser gives."""

import json
import random

import pytest

from diagtab.sources import files as S
from diagtab.sources.json_arrays import read_records

TEXTS = ["plain", "", "}", "{", "\"", "\\", "\\\"}", "[{]}", "é}ü", "a\nb\r\n", "\\\\", "\"},{\"", "😀 }", "x" * 300]


def made(rnd, n):
    out = []
    for i in range(n):
        record = {"id": str(i), "nlt": "".join(rnd.choice(TEXTS) for _ in range(rnd.randint(0, 5)))}
        if rnd.random() < 0.4:
            record["more"] = {"deep": [{"x": rnd.choice(TEXTS)}, []], rnd.choice(TEXTS) + "k": {}}
        if rnd.random() < 0.8:
            record["puml"] = rnd.choice(TEXTS)
        out.append(record)
    return out


@pytest.mark.parametrize("split", ["64", "997", "1000000"])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_of_split_files(spark, tmp_path, split, indent):
    rnd = random.Random(int(split))
    files = {f"f{k}.json": made(rnd, n) for k, n in enumerate((60, 1, 0))}
    for name, records in files.items():
        (tmp_path / name).write_text(json.dumps(records, indent=indent, ensure_ascii=name == "f0.json"), encoding="utf-8")
    (tmp_path / "one.json").write_text(' {"id": "only", "nlt": "{"} \n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = read_records(spark, {"a": str(tmp_path)})
        got = rows.collect()
        if split == "64":
            assert rows.rdd.getNumPartitions() > 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, records in (files | {"one.json": [{"id": "only", "nlt": "{"}]}).items():
        own = sorted((r.pos, r.text) for r in got if r.path.endswith(name))
        assert [json.loads(t) for _, t in own] == records


def test_damaged_records_name_their_file(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"id": "1", "nlt": "t"}, {"id": "2", "nl')
    with pytest.raises(Exception, match="cut.json"):
        S.read_corpus(spark, {"a": str(tmp_path / "cut.json")}).collect()
    (tmp_path / "odd.json").write_text('[{"id": "1"}, {id: 2]}, {"id": "3"}]')
    with pytest.raises(Exception, match="odd.json"):
        S.read_corpus(spark, {"a": str(tmp_path / "odd.json")}).collect()


def test_written_model_tree(spark, tmp_path):
    rows = [("a b/c", "text\n", "@startuml\n@enduml", "name: x\nk: 1:2"), ("é", None, " p ", ""), ("d", "", None, None)]
    models = spark.createDataFrame(rows, "id string, description string, plantuml string, metadata string")
    S.write_model_tree(models, str(tmp_path / "tree"))
    read = S.read_model_tree(spark, str(tmp_path / "tree"), folders=True)
    got = {r.id: (r.description, r.plantuml, r.metadata) for r in read.collect()}
    assert got == {"a b/c": ("text\n", "@startuml\n@enduml", {"name": "x", "k": "1:2"}), "é": (None, " p ", {}), "d": ("", None, None)}
    plan = read.where("id = 'd'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(id#" in plan[plan.index("PartitionFilters"):]


def test_tables_keep_blanks_quotes_and_breaks(spark, tmp_path):
    rows = [(1, " x ", 1.5), (2, "a,\"b\"\nc", None), (3, "", 0.1), (4, None, -0.0), (5, "\ttab\\n", 1e300)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    S.write_table_csv(df, str(tmp_path / "t"))
    assert sorted(S.read_table_csv(spark, str(tmp_path / "t"), df.schema).collect()) == sorted(df.collect())
