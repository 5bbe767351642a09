import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from diagtab.operators import bookkeeping as B
from diagtab.operators import scoring as G
from diagtab.operators.ranking import average_ranks, exact_quantiles
from diagtab.plans import report as A
from diagtab.sources import files as S


def test_bucket_boundaries(spark):
    values = [None, -0.5, 0.0, 0.1, 0.3, 0.7, 0.8999999, 0.9, 1.0, 1.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s double")
    got = [r.b for r in df.select("i", G.bucketise("s").alias("b")).orderBy("i").collect()]
    assert got == [None, 0, 0, 1, 3, 7, 8, 9, 9, 9]


def test_summarise_against_statistics(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        hot = i % 3 > 0
        rows.append(("a" if hot else "b", "d", round(rnd.random(), 2), rnd.random() if i % 5 else None, 0.5, "x" if i % 40 == 0 else None))
    rows.append(("one", "d", 0.25, None, None, None))
    df = spark.createDataFrame(rows, "candidate string, dataset string, class_score double, attribute_score double, association_score double, error string")
    got = {(r.candidate, r.element): r for r in G.summarise(df).collect()}
    for c in ("a", "b", "one"):
        for k, e in enumerate(("class_score", "attribute_score", "association_score"), start=2):
            vals = [r[k] for r in rows if r[0] == c and r[k] is not None]
            s = got[(c, e)]
            assert s.n == len(vals) == sum(s.buckets) and s.failed == sum(r[5] is not None for r in rows if r[0] == c)
            if not vals:
                assert s["mean"] is None and s["median"] is None
                continue
            mean = statistics.fmean(vals)
            assert s["mean"] == pytest.approx(mean) and s["median"] == pytest.approx(statistics.median(vals))
            assert s["std"] == pytest.approx(statistics.pstdev(vals)) and s["mad"] == pytest.approx(statistics.fmean(abs(v - mean) for v in vals))


def test_quantiles_and_ranks_with_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else None, rnd.choice([0.0, rnd.gauss(0, 1), 5.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q1, r.q2) for r in exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    for g in ("hot", None):
        vals = sorted(v for k, v in rows if k == g)
        assert got[g][0] == pytest.approx(statistics.quantiles(vals, n=4, method="inclusive")[0])
        assert got[g][1] == pytest.approx(statistics.median(vals))
    ranks = {r.v: r["rank"] for r in average_ranks(df, [], "v").collect()}
    ordered = sorted(v for _, v in rows)
    for v in (0.0, 5.0, ordered[0], ordered[-1]):
        places = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert ranks[v] == sum(places) / len(places)


def test_spearman_with_nulls_and_constants(spark):
    pandas = pytest.importorskip("pandas")
    rnd = random.Random(5)
    rows = [(rnd.randrange(5), rnd.random() if i % 4 else None, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, c int")
    got = {(r.a, r.b): r.rho for r in A.spearman_matrix(df, ["a", "b", "c"], rounded=False).collect()}
    frame = pandas.DataFrame(rows, columns=["a", "b", "c"])
    pair = frame[["a", "b"]].dropna().rank()
    assert got[("a", "b")] == pytest.approx(pair["a"].corr(pair["b"])) and got[("b", "a")] == got[("a", "b")]
    assert got[("a", "c")] is None and got[("c", "c")] is None and got[("a", "a")] == 1.0


def test_generate_never_raises(spark):
    df = spark.createDataFrame([("d", "1", "good"), ("d", "2", "bad")], "dataset string, id string, nlt string")

    def flaky(text, suffix=""):
        if text == "bad":
            raise KeyError("no")
        return text + suffix

    G.register_candidate("flaky", flaky, suffix="!", unknown=1, other=None)
    got = {r.id: r for r in G.generate(df, "flaky").collect()}
    assert got["1"].generated == "good!" and not got["1"].failed
    assert got["2"].failed and got["2"].error == "exception: KeyError: 'no'" and got["2"].generated == ""


def test_score_pairs(spark):
    ref = "@startuml\nclass A {\n x\n}\nA -- B\n@enduml"
    rows = [("d", "same", ref, ref), ("d", "blank", ref, "  "), ("d", "none", ref, "no diagram"), ("d", "half", ref, "@startuml\nclass A\n?? y\n@enduml")]
    got = {r.id: r for r in G.score_pairs(spark.createDataFrame(rows, "dataset string, id string, reference string, generated string")).collect()}
    assert (got["same"].class_score, got["same"].attribute_score, got["same"].association_score, got["same"].error) == (1.0, 1.0, 1.0, None)
    assert got["blank"].error == "empty_generated_model" and got["blank"].class_score == 0.0
    assert got["none"].error.startswith("No UML blocks found") and got["none"].class_score == 0.0
    assert got["half"].class_score == pytest.approx(2 / 3) and got["half"].parse_warning_gen == ["Line 3: Skipped '?? y'"]


def test_resume(spark):
    plan = spark.createDataFrame([("c", None, "d", 1), ("c", "m", "d", 1), ("c", "m", "d", 2), ("c", "m", "d", 3)],
                                 "candidate string, model string, dataset string, run_index int")
    prev = spark.createDataFrame([("c", "m", "d", 2, "failed", "x"), ("c", "m", "d", 3, "in_progress", None), ("gone", "m", "d", 1, "done", None)],
                                 "candidate string, model string, dataset string, run_index int, status string, error string")
    art = spark.createDataFrame([("c", "z", "d", 1, "old", 1), ("c", "m", "d", 1, "mine", 2), ("c", "z", "d", 1, "new", 3)],
                                "candidate string, model string, dataset string, run_index int, path string, modified int")
    jobs = B.reconcile_jobs(plan, prev)
    got = {(r.model, r.run_index): (r.status, r.artifact, r.to_run) for r in B.resume_status(jobs, art).collect()}
    assert got == {(None, 1): ("done", "new", False), ("m", 1): ("done", "mine", False), ("m", 2): ("failed", None, False), ("m", 3): ("pending", None, True)}
    rerun = {(r.model, r.run_index): r.to_run for r in B.resume_status(jobs, art, rerun_failed=True).collect()}
    assert rerun[("m", 2)]


def test_sources(spark, tmp_path):
    corpus = tmp_path / "c.json"
    corpus.write_text(json.dumps([{"id": i, "nlt": "t", "puml": "p"} for i in "zyx"], indent=1))
    names = {"first": "one", "one": "one"}
    df = S.read_corpus(spark, {"first": str(corpus)}, names)
    assert [(r.dataset, r.id) for r in S.limit_per_dataset(df, 2).orderBy("pos").collect()] == [("one", "z"), ("one", "y")]
    assert S.read_corpus(spark, {"plain": str(corpus)}).first().dataset == "plain"
    with pytest.raises(ValueError):
        S.read_corpus(spark, {"other": "x"}, names)
    for name in ("M 1", "M2"):
        folder = tmp_path / "models" / name
        folder.mkdir(parents=True)
        (folder / "description.md").write_text(f"text {name}")
        (folder / "plantuml.txt").write_text("@startuml\n@enduml")
        (folder / "metadata.txt").write_text("name: x\nsource: http://a:1\nname: y\n")
    tree = {r.id: r for r in S.read_model_tree(spark, str(tmp_path / "models")).collect()}
    assert set(tree) == {"M 1", "M2"} and tree["M2"].metadata == {"name": "x", "source": "http://a:1"}
    scored = tmp_path / "s.json"
    scored.write_text(json.dumps({"candidate": "c", "dataset": "d", "metric_name": "m1", "records": [{"id": "1", "scores": {"class_score": 0.5}}]}))
    assert S.read_scored(spark, str(scored), "m1").first().class_score == 0.5
    assert S.read_scored(spark, str(scored), "m2", strict=False).first().metric_mismatch
    with pytest.raises(Exception):
        S.read_scored(spark, str(scored), "m2").collect()
    jobs = tmp_path / "jobs.json"
    jobs.write_text(json.dumps({"jobs": {"a": {"candidate_id": "c", "status": "done", "run_index": 2}, "b": 5}}, indent=1))
    assert [(r.key, r.status, r.run_index) for r in S.read_joblist(spark, str(jobs)).collect()] == [("a", "done", 2)]
    assert S.read_joblist(spark, str(tmp_path / "missing.json")).count() == 0
    assert S.read_table_csv(spark, str(tmp_path / "missing.csv"), "a int").count() == 0
    table = spark.createDataFrame([("a,\"b\"", 1, None)], "x string, y int, z double")
    S.write_table_csv(table, str(tmp_path / "t"))
    assert S.read_table_csv(spark, str(tmp_path / "t"), table.schema).collect() == table.collect()
    runs = spark.createDataFrame([("c", "d", 1, None)], "candidate string, dataset string, run_index int, error string")
    S.write_run(runs, str(tmp_path / "runs"))
    written = next((tmp_path / "runs" / "candidate=c" / "dataset=d" / "run_index=1").glob("*.json"))
    assert json.loads(written.read_text()) == {"error": None}
    side = spark.createDataFrame([("d", "1", [1, 2])], "dataset string, id string, v array<int>")
    S.write_sidecar(side, str(tmp_path / "side"))
    assert S.read_sidecar(spark, str(tmp_path / "side"), "key string, v array<int>").first().key == "d::1"


def test_harness_and_prompts(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text(json.dumps({"models": {"A": {"reference_plantuml": "r", "generated_plantuml": {"0shot": "g", "1shot": ""}}}}, indent=1))
    rows = S.explode_settings(S.read_harness(spark, str(path)))
    assert sorted((r.model, r.setting, r.is_reference) for r in rows.collect()) == [("A", "0shot", False), ("A", "reference", True)]
    examples = spark.createDataFrame([("s", 1, "two", "M2"), ("s", 0, "one", "M1")], "strategy string, pos int, nlt string, model string")
    records = spark.createDataFrame([("1", "s", "new"), ("2", "t", "new")], "id string, strategy string, nlt string")
    got = {r.id: r.prompt for r in B.build_prompts(records, examples).collect()}
    assert got["1"].index("one") < got["1"].index("M1") < got["1"].index("two") < got["1"].index("new") and "one" not in got["2"]


def test_summary_document_and_histograms(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("a", None), ("a", 9.99), ("a", 90.0)], "dataset string, v double")
    assert {(r.bin, r.n) for r in A.histogram_percent(df, "v").collect()} == {(0, 3), (9, 2)}
    assert sum(r.n for r in A.histogram_equal(df, "v").collect()) == 5
    doc = S.summary_document({"h": A.histogram_percent(df, "v")})
    assert doc.count() == 2 and json.loads(doc.first().row)["dataset"] == "a"
    assert doc.filter(F.col("section") != "h").count() == 0


def test_damaged_empty_and_several_corpora(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"id": "1", "nlt": "t"}, {"id": "2", "nlt": "u", "more": 5}]))
    (folder / "b.json").write_text("[]")
    (folder / "c.json").write_text(json.dumps([{"id": "3", "puml": "p"}]))
    got = S.read_corpus(spark, {"mine": str(folder)}, names={"mine": "own"}).collect()
    assert sorted((r.dataset, r.id, r.nlt, r.puml) for r in got) == [("own", "1", "t", None), ("own", "2", "u", None), ("own", "3", None, "p")]
    assert len({r.pos for r in got}) == 3
    damaged = tmp_path / "damaged.json"
    damaged.write_text('[{"id": "1", "nlt": "t"}, {"id": "2", "nl')
    with pytest.raises(Exception, match="damaged.json"):
        S.read_corpus(spark, {"mine": str(damaged)}, names={"mine": "own"}).collect()
    broken = tmp_path / "jobs.json"
    broken.write_text('{"jobs": {"a": ')
    assert S.read_joblist(spark, str(broken)).count() == 0
    examples = tmp_path / "examples.json"
    examples.write_text(json.dumps({"examples": [{"id": "7", "nlt": "n", "model": "m"}, {"id": "8"}]}, indent=1))
    assert [tuple(r) for r in S.read_examples(spark, str(examples), "s").collect()] == [("s", 0, "7", "n", "m"), ("s", 1, "8", None, None)]
