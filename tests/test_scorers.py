"""Scorers, sources, validation and the stream on hand-made facts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import facts as T
from lodeworks.operators import scorers as C
from lodeworks.plans import validation as V
from lodeworks.sources import trees as R
from lodeworks.streaming import incremental


def fn(name, lines=10, **k):
    base = dict(name=name, receiver="", exported=name[:1].isupper(), line_start=1, line_end=lines, params=[], returns=[], max_nesting=3, max_cond_ops=3, cognitive_complexity=1, string_literal_ratio=0.0, max_case_arms=0, avg_case_lines=0.0)
    return base | k


def file(repo, path, functions=(), **k):
    base = dict(repo_id=repo, path=path, package="user", package_doc=False, init_functions=0, total_lines=10, is_generated=False, has_cgo=False, structs=[], interfaces=[], interface_defs=[], imports=[], global_vars=[], error_calls=[], type_assertions=[], functions=list(functions))
    return base | k


@pytest.fixture
def files(spark):
    p = lambda n, t="string": {"name": n, "type": t}
    rows = [
        file("a", "x/domain/user.go", [fn("CreateUser", 150, cognitive_complexity=125), fn("Run", receiver="*Svc", params=[p("ctx", "context.Context")], returns=["error"])], package_doc=True, structs=["User"],
             interface_defs=[{"name": "P", "methods": ["Run"]}, {"name": "Q", "methods": ["Run", "Stop"]}, {"name": "E", "methods": []}], global_vars=["ErrGone", "Cache"], error_calls=[{"has_wrap": True, "has_context": False}]),
        file("a", "x/user_test.go", [fn("TestUser_Create", 60), fn("TestPlain"), fn("ExampleUser")], total_lines=700, package="user_test"),
        file("a", "gen.go", [fn("Huge", 9000)], is_generated=True, package="util"),
        file("a", "y/user.go", [fn("CreateUser")], package="util", init_functions=1, type_assertions=[{"safe": True}]),
        file("b", "m.go"),
    ]
    return spark.createDataFrame(rows, T.FILES)


def scores(df):
    return {(r.repo_id, r.name): r.score for r in df.collect()}


def test_code_health(files):
    s = scores(C.code_health(files))
    # sizes: 150 of 50 lines gives 0.5, five others 1; complexity: 125 of 25 gives 0
    assert s["a", "function_size"] == round((0.5 + 5) / 6 * 20)
    assert s["a", "cognitive_complexity"] == round(5 / 6 * 20)
    assert s["a", "file_size"] == round((1 + 1 + (1 - 100 / 2400)) / 3 * 20)
    assert s["a", "parameter_count"] == 20 and s["b", "function_size"] == 20


def test_structure(spark, files):
    modules = spark.createDataFrame([("a", "m", ["domain"], 4), ("a", "n", ["domain"], 2), ("a", "o", ["application"], 9)], T.MODULES)
    s = scores(C.structure(files, modules))
    assert s["a", "interface_contracts"] == int(2 / 3 * 25) and s["a", "module_completeness"] == int(0.75 * 25)
    assert s["b", "interface_contracts"] == 0 and s["b", "module_completeness"] == 0


def test_verifiability_and_context(spark, files):
    paths = spark.createDataFrame([("a", p) for p in ("go.sum", "Makefile", "x/user.go", "y/user.go", "x/user_test.go", "docs/adr-1.md", "z_example_test.go")], T.PATHS)
    trees = spark.createDataFrame([("a", 600, True, "see `x`")], T.TREES)
    s = scores(C.verifiability(files, paths, trees))
    assert s["a", "test_presence"] == 25 and s["a", "test_naming"] == 12 and s["a", "build_reproducibility"] == 22 and s["a", "type_safety_signals"] == 15
    assert s["b", "test_presence"] == 0 and s["b", "type_safety_signals"] == 15
    s = scores(C.context_quality(files, paths, trees))
    assert s["a", "package_documentation"] == 12 and s["a", "architecture_docs"] == 20 and s["a", "canonical_examples"] == 4 + 1 + 10
    assert s["b", "canonical_examples"] == 0


def test_predictability(files):
    s = scores(C.predictability(files))
    assert s["a", "explicit_dependencies"] == 25 - 3 * 2
    assert s["a", "error_message_quality"] == int((0.4 + 0.2 + 0.1) * 25 + 1e-9) and s["b", "error_message_quality"] == 0
    assert s["a", "consistent_patterns"] == 12 and s["b", "self_describing_names"] == 0


def test_naming(files):
    s = scores(C.naming_uniqueness(files))
    names = ["CreateUser", "Run", "TestUser_Create", "TestPlain", "ExampleUser", "CreateUser"]
    import math

    from collections import Counter

    h = -sum(c / 6 * math.log2(c / 6) for c in Counter(names).values()) / math.log2(6)
    says = [(0.75 + 1) / 2, 0.0, (0.75 + 1 + 0.75 + 0.75) / 4, 0.75, (0.75 + 1) / 2, (0.75 + 1) / 2]
    words = [1, 0.5, 1, 1, 1, 1]
    want = round((sum(words) / 6 * 0.3 + sum(says) / 6 * 0.3 + h * 0.25 + (1 - 1 / 1) * 0.15) * 25)
    assert s["a", "naming_uniqueness"] == want and s["b", "naming_uniqueness"] == 0


def test_issues_and_totals(spark, files):
    found = C.issues(files)
    got = {(r.sub_metric, r.severity, r.file, r.message) for r in found.collect()}
    assert ("function_size", "error", "x/domain/user.go", "function CreateUser is 150 lines (>50)") in got
    assert ("cognitive_complexity", "error", "x/domain/user.go", "function CreateUser has cognitive complexity 125 (>25)") in got
    assert ("file_size", "info", "x/user_test.go", "file has 700 lines (>600)") in got
    assert ("naming_uniqueness", "info", "", 'exported function "CreateUser" appears in 2 packages') in got
    assert ("naming_uniqueness", "info", "y/user.go", 'package "util" is a vague name; consider a more descriptive name') in got
    metrics = C.code_health(files).unionByName(C.predictability(files))
    cats = C.category_scores(metrics, found, files)
    s = {(r.repo_id, r.category): r.score for r in cats.collect()}
    health = sum(v for (r, _), v in scores(C.code_health(files)).items() if r == "a")
    # two errors and one info of seven functions
    assert s["a", "code_health"] == max(0, health - round((3 + 3 + 0.2) / 6 * 120)) and s["b", "code_health"] == 80
    total = {r.repo_id: r for r in C.overall(cats).collect()}
    assert total["b"].overall == int((s["b", "code_health"] * 0.25 + s["b", "predictability"] * 0.10) / 0.35 + 0.5)
    doc = {r.repo_id: json.loads(r.json) for r in R.score_documents(metrics, cats, C.overall(cats)).collect()}
    assert [c["name"] for c in doc["a"]["categories"]] == ["code_health", "predictability"] and len(doc["a"]["categories"][0]["sub_metrics"]) == 4


def test_validation(spark, files):
    changed = spark.createDataFrame([file("b", "m.go", [fn("BuildAll", 400)])], T.FILES)
    after = V.overlay(files, changed, spark.createDataFrame([("a", "gen.go")], "repo_id string, path string"))
    assert after.count() == 4
    drift = V.new_issues(C.issues(files), C.issues(after))
    assert [(r.repo_id, r.sub_metric, r.severity) for r in drift.collect()] == [("b", "function_size", "error")]
    assert {r.repo_id: r.status for r in V.status(files, drift).collect()} == {"a": "pass", "b": "fail"}
    total = lambda f: C.category_scores(C.code_health(f), C.issues(f), f)
    assert {r.repo_id: r.change for r in V.impact(total(files), total(after)).collect()}["b"] < 0


def test_sources(spark, tmp_path):
    for path, text in {"go.mod": "// x\n module  example.org/m \n", "README.md": "r" * 20000, "pkg/a.go": "package a", "vendor/v.go": "package v", "_x/y.go": "", "out/z.go": "", "docs/adr.md": "why"}.items():
        at = tmp_path / "trees" / "r1" / path
        os.makedirs(at.parent, exist_ok=True)
        at.write_text(text)
    tree = R.pruned(R.read_trees(spark, str(tmp_path / "trees")), ("out/",))
    assert {(r.repo_id, r.path) for r in tree.select("repo_id", "path").collect()} == {("r1", p) for p in ("go.mod", "README.md", "pkg/a.go", "docs/adr.md")}
    row = R.trees(tree).first()
    assert row.has_go_mod and row.module_path == "example.org/m" and row.readme_size == 16384 and not row.has_ci_config and len(row.module_hash) == 64
    h = str(tmp_path / "history")
    for k, score in enumerate((50, 70)):
        one = spark.createDataFrame([("r1", score, "D")], "repo_id string, overall long, grade string")
        R.append_history(one, h, F.lit(f"c{k}"), F.to_timestamp(F.lit(f"2020-01-0{k + 1} 00:00:00")))
    assert [r.delta for r in R.history(spark, h).orderBy("timestamp").collect()] == [None, 20]
    files = spark.createDataFrame([file("r1", "pkg/a.go")], T.FILES)
    R.save_snapshot(files, str(tmp_path / "snap"), "v1")
    assert R.load_snapshot(spark, str(tmp_path / "snap"), "v1", T.FILES).count() == 1 and R.load_snapshot(spark, str(tmp_path / "snap"), "v2", T.FILES).count() == 0


def test_stream(spark, tmp_path):
    src, log, out, mark = (str(tmp_path / x) for x in ("src", "log", "out", "mark"))
    new = [[file("a", "m.go", [fn("BuildAll", 400)]) | {"deleted": False, "version": 1}], [file("a", "m.go", [fn("BuildAll", 400), fn("DropAll", 70)]) | {"deleted": False, "version": 2}], [file("a", "m.go") | {"deleted": True, "version": 3}]]
    got = []
    for k, rows in enumerate(new):
        spark.createDataFrame(rows, incremental.CHANGES).write.mode("append").parquet(src)
        incremental.follow(spark.readStream.schema(incremental.CHANGES).parquet(src), log, out, mark).awaitTermination(120)
        got.append([r.message for r in spark.read.schema(T.ISSUES).parquet(f"{out}/batch={k}").collect()])
    assert got == [["function BuildAll is 400 lines (>50)"], ["function DropAll is 70 lines (>50)"], []]
