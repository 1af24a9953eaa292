"""Modules, blueprints, checks and reports on facts written by hand."""

import json

import pytest

from lodeworks.operators import blueprints as B
from lodeworks.operators import facts as T
from lodeworks.operators import modules as M
from lodeworks.operators import reports as P
from lodeworks.sources import trees

FACTS = "repo_id string, path string, package string, structs array<string>, interfaces array<string>, interface_defs array<struct<name:string,methods:array<string>>>, functions array<struct<name:string,receiver:string>>"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def paths(spark, *per_repo):
    return spark.createDataFrame([(repo, p) for repo, ps in per_repo for p in ps], "repo_id string, path string")


def test_layouts_and_modules(spark):
    p = paths(
        spark,
        ("feature", ["internal/tax/domain/tax.go", "internal/tax/adapters/http/h.go", "internal/tax/adapters/x.go", "internal/tax/util.go", "internal/root.go", "cmd/main.go", "internal/pay/application/s.go", "x/internal/pay/adapters/grpc/g.go", "internal/tax/domain/readme.md"]),
        ("cross", ["internal/domain/ports.go", "internal/domain/scoring/a.go", "internal/adapters/outbound/scanner/s.go", "internal/adapters/inbound/cli.go", "internal/core/engine/e.go", "internal/tools/t.go", "internal/infra/db.go"]),
        ("none", ["main.go", "internal"]),
        ("half", ["internal/domain/a.go", "internal/tax/b.go"]),
    )
    assert dict(rows(M.layouts(p), "repo_id", "layout")) == {"feature": "per-feature", "cross": "cross-cutting", "none": "per-feature", "half": "cross-cutting"}
    members = M.module_files(p)
    got = {(r["repo_id"], r["path"]): (r["module"], r["layer"]) for r in members.collect()}
    assert got == {
        ("feature", "internal/tax/domain/tax.go"): ("tax", "domain"), ("feature", "internal/tax/adapters/http/h.go"): ("tax", "adapters"), ("feature", "internal/tax/adapters/x.go"): ("tax", None),
        ("feature", "internal/tax/util.go"): ("tax", None), ("feature", "internal/pay/application/s.go"): ("pay", "application"), ("feature", "x/internal/pay/adapters/grpc/g.go"): ("pay", "adapters"),
        ("cross", "internal/domain/ports.go"): ("domain", "domain"), ("cross", "internal/domain/scoring/a.go"): ("scoring", "domain"), ("cross", "internal/adapters/outbound/scanner/s.go"): ("scanner", "adapters"),
        ("cross", "internal/adapters/inbound/cli.go"): ("inbound", "adapters"), ("cross", "internal/core/engine/e.go"): ("engine", "application"), ("cross", "internal/infra/db.go"): ("infra", "adapters"),
        ("half", "internal/domain/a.go"): ("domain", "domain"),
    }
    assert ("feature", "tax", ["adapters", "domain"], 4) in rows(M.modules(members), "repo_id", "module", "layers", "n_files")
    assert dict(rows(M.architecture(members), "repo_id", "style")) == {"feature": "hexagonal", "cross": "hexagonal", "half": "layered"}


def module(name, entity, snake, *, handler=True, port=True, save=True):
    fn = lambda *x: [{"name": n, "receiver": r} for n, r in x]
    at, pascal = f"internal/{name}", name.capitalize()
    out = [
        (f"{at}/domain/aa_errors.go", [f"{pascal}Error"], [], fn()),
        (f"{at}/domain/{snake}.go", [entity, "Amount"], [], fn((f"New{entity}", ""), ("Validate", f"*{entity}"))),
        (f"{at}/domain/{snake}_test.go", ["Fake"], [], fn((f"TestNew{entity}", ""))),
        (f"{at}/application/{name}_service.go", [f"{pascal}Service"], [f"{entity}Store"] if port else [], fn((f"New{pascal}Service", ""), *([("Save", "*S")] if save else []))),
    ]
    if handler:
        out.append((f"{at}/adapters/http/{snake}_handler.go", [f"{entity}Handler"], [], fn(("Serve", f"*{entity}Handler"))))
    return [("r", p, "p", s, i, [], f) for p, s, i, f in out]


def test_blueprint_and_checks(spark):
    data = module("tax", "TaxRule", "tax_rule") + module("pay", "Payment", "payment", handler=False, save=False) + module("item", "Item", "item", port=False)
    data += [("r", "internal/bare/x.go", "p", [], [], [], []), ("x", "internal/a/domain/a_errors.go", "p", ["E"], [], [], []), ("x", "internal/a/domain/a_test.go", "p", ["F"], [], [], [])]
    files = spark.createDataFrame(data, FACTS)
    members = M.module_files(files)
    names = B.elements(files)
    scores = B.golden_scores(members, names)
    assert rows(scores.where("golden"), "repo_id", "module") == [("r", "tax"), ("x", "a")]
    assert dict(((r, m), e) for r, m, e in rows(B.entities(members, files), "repo_id", "module", "entity")) == {("r", "tax"): "TaxRule", ("r", "pay"): "Payment", ("r", "item"): "Item", ("r", "bare"): None, ("x", "a"): None}
    wanted, named, errors = B.blueprints(members, files, scores.where("golden"))
    assert rows(errors, "repo_id", "error") == [("x", "could not detect entity name for module a")]
    assert rows(wanted, "template", "type") == [
        ("adapters/http/{entity}_handler.go", "handler"), ("application/{module}_service.go", "service"), ("domain/aa_errors.go", "domain_errors"), ("domain/{entity}.go", "domain_entity"), ("domain/{entity}_test.go", "domain_test"),
    ]
    templates = {(k, t) for k, t in rows(named, "kind", "template")}
    assert {("struct", "{Entity}Error"), ("struct", "{Entity}"), ("function", "New{Entity}"), ("method", "Validate"), ("function", "New{Entity}Service"), ("interface", "{Entity}Store"), ("struct", "{Entity}Handler")} <= templates
    missing, issues, report = B.check(members, files, (wanted, named))
    got = {r["module"]: (r["score"], r["files"], r["structs"], r["methods"], r["interfaces"], r["patterns"]) for r in report.collect()}
    # pay lacks the handler's file, struct and method, and Save; item the port and so the pattern; bare has nothing
    assert got == {"pay": (75, 1, 1, 2, 0, 0), "item": (92, 0, 0, 0, 1, 1), "bare": (0, 5, 6, 6, 1, 3)}
    told = rows(issues.where("module = 'pay' OR module = 'item'"), "module", "severity", "category", "file", "message", "pattern")
    assert told == sorted([
        ("pay", "error", "completeness", None, "missing handler file: adapters/http/payment_handler.go", None),
        ("pay", "warning", "completeness", "internal/pay/application/pay_service.go", "missing method Save (expected from blueprint pattern Save)", None),
        ("item", "warning", "completeness", "internal/item/application/item_service.go", "missing interface ItemStore (expected from blueprint pattern {Entity}Store)", None),
        ("item", "warning", "pattern", None, "no interfaces defined (expected port interfaces)", "port_interfaces"),
    ], key=str)
    docs = {r["module"]: json.loads(r["json"]) for r in trees.check_documents(missing, issues, report).collect()}
    assert docs["pay"]["score"] == 75 and docs["pay"]["golden_module"] == "tax" and len(docs["pay"]["missing"]) == 4 and [i["severity"] for i in docs["pay"]["issues"]] == ["error", "warning"]
    assert docs["bare"]["score"] == 0 and len(docs["item"]["issues"]) == 2
    assert rows(B.examples(wanted, "handler"), "file") == [("internal/tax/adapters/http/tax_rule_handler.go",)]


def test_implementations(spark):
    port = [("r", "a.go", "core", [], [], [{"name": "Store", "methods": ["Get", "Put", "Del"]}, {"name": "None", "methods": []}], [])]
    have = lambda path, package, *m: ("r", path, package, [], [], [], [{"name": n, "receiver": r} for n, r in m])
    all_ = [("Get", "*Sql"), ("Put", "*Sql"), ("Del", "Sql")]
    files = spark.createDataFrame(port + [have("b.go", "db", *all_), have("c.go", "core", *all_), have("d.go", "mem", ("Get", "*M"), ("Put", "*M")), have("e.go", "mem", ("Del", "*M"))], FACTS)
    got = B.implementations(B.interface_methods(files), B.receiver_methods(files))
    assert rows(got, "interface", "defined", "implementation", "file", "package") == [("Store", "a.go", "Sql", "b.go", "db")]


@pytest.mark.parametrize("parts", [1, 200])
def test_order_of_issues_is_stable(spark, parts):
    data = [("r", s, c, None, f, n, "m", None, False, o) for n, (s, c, f, o) in enumerate([("info", "structure", "b", 14), ("error", "predictability", "a", 19), ("error", "code_health", "z", 3), ("warning", "code_health", None, 0), ("error", "code_health", "z", 1)])]
    data += [("q", "info", "structure", None, f"f{n:03d}", n, "m", None, False, 14) for n in range(300)]
    kind = "repo_id string, severity string, category string, sub_metric string, file string, line int, message string, pattern string, fix_available boolean, ordinal int"
    got = P.in_order(spark.createDataFrame(data, kind).repartition(parts))
    assert [r["line"] for r in sorted(got.where("repo_id = 'r'").collect(), key=lambda r: r["place"])] == [4, 2, 1, 3, 0]
    assert [r["line"] for r in sorted(got.where("repo_id = 'q'").collect(), key=lambda r: r["place"])] == list(range(300))
    assert rows(P.for_file(got, "f007"), "line") == [(7,)]


def test_drift_and_fixes(spark):
    kind = "repo_id string, severity string, category string, sub_metric string, file string, line int, message string, ordinal int"
    data = [
        ("r", "info", "discoverability", None, "a.go", 1, 'file "a.go" uses bare naming', 6), ("r", "info", "discoverability", "dependency_direction", "b.go", 2, "x", 8), ("r", "info", "structure", None, None, None, "y", 14),
        ("r", "info", "code_health", "cognitive_complexity", "c.go", 3, "function f is odd", 1), ("r", "info", "code_health", None, "d.go", 4, "a param", 2), ("r", "info", "context_quality", None, None, None, "doc", 17), ("r", "info", "predictability", None, None, None, "z", 18),
        ("r", "error", "verifiability", None, "k/l/m.go", None, "missing test_presence: none", 16),
    ]
    issues = spark.createDataFrame(data, kind)
    norms = spark.createDataFrame([("r", "bare", 0.625, 40, 200, 3, 3, None)], "repo_id string, style string, style_share double, function_lines int, file_lines int, parameters int, layers int, golden string")
    got = sorted(P.by_priority(P.instructions(issues, norms)).collect(), key=lambda r: r["place"])
    assert [(r["type"], r["priority"], r["project_norm"]) for r in got] == [
        ("dependency_drift", "high", "domain/ has zero adapter imports"), ("structure_drift", "high", "consistent module structure"), ("size_drift", "medium", "p90 function length: 40 lines"),
        ("size_drift", "medium", "p90 parameter count: 3"), ("naming_drift", "medium", "bare naming (62% of files)"), ("missing_docs", "low", "see internal/domain/ for doc style"),
    ]
    assert rows(P.drift(issues, norms), "drift_type", "message") == sorted([
        ("naming_drift", 'file "a.go" uses bare naming'), ("dependency_drift", "x"), ("structure_drift", "y"), ("size_drift", "function f is odd (project p90: 40 lines)"), ("size_drift", "a param (project p90: 40 lines)"),
    ], key=str)
    tree = paths(spark, ("r", ["k/l/m.go"]), ("s", ["CLAUDE.md"]))
    assert rows(P.safe_fixes(issues, tree), "repo_id", "path") == [("r", "CLAUDE.md"), ("r", "k/l/l_test.go")]
    assert rows(P.safe_fixes(issues, tree.union(paths(spark, ("r", ["k/l/l_test.go"])))), "path") == [("CLAUDE.md",)]


def test_letters_and_configuration(spark):
    fn = lambda n, *ps: {"name": n, "receiver": "", "exported": True, "line_start": 1, "params": [{"name": p, "type": "int"} for p in ps]}
    fields = [f.split(":")[0] for f in T.FUNCTION[7:-1].split(",") if ":" in f and not f.startswith("type")]
    full = lambda f: {k: f.get(k) for k in fields}
    data = [("r", "a.go", "p", False, 0, 9, False, False, [], [], [], [], [], [], [], [full(fn("A", "r", "w")), full(fn("B", "r", "r")), full(fn("C", "b", "r", "g")), full(fn("D", "a", "z")), full(fn("E", "a")), full(fn("F", "a", "id"))])]
    files = spark.createDataFrame(data, T.FILES)
    assert rows(P.letter_issues(files), "message") == [('exported function "B" has 2 single-letter parameters',), ('exported function "D" has 2 single-letter parameters',)]
    metrics = spark.createDataFrame([("r", c, n, s, 25) for c, n, s in [("structure", "a", 20), ("structure", "b", 5), ("predictability", "c", 10), ("verifiability", "d", 25)]], "repo_id string, category string, name string, score long, points long")
    scores = spark.createDataFrame([("r", "structure", 25), ("r", "predictability", 10), ("r", "verifiability", 25)], "repo_id string, category string, score long")
    found = spark.createDataFrame([("r", "info", "structure", "b", None, None, "gone", None), ("r", "info", "structure", None, None, None, "stays", None), ("r", "info", "predictability", None, None, None, "gone", None)], T.ISSUES)
    config = spark.createDataFrame([("structure", "b"), ("predictability", None)], "category string, sub_metric string")
    weights = spark.createDataFrame([("structure", 0.3), ("verifiability", 0.0)], "category string, weight double")
    from lodeworks.operators import reports

    cats, left, kept = reports.configured(metrics, found, scores, config, weights)
    assert rows(cats, "category", "score", "weight") == [("structure", 80, 0.3), ("verifiability", 25, 0.15)]
    assert rows(left, "message") == [("stays",)] and rows(kept.where("skipped"), "name", "score") == [("b", 0)]
    assert rows(reports.overall(cats), "overall", "grade") == [(62, "C")]


def test_graph_documents(spark):
    from lodeworks.operators import packages as G

    kind = "repo_id string, path string, is_generated boolean, imports array<string>, interfaces array<string>, structs array<string>, functions array<struct<name:string,receiver:string,params:array<struct<name:string,type:string>>>>"
    data = [("r", f"{a}/x.go", False, [f"m/{b}"], [], ["T"], []) for a, b in (("a", "b"), ("b", "a"), ("c", "a"))]
    files, tree = spark.createDataFrame(data, kind), spark.createDataFrame([("r", "m")], "repo_id string, module_path string")
    nodes, edges = G.package_graph(files, tree)
    nodes = G.coupled(nodes, edges)
    report = G.graph_report(nodes, G.package_roles(nodes), spark.createDataFrame([], "repo_id string, package string, message string"))
    got = [(r["package"], json.loads(r["json"])) for r in trees.graph_documents(nodes, report, G.import_cycles(edges)).collect()]
    assert {p for p, _ in got} == {"m/a", "m/b", "m/c", None} and [d["cycle"] for p, d in got if p is None] == [["m/a", "m/b"]]
    one = dict(got)["m/a"]
    assert (one["ca"], one["ce"]) == (2, 1) and abs(one["instability"] - 1 / 3) < 1e-9
    issues = P.graph_issues(nodes, edges)
    assert rows(issues, "message") == [("import cycle: m/a → m/b",)]
