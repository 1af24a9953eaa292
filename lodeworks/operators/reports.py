"""Reports over all scorers: one table of issues in a fixed order, categories under a configuration, drift, and fix plans.

Every emitter's issues are one shape; ``ordinal`` is the emitter's number and travels through the union, so that the order
of issues is that of their contents, whatever the partitions. Issues for what is not there come from left joins with the
repositories, not from loops over what each should have.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import scoring as S
from lodeworks.operators import facts as T
from lodeworks.operators import layout as L
from lodeworks.operators import packages as P
from lodeworks.operators import relational as R
from lodeworks.operators import scorers as C

# Categories in their order, severities and priorities from the most urgent.
CATEGORIES = ("code_health", "discoverability", "structure", "verifiability", "context_quality", "predictability")
SEVERITIES = ("error", "warning", "info")
PRIORITIES = ("high", "medium", "low")
# Parameter names, as sets, that say enough in one letter each.
IDIOMS = ("w r", "i j", "k v", "x y", "a b", "p q", "n m", "r g b")
#: Emitters in the order in which their issues stand within a category.
EMITTERS = (
    "function_size cognitive_complexity parameter_count file_size code_duplication short_name file_naming missing_layer layer_direction import_cycle "
    "coupling shared_name vague_package letters no_modules no_interface unverified no_agent_doc no_errors package_state init_function"
).split()
SHAPE = ("repo_id", "severity", "category", "sub_metric", "file", "line", "message", "pattern", "fix_available", "ordinal")


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(value == x, F.lit(i)) for i, x in enumerate(order)], F.lit(len(order)))


def _shaped(rows: DataFrame, emitter: str | Column, **given) -> DataFrame:
    """rows as issues of SHAPE; what they lack comes from ``given``, or is null."""
    kinds = {"line": "int", "fix_available": "boolean"}
    number = _rank(emitter, tuple(EMITTERS)) if isinstance(emitter, Column) else F.lit(EMITTERS.index(emitter))
    put = lambda c: given[c] if isinstance(given.get(c), Column) else F.lit(given.get(c, False if c == "fix_available" else None)) if c not in rows.columns else F.col(c)
    return rows.select(*[put(c).cast(kinds.get(c, "string")).alias(c) for c in SHAPE[:-1]], number.cast("int").alias("ordinal"))


def letter_issues(files: DataFrame) -> DataFrame:
    """Issues of exported functions whose two or more parameters have one letter each and are no set of IDIOMS.

    A function's set of names is one canonical key, sorted and distinct, which is looked up among those of the idioms.
    """
    names = F.transform("fn.params", lambda x: x["name"])
    key = F.array_join(F.sort_array(F.array_distinct(names)), " ")
    known = [" ".join(sorted(x.split())) for x in IDIOMS]
    fns = T.functions(files.where("NOT coalesce(is_generated, false)")).where("NOT test AND fn.exported AND coalesce(fn.receiver, '') = '' AND size(fn.params) >= 2")
    odd = fns.where(F.forall(names, lambda x: F.octet_length(x) == 1) & ~key.isin(known))
    # The message.
    message = F.format_string('exported function "%s" has %d single-letter parameters', "fn.name", F.size("fn.params"))
    return _shaped(odd, "letters", severity="info", category="discoverability", sub_metric="naming_uniqueness", file=F.col("path"), line=F.col("fn.line_start"), message=message)


def absence_issues(files: DataFrame, paths: DataFrame, trees: DataFrame, members: DataFrame, p: C.Profile = C.Profile()) -> DataFrame:
    """Issues of what a repository of files has not: modules, agent documents, error handling, or any credit in verifiability.

    trees has repo_id, has_claude, has_cursor and has_agents beside what the scorers read.
    """
    repos = files.select("repo_id").distinct()
    bare = repos.join(members.select("repo_id").distinct(), "repo_id", "left_anti")
    # The documents, how urgent each is, and the messages.
    documents = (
        ("has_claude", "warning", "CLAUDE.md not found; add it to provide AI agents with project context"), ("has_cursor", "info", ".cursorrules not found; add it for Cursor IDE integration"),
        ("has_agents", "info", "AGENTS.md not found; add it to describe agent workflows"),
    )
    lack = [F.when(~F.coalesce(F.col(c), F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for c, s, m in documents]
    docs = repos.join(trees, "repo_id", "left").select("repo_id", F.explode(F.array_compact(F.array(*lack))).alias("i")).select("repo_id", "i.*")
    calls = F.sum(F.when(~T.is_test(F.col("path")), F.size(F.coalesce("error_calls", F.array().cast(files.schema["error_calls"].dataType)))).otherwise(0))
    silent = files.groupBy("repo_id").agg(calls.alias("n")).where("n = 0")
    return reduce(DataFrame.unionByName, [
        _shaped(bare, "no_modules", severity="warning", category="structure", message="no modules detected; cannot evaluate structure"),
        _shaped(C.verifiability_issues(files, paths, trees, p), "unverified"),
        _shaped(docs, "no_agent_doc", category="context_quality", fix_available=True),
        _shaped(silent, "no_errors", severity="info", category="predictability", message="no error handling found across all source files"),
    ])


def layout_issues(files: DataFrame, members: DataFrame, expected: tuple[str, ...], convention: str = "auto") -> DataFrame:
    """Issues of file names, layers that modules lack, imports against the direction of layers, and layers without interfaces."""
    at = members.select("repo_id", F.col("module").alias("name"), F.concat(F.lit("internal/"), "module").alias("file")).distinct()
    n = at.groupBy("repo_id").agg(F.count("*").alias("n"))
    peers = members.where("layer IS NOT NULL").groupBy("repo_id", "layer").agg(F.count_distinct("module").alias("c"))
    lack = L.missing_layers(members).join(at, ["repo_id", "name"]).join(n, "repo_id").join(peers, ["repo_id", "layer"])
    # Messages.
    few = F.format_string('module "%s" is missing "%s" layer that %d/%d peers have', "name", "layer", "c", "n")
    wrong = F.format_string("%s layer imports %s (dependency direction violation)", "layer", "import")
    alone = F.format_string('module "%s" has domain/application layer but no port interfaces', "name")
    return reduce(DataFrame.unionByName, [
        _shaped(L.naming_issues(files, expected, convention), "file_naming", category="discoverability", sub_metric="file_naming_conventions"),
        _shaped(lack, "missing_layer", category="discoverability", sub_metric="predictable_structure", message=few),
        _shaped(L.layer_violations(files, members)[0], "layer_direction", severity="error", category="discoverability", sub_metric="dependency_direction", file=F.col("path"), message=wrong),
        _shaped(L.bare_contracts(members, files), "no_interface", severity="warning", category="structure", sub_metric="interface_contracts", message=alone),
    ])


def graph_issues(nodes: DataFrame, edges: DataFrame, times: float = P.OUTLIER_TIMES) -> DataFrame:
    """Issues of import cycles, one for each that the search reports, and of packages that import far more than most."""
    # Messages.
    round_ = F.concat(F.lit("import cycle: "), F.array_join("cycle", " → "))
    wide = F.format_string('package "%s" imports %d internal packages (median is %.0f)', "package", "ce", F.bround("median"))
    return _shaped(P.import_cycles(edges), "import_cycle", severity="error", category="discoverability", sub_metric="dependency_direction", message=round_, pattern="import-cycle").unionByName(
        _shaped(P.coupling_outliers(nodes, times), "coupling", severity="warning", category="discoverability", sub_metric="dependency_direction", message=wide, pattern="coupling-outlier")
    )


def clone_issues(tokens: DataFrame, width: int = L.CLONE_TOKENS, percent: int = L.CLONE_PERCENT) -> DataFrame:
    """Issues of files with too many cloned lines, of token files as layout.duplication takes them."""
    over = L.duplication(tokens, width, percent).where("percent > most")
    # The message.
    message = F.format_string("file has %d%% duplicated lines (%d lines, >%d%%)", "percent", "lines", "most")
    return _shaped(over, "code_duplication", severity=S.issue_severity(F.col("percent"), F.col("most")), category="code_health", sub_metric="code_duplication", file=F.col("path"), message=message)


def file_issues(files: DataFrame, p: C.Profile = C.Profile()) -> DataFrame:
    """The issues of scorers.issues, numbered."""
    found = C.issues(files, p)
    said = lambda x: F.contains(F.col("message"), F.lit(x))
    emitter = (
        F.when(F.col("category") == "code_health", F.col("sub_metric")).when(said("appears in"), "shared_name").when(said("is a vague name"), "vague_package")
        .when(F.col("category") == "discoverability", "short_name").when(said("init()"), "init_function").otherwise("package_state")
    )
    return _shaped(found, emitter)


def all_issues(files, paths, trees, members, expected, nodes=None, edges=None, tokens=None, p: C.Profile = C.Profile()) -> DataFrame:
    """Every emitter's issues in one table of SHAPE; those of graphs and clones where their facts are given."""
    parts = [file_issues(files, p), letter_issues(files), absence_issues(files, paths, trees, members, p), layout_issues(files, members, expected)]
    if nodes is not None:
        parts.append(graph_issues(nodes, edges))
    if tokens is not None:
        parts.append(clone_issues(tokens))
    return reduce(DataFrame.unionByName, parts)


def in_order(issues: DataFrame) -> DataFrame:
    """issues with ``place``, from 0 in each repository: by severity, then category, emitter, file, line and message.

    A range sort and counts a partition; no repository is sorted by one task.
    """
    rows = issues.withColumn("_s", _rank(F.col("severity"), SEVERITIES)).withColumn("_c", _rank(F.col("category"), CATEGORIES))
    return R.placed(rows, ["repo_id"], ["_s", "_c", "ordinal", "file", "line", "message"], "place").drop("_s", "_c")


def for_file(issues: DataFrame, name: str) -> DataFrame:
    """The issues of a file, named by its path or by the last segments of it."""
    return issues.where((F.col("file") == name) | F.endswith("file", F.lit(f"/{name}")))


def drift_type(category: Column, sub_metric: Column) -> Column:
    """What kind of drift an issue is; null if none."""
    found = F.when(sub_metric == "dependency_direction", "dependency_drift").otherwise("naming_drift")
    return F.when(category == "discoverability", found).when(category == "structure", "structure_drift").when(category == "code_health", "size_drift")


def drift(issues: DataFrame, norms: DataFrame) -> DataFrame:
    """Rows (repo_id, file, line, severity, message, category, drift_type); sizes are told beside the project's norm (repo_id, function_lines)."""
    rows = issues.withColumn("drift_type", drift_type(F.col("category"), F.col("sub_metric"))).where("drift_type IS NOT NULL").join(norms.select("repo_id", "function_lines"), "repo_id", "left")
    # The message's end.
    told = F.format_string("%s (project p90: %d lines)", "message", "function_lines")
    message = F.when((F.col("drift_type") == "size_drift") & (F.col("function_lines") > 0), told).otherwise(F.col("message"))
    return rows.select("repo_id", "file", "line", "severity", message.alias("message"), "category", "drift_type")


def instructions(issues: DataFrame, norms: DataFrame) -> DataFrame:
    """issues that a rule maps to a correction, with type, priority and project_norm: the first rule that holds, in one projection.

    norms (repo_id, style, style_share, function_lines, file_lines, parameters, layers, golden) is a row a repository.
    """
    sub, message, category = F.col("sub_metric"), F.col("message"), F.col("category")
    says = lambda *words: reduce(lambda a, b: a | b, [F.contains(message, F.lit(w)) for w in words])
    is_ = lambda name, *words: F.coalesce(sub == name, F.lit(False)) | says(*words)
    # The rules in order; what each gives, and how the norm is told.
    golden = F.when(F.col("golden").isNotNull(), F.format_string("%d layers per module (golden: %s)", "layers", "golden")).otherwise("consistent module structure")
    rules = (
        ("discoverability", is_("file_naming_conventions", "naming"), "naming_drift", "medium", F.format_string("%s naming (%.0f%% of files)", "style", F.bround(F.col("style_share") * 100))),
        ("discoverability", is_("dependency_direction", "dependency", "imports"), "dependency_drift", "high", F.lit("domain/ has zero adapter imports")),
        ("structure", F.lit(True), "structure_drift", "high", golden),
        ("code_health", is_("function_size", "function", "lines"), "size_drift", "medium", F.format_string("p90 function length: %d lines", "function_lines")),
        ("code_health", is_("file_size", "file"), "size_drift", "medium", F.format_string("p90 file length: %d lines", "file_lines")),
        ("code_health", is_("parameter_count", "param"), "size_drift", "medium", F.format_string("p90 parameter count: %d", "parameters")),
        ("context_quality", says("doc"), "missing_docs", "low", F.lit("see internal/domain/ for doc style")),
    )
    hits = [F.when((category == c) & when, F.struct(F.lit(t).alias("type"), F.lit(p).alias("priority"), norm.alias("project_norm"))) for c, when, t, p, norm in rules]
    rows = issues.join(norms, "repo_id", "left").withColumn("_hit", F.coalesce(*hits)).where("_hit IS NOT NULL")
    return rows.select("repo_id", "_hit.type", "file", "line", "message", "_hit.project_norm", "_hit.priority", "category", "severity", "ordinal")


def by_priority(rows: DataFrame) -> DataFrame:
    """instructions with ``place``, from 0 in each repository: by priority, then as issues stand in their categories."""
    for name, column, order in (("_p", "priority", PRIORITIES), ("_c", "category", CATEGORIES), ("_s", "severity", SEVERITIES)):
        rows = rows.withColumn(name, _rank(F.col(column), order))
    return R.placed(rows, ["repo_id"], ["_p", "_c", "ordinal", "file", "line", "message", "_s"], "place").drop("_p", "_c", "_s")


def safe_fixes(issues: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows (repo_id, type, path, description): files that may be created: the contract for agents, and a test for each folder with an
    issue of verifiability that speaks of tests and no such test yet."""
    # The file's name, the type and descriptions.
    name = "CLAUDE.md"
    repos = paths.select("repo_id").distinct()
    none = repos.join(paths.where(F.col("path") == name).select("repo_id").distinct(), "repo_id", "left_anti")
    one = none.select("repo_id", F.lit("create_file").alias("type"), F.lit(name).alias("path"), F.lit("Generated consistency contract from codebase analysis").alias("description"))
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    told = issues.where((F.col("category") == "verifiability") & F.contains("message", F.lit("test"))).select("repo_id", folder.alias("folder")).distinct()
    base = F.element_at(F.split("folder", "/"), -1)
    stub = F.when(F.col("folder") == ".", F.lit("._test.go")).otherwise(F.concat("folder", F.lit("/"), base, F.lit("_test.go")))
    stubs = told.select("repo_id", F.lit("create_file").alias("type"), stub.alias("path"), F.concat(F.lit("Test stub for package "), base).alias("description"))
    return one.unionByName(stubs.join(paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").select(one.columns))


def onboard_naming(paths: DataFrame) -> DataFrame:
    """Rows (repo_id, style, style_share): suffixed if more names of source files have an underscore than not, else bare."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.go$", "")
    own = paths.where(F.endswith("path", F.lit(".go")) & ~T.is_test(F.col("path"))).where(~base.isin("main", "doc"))
    s, n = F.count_if(F.contains(base, F.lit("_"))), F.count("*")
    found = own.groupBy("repo_id").agg(F.when(2 * s > n, "suffixed").otherwise("bare").alias("style"), (F.greatest(s, n - s) / n).alias("style_share"))
    return paths.select("repo_id").distinct().join(found, "repo_id", "left").na.fill({"style": "bare", "style_share": 0.0})


def build_commands(paths: DataFrame, trees: DataFrame) -> DataFrame:
    """Rows (repo_id, build, test), one a build file of a repository and one for its module file (trees: repo_id, has_go_mod)."""
    # Build files and their commands.
    tools = {"makefile": "make", "taskfile.yml": "task", "taskfile.yaml": "task", "justfile": "just"}
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    tool = F.coalesce(*[F.when(base == k, F.lit(v)) for k, v in tools.items()])
    found = paths.select("repo_id", tool.alias("t")).where("t IS NOT NULL").select("repo_id", F.concat("t", F.lit(" build")).alias("build"), F.concat("t", F.lit(" test")).alias("test"))
    return found.unionByName(trees.where("has_go_mod").select("repo_id", F.lit("go build ./...").alias("build"), F.lit("go test ./...").alias("test")))


def configured(metrics: DataFrame, found: DataFrame, scores: DataFrame, config: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Category scores, issues and sub-metrics under a configuration.

    config (category, sub_metric) names what is skipped, a whole category where sub_metric is null; weights (category,
    weight) overrides weights, 0 meaning none given. A category with skipped sub-metrics is scored again from the points
    of the others. Both are lists of a few rows, the same for all repositories.
    """
    off = F.broadcast(config.where("sub_metric IS NULL").select("category").distinct())
    skip = F.broadcast(config.where("sub_metric IS NOT NULL").select("category", F.col("sub_metric").alias("name")).distinct())
    kept = metrics.join(off, "category", "left_anti").join(skip.withColumn("skipped", F.lit(True)), ["category", "name"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    kept = kept.withColumn("score", F.when(F.col("skipped"), 0).otherwise(F.col("score")))
    points = F.sum(F.when(~F.col("skipped"), F.col("points")))
    again = kept.groupBy("repo_id", "category").agg(F.bool_or("skipped").alias("some"), points.alias("points"), F.sum("score").alias("earned"))
    new = F.when(F.col("some") & (F.coalesce("points", F.lit(0)) > 0), F.round(F.col("earned") / F.col("points") * 100).cast("long")).otherwise(F.col("score"))
    own = weights.select("category", F.col("weight").alias("_w"))
    base = F.coalesce(*[F.when(F.col("category") == c, F.lit(float(w))) for c, w in C.WEIGHTS.items()])
    cats = scores.join(again, ["repo_id", "category"]).join(F.broadcast(own), "category", "left")
    cats = cats.select("repo_id", "category", new.alias("score"), F.when(F.col("_w") > 0, F.col("_w")).otherwise(base).alias("weight"))
    left = found.join(off, "category", "left_anti").join(skip.withColumnRenamed("name", "sub_metric"), ["category", "sub_metric"], "left_anti")
    return cats, left, kept


def overall(cats: DataFrame) -> DataFrame:
    """Rows (repo_id, overall, grade) of cats (repo_id, category, score, weight)."""
    w = F.sum("weight")
    mean = F.round(F.sum(F.col("score") * F.col("weight")) / F.nullif(w, F.lit(0.0)))
    return cats.groupBy("repo_id").agg(F.coalesce(mean, F.lit(0.0)).cast("long").alias("overall")).withColumn("grade", S.grade(F.col("overall")))


@dataclass(frozen=True)
class Layout:
    """What a project's layout should be: suffixes of files, their convention, folders, layers, and documents (name, points, least size)."""

    suffixes: tuple[str, ...] = ()
    convention: str = "auto"
    folders: tuple[str, ...] = ()
    layers: tuple[str, ...] = ()
    documents: tuple[tuple[str, int, int], ...] = ()


def all_metrics(files, paths, trees, members, graph, documents, tokens=None, layout: Layout = Layout(), p: C.Profile = C.Profile()) -> DataFrame:
    """Rows (repo_id, category, name, score, points): every sub-metric of every repository of files.

    graph is packages.graph_score's, documents has (repo_id, name, size) of those that are there, and tokens is as
    layout.duplication takes it; without it nothing is cloned.
    """
    repos = files.select("repo_id").distinct()
    found = L.layer_violations(files, members)[1]
    wanted = files.sparkSession.createDataFrame(list(layout.documents), "name string, points int, min_size int")  # a configuration list
    agents = L.agent_files(documents.select("repo_id", "name", "size"), wanted).select("repo_id", "score") if layout.documents else repos.select("repo_id", F.lit(0).alias("score"))
    clones = L.code_duplication(tokens) if tokens is not None else repos.select("repo_id", F.lit(20).alias("score"))
    # category, name, points, scores, and the score of a repository that they lack
    parts = (
        ("code_health", "code_duplication", 20, clones, 20),
        ("discoverability", "file_naming_conventions", 25, L.file_naming(files, layout.suffixes, layout.convention), 0),
        ("discoverability", "predictable_structure", 25, L.predictable_structure(members, files, layout.suffixes, layout.convention), 25),
        ("discoverability", "dependency_direction", 25, L.dependency_direction(repos, found, graph), 25),
        ("structure", "expected_layers", 25, L.expected_layers(members, paths, layout.folders, layout.layers), 0),
        ("structure", "expected_files", 25, L.expected_files(members, layout.suffixes), 0),
        ("context_quality", "ai_context_files", sum(d[1] for d in layout.documents) or 30, agents, 0),
    )
    extra = [
        repos.join(df.select("repo_id", "score"), "repo_id", "left").select(
            "repo_id", F.lit(c).alias("category"), F.lit(n).alias("name"), F.coalesce("score", F.lit(none)).cast("long").alias("score"), F.lit(most).cast("long").alias("points")
        )
        for c, n, most, df, none in parts
    ]
    sized = members.groupBy("repo_id", F.col("module").alias("name")).agg(F.collect_set("layer").alias("layers"), F.count("*").alias("n_files"))  # a few layers a module
    own = [C.code_health(files, p), C.naming_uniqueness(files, p), C.structure(files, sized), C.verifiability(files, paths, trees, p), C.context_quality(files, paths, trees), C.predictability(files, p)]
    return reduce(DataFrame.unionByName, [*own, *extra])


def score_repositories(files, paths, trees, members, nodes, edges, documents, tokens=None, layout: Layout = Layout(), p: C.Profile = C.Profile()):
    """(metrics, categories, overall, issues) of all repositories, from facts, detected modules and a coupled package graph."""
    node = lambda c: F.struct("repo_id", F.col(c).alias("package")).alias(c)
    graph = P.graph_score(nodes, R.cycle_members(edges.select(node("src"), node("dst"))).select("node.*"))
    metrics = R.durable(all_metrics(files, paths, trees, members, graph, documents, tokens, layout, p))
    found = R.durable(all_issues(files, paths, trees, members, layout.suffixes, nodes, edges, tokens, p))
    cats = C.category_scores(metrics, found, files)
    return metrics, cats, C.overall(cats), found
