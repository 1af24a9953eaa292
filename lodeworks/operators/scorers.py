"""Scorers over facts: sub-metrics of six categories, issues, category and overall scores, for many repositories at once.

All measures of one grain are conditional aggregates of one ``groupBy``, so a category costs one shuffle a grain, with
partial aggregation before it; a large repository is combined map-side and never gathered. Every scorer returns rows
(repo_id, category, name, score, points).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import scoring as S
from lodeworks.operators import facts as T

# Weights of categories.
WEIGHTS = {"code_health": 0.25, "discoverability": 0.20, "structure": 0.15, "verifiability": 0.15, "context_quality": 0.15, "predictability": 0.10}
# Words of names by how little they say, package names that say nothing, build files.
GENERIC = "get set do run handle process execute make data info item object thing stuff temp manager handler helper util".split()
ACTION = "validate parse format convert transform compute calculate build render".split()
VAGUE_PACKAGES = "util utils common helpers misc base lib shared tools types".split()
BUILD_FILES = "makefile taskfile.yml taskfile.yaml justfile".split()
LINTER_FILES = [".golangci.yml", ".golangci.yaml"]


@dataclass(frozen=True)
class Profile:
    """Limits of the scorers."""

    function_lines: int = 50
    file_lines: int = 300
    complexity: int = 25
    parameters: int = 4
    cgo_parameters: int = 12
    template_ratio: float = 0.8
    template_times: int = 5
    exempt_prefixes: tuple[str, ...] = ("Reconstruct",)
    test_ratio: float = 0.5
    global_penalty: int = 3
    word_score: float = 0.7
    naming_weights: tuple[float, float, float, float] = (0.30, 0.30, 0.25, 0.15)


def _rows(wide: DataFrame, category: str, points: dict[str, int]) -> DataFrame:
    """One row a sub-metric of wide (repo_id and a column for each)."""
    each = [F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("score"), F.lit(p).cast("long").alias("points")) for n, p in points.items()]
    return wide.select("repo_id", F.lit(category).alias("category"), F.explode(F.array(*each)).alias("m")).select("repo_id", "category", "m.*")


def _repos(files: DataFrame) -> DataFrame:
    return files.select("repo_id").distinct()


def _share(part: Column, whole: Column, points: int, none: int = 0) -> Column:
    """trunc(part / whole * points), ``none`` without a whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(none)).otherwise(F.least(F.floor(part / whole * F.lit(float(points))), F.lit(points)))


def _mean(credit: Column, points: int) -> Column:
    """round(mean credit * points), full points without rows."""
    return F.coalesce(F.least(F.round(F.avg(credit) * F.lit(float(points))), F.lit(float(points))), F.lit(float(points)))


def limits(fns: DataFrame, p: Profile) -> DataFrame:
    """fns with the limits that hold for each function: max_lines, max_cc, max_params, and dispatch and exempt flags."""
    template = F.col("fn.string_literal_ratio") > p.template_ratio
    plain_test = F.col("test") & (F.col("fn.max_nesting") <= 2) & (F.col("fn.max_cond_ops") <= 1)
    dispatch = F.coalesce((F.col("fn.max_case_arms") >= 10) & (F.col("fn.avg_case_lines") <= 3.0), F.lit(False))
    lines = F.when(F.col("test"), 2 * p.function_lines).otherwise(p.function_lines)
    params = F.when(F.col("test"), p.parameters + 2).otherwise(p.parameters)
    exempt = reduce(lambda a, b: a | b, [F.startswith(F.col("fn.name"), F.lit(x)) for x in p.exempt_prefixes], F.lit(False))
    return fns.select(
        "*",
        F.when(template, lines * p.template_times).when(plain_test | dispatch, p.function_lines * p.template_times).otherwise(lines).alias("max_lines"),
        F.when(F.col("test"), p.complexity + 5).otherwise(p.complexity).alias("max_cc"),
        F.when(F.col("has_cgo"), F.greatest(params, F.lit(p.cgo_parameters))).otherwise(params).alias("max_params"),
        dispatch.alias("dispatch"), exempt.alias("exempt"), F.coalesce(F.size("fn.params"), F.lit(0)).alias("n_params"),
    )


def code_health(files: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Sizes of functions and files, complexity and parameters (20 points each); generated files take no part."""
    own = files.where("NOT coalesce(is_generated, false)")
    fns = limits(T.functions(own), p)
    by_fn = fns.groupBy("repo_id").agg(
        _mean(F.when(F.col("lines") > 0, S.decay_credit(F.col("lines"), F.col("max_lines"))), 20).alias("function_size"),
        _mean(F.when(F.col("dispatch"), 1.0).otherwise(S.decay_credit(F.col("fn.cognitive_complexity"), F.col("max_cc"))), 20).alias("cognitive_complexity"),
        _mean(F.when(F.col("exempt"), 1.0).otherwise(S.decay_credit(F.col("n_params"), F.col("max_params"))), 20).alias("parameter_count"),
    )
    most = F.when(T.is_test(F.col("path")), 2 * p.file_lines).otherwise(p.file_lines)
    by_file = own.groupBy("repo_id").agg(_mean(F.when(F.col("total_lines") > 0, S.decay_credit(F.col("total_lines"), most)), 20).alias("file_size"))
    points = dict.fromkeys(("function_size", "file_size", "cognitive_complexity", "parameter_count"), 20)
    wide = _repos(files).join(by_fn, "repo_id", "left").join(by_file, "repo_id", "left").na.fill(20.0)
    return _rows(wide, "code_health", points)


def naming_uniqueness(files: DataFrame, p: Profile = Profile()) -> DataFrame:
    """25 points: word counts, specificity, entropy and collisions of exported names. None exported: 0."""
    own = files.where("NOT coalesce(is_generated, false)")
    fns = T.functions(own).where("fn.exported").select("repo_id", "package", "test", F.col("fn.name").alias("name"), F.col("fn.receiver").alias("receiver"))
    # a row a distinct name from here on; vocabularies are joined by word, never gathered
    names = fns.groupBy("repo_id", "name").agg(
        F.count("*").alias("c"),
        F.min(F.when(~F.col("test") & (F.coalesce("receiver", F.lit("")) == ""), F.col("package"))).alias("low"),
        F.max(F.when(~F.col("test") & (F.coalesce("receiver", F.lit("")) == ""), F.col("package"))).alias("high"),
    ).withColumn("words", S.camel_words(F.col("name")))
    types = own.select("repo_id", F.explode(F.concat(F.coalesce("structs", F.array()), F.coalesce("interfaces", F.array()))).alias("t"))
    vocabulary = types.select("repo_id", F.explode(S.camel_words(F.col("t"))).alias("w")).select("repo_id", F.lower("w").alias("w"), F.lit(True).alias("known")).distinct()
    words = names.select("repo_id", "name", F.explode("words").alias("w")).withColumn("w", F.lower("w")).join(vocabulary, ["repo_id", "w"], "left")
    says = F.when(F.col("w").isin(GENERIC), 0.0).when(F.col("w").isin(ACTION), 0.5).when(F.col("known"), 1.0).otherwise(0.75)
    specific = words.groupBy("repo_id", "name").agg(F.avg(says).alias("says"))
    n = F.sum("c").over(Window.partitionBy("repo_id"))
    per = names.join(specific, ["repo_id", "name"], "left").withColumn("share", F.col("c") / n)
    c = F.col("c")
    total = per.groupBy("repo_id").agg(
        (F.sum(S.word_count_score(F.col("words")) * c) / F.sum(c)).alias("words"),
        (F.sum(F.coalesce("says", F.lit(0.0)) * c) / F.sum(c)).alias("says"),
        F.when(F.sum(c) > 1, F.least(F.lit(1.0), F.sum(-F.col("share") * F.log2("share")) / F.log2(F.sum(c)))).otherwise(0.0).alias("entropy"),
        F.coalesce(F.count_if(F.col("low") < F.col("high")) / F.nullif(F.count("low"), F.lit(0)), F.lit(0.0)).alias("collide"),
    )
    a, b, d, e = p.naming_weights
    sum_ = F.col("words") * a + F.col("says") * b + F.col("entropy") * d + (1 - F.col("collide")) * e
    wide = _repos(files).join(total.select("repo_id", F.least(F.round(sum_ * 25), F.lit(25.0)).alias("naming_uniqueness")), "repo_id", "left").na.fill(0.0)
    return _rows(wide, "discoverability", {"naming_uniqueness": 25})


def structure(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Interfaces with an implementation, by counted equi-joins on methods, and modules' sizes within layers (25 each)."""
    inner = F.contains(F.col("path"), F.lit("/domain/")) | F.contains(F.col("path"), F.lit("/application/"))
    # an interface is one definition at its place, so that equal ones count apart
    ports = files.where(inner).select("repo_id", "path", F.posexplode("interface_defs").alias("at", "i"))
    ports = ports.select("repo_id", "path", "at", F.array_distinct(F.coalesce("i.methods", F.array())).alias("methods"))
    wanted = ports.select("repo_id", "path", "at", F.size("methods").alias("n"), F.explode("methods").alias("method"))
    have = T.functions(files).where("fn.receiver <> ''").select("repo_id", F.ltrim(F.col("fn.receiver"), F.lit("*")).alias("receiver"), F.col("fn.name").alias("method")).distinct()
    met = wanted.join(have, ["repo_id", "method"]).groupBy("repo_id", "path", "at", "n", "receiver").agg(F.count("*").alias("c")).where("c = n")
    met = met.select("repo_id", "path", "at", F.lit(True).alias("met")).distinct()
    good = F.count_if((F.size("methods") == 0) | F.col("met"))
    contracts = ports.join(met, ["repo_id", "path", "at"], "left").groupBy("repo_id").agg(_share(good, F.count("*"), 25).alias("interface_contracts"))
    by_layer = modules.select("repo_id", "n_files", F.explode("layers").alias("layer"))
    w = Window.partitionBy("repo_id", "layer")
    ratios = by_layer.withColumn("most", F.max("n_files").over(w)).withColumn("k", F.count("*").over(w)).where("k >= 2 AND most > 0")
    even = ratios.groupBy("repo_id").agg(F.avg(F.col("n_files") / F.col("most")).alias("even"))
    some = modules.groupBy("repo_id").agg(F.count("*").alias("k"))
    level = F.when(F.col("k").isNull(), 0.0).when(F.col("even").isNull(), 25.0).otherwise(F.floor(F.col("even") * 25.0))
    wide = _repos(files).join(contracts, "repo_id", "left").join(some, "repo_id", "left").join(even, "repo_id", "left")
    wide = wide.select("repo_id", F.coalesce("interface_contracts", F.lit(0)).alias("interface_contracts"), level.alias("module_completeness"))
    return _rows(wide, "structure", {"interface_contracts": 25, "module_completeness": 25})


def _verified(files: DataFrame, paths: DataFrame, trees: DataFrame, p: Profile) -> DataFrame:
    """A row a repository: the four scores of verifiability, and what each counts."""
    path, go = F.col("path"), F.endswith(F.col("path"), F.lit(".go"))
    tree = paths.groupBy("repo_id").agg(
        F.count_if(go & T.is_test(path)).alias("tests"), F.count_if(go & ~T.is_test(path)).alias("sources"), F.bool_or(path == "go.sum").alias("locked"),
        F.bool_or(F.lower(path).isin(BUILD_FILES)).alias("built"), F.bool_or(path.isin(LINTER_FILES)).alias("linted"),
    )
    cases = T.functions(files).groupBy("repo_id").agg(
        F.count_if(F.col("test") & F.startswith(F.col("fn.name"), F.lit("Test"))).alias("cases"),
        F.count_if(F.col("test") & F.col("fn.name").rlike("^Test.*_")).alias("named"),
        F.sum(F.coalesce(F.size("fn.params"), F.lit(0))).alias("params"),
        F.sum(F.size(F.filter(F.coalesce("fn.params", F.array()), lambda x: x["type"].isin("interface{}", "any")))).alias("loose"),
    )
    casts = files.groupBy("repo_id").agg(
        F.sum(F.size(F.coalesce("type_assertions", F.array()))).alias("casts"), F.sum(F.size(F.filter(F.coalesce("type_assertions", F.array()), lambda x: x["safe"]))).alias("safe"),
    )
    wide = _repos(files).join(tree, "repo_id", "left").join(trees.select("repo_id", "has_ci_config"), "repo_id", "left").join(cases, "repo_id", "left").join(casts, "repo_id", "left")
    target = p.test_ratio if p.test_ratio > 0 else 0.5
    yes = lambda c, n: F.when(F.col(c), n).otherwise(0)
    loose, safe = F.col("loose") / F.col("params"), F.col("safe") / F.col("casts")
    few = F.when(F.coalesce("params", F.lit(0)) == 0, 10).when(loose < 0.05, 10).when(loose < 0.15, 5).otherwise(0)
    sure = F.when(F.coalesce("casts", F.lit(0)) == 0, 5).when(safe >= 0.8, 5).when(safe >= 0.5, 3).otherwise(0)
    presence = F.when(F.coalesce("sources", F.lit(0)) == 0, 0).otherwise(F.least(F.floor(F.col("tests") / F.col("sources") / target * 25.0), F.lit(25)))
    return wide.select(
        "repo_id", presence.alias("test_presence"), _share(F.col("named"), F.col("cases"), 25).alias("test_naming"),
        (yes("locked", 10) + yes("built", 7) + yes("has_ci_config", 5) + yes("linted", 3)).alias("build_reproducibility"), (yes("linted", 10) + few + sure).alias("type_safety_signals"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tests", "sources", "cases", "named", "params", "loose", "casts", "safe")],
    )


VERIFIED = ("test_presence", "test_naming", "build_reproducibility", "type_safety_signals")


def verifiability(files: DataFrame, paths: DataFrame, trees: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Tests, their names, reproducible builds and type safety (25 points each)."""
    return _rows(_verified(files, paths, trees, p), "verifiability", dict.fromkeys(VERIFIED, 25))


def verifiability_issues(files: DataFrame, paths: DataFrame, trees: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Rows (repo_id, severity, category, message): the scores of verifiability that are 0, and why."""
    target = p.test_ratio if p.test_ratio > 0 else 0.5
    # Messages.
    why = {
        "test_presence": F.when(F.col("sources") <= 0, "no Go source files found").otherwise(
            F.format_string("%d test files for %d source files (ratio %.2f, target %.2f)", "tests", "sources", F.coalesce(F.try_divide("tests", "sources"), F.lit(0.0)), F.lit(float(target)))
        ),
        "test_naming": F.when(F.col("cases") == 0, "no test functions found").otherwise(F.format_string("%d/%d test functions follow Test<Func>_<Scenario> naming", "named", "cases")),
        "build_reproducibility": F.lit("no build reproducibility signals found"),
        "type_safety_signals": F.format_string("linter config, %d/%d safe type assertions, %d/%d clean params", "safe", "casts", F.col("params") - F.col("loose"), "params"),
    }
    each = [
        F.when(F.col(n) == 0, F.struct(F.lit("error" if n == "test_presence" else "warning").alias("severity"), F.concat(F.lit(f"missing {n}: "), why[n]).alias("message"))) for n in VERIFIED
    ]
    rows = _verified(files, paths, trees, p).select("repo_id", F.explode(F.array_compact(F.array(*each))).alias("i"))
    return rows.select("repo_id", "i.severity", F.lit("verifiability").alias("category"), "i.message")




def context_quality(files: DataFrame, paths: DataFrame, trees: DataFrame) -> DataFrame:
    """Package comments (25), documents on architecture (20) and examples (25)."""
    source = files.where(~T.is_test(F.col("path")))
    packages = source.groupBy("repo_id", "package").agg(F.bool_or("package_doc").alias("doc"))
    docs = packages.groupBy("repo_id").agg(_share(F.count_if("doc"), F.count("*"), 25).alias("package_documentation"))
    path = F.col("path")
    tree = paths.groupBy("repo_id").agg(
        F.bool_or(path.rlike("^docs?/")).alias("docs"), F.bool_or(F.contains(F.lower(path), F.lit("adr")) & F.endswith(F.lower(path), F.lit(".md"))).alias("adr"),
        F.count_if(F.endswith(path, F.lit("example_test.go")) | F.contains(path, F.lit("_example_test.go"))).alias("example_files"),
    )
    shown = T.functions(files).groupBy("repo_id").agg(F.count_if(F.col("test") & F.startswith(F.col("fn.name"), F.lit("Example"))).alias("examples"))
    wide = _repos(files).join(docs, "repo_id", "left").join(tree, "repo_id", "left").join(trees.drop("has_ci_config"), "repo_id", "left").join(shown, "repo_id", "left")
    yes = lambda c, n: F.when(c, n).otherwise(0)
    readme = F.when(F.col("readme_size") > 500, 8).when(F.col("readme_size") > 0, 4).otherwise(0)
    files_ = F.when(F.col("example_files") >= 3, 10).otherwise(F.coalesce(F.col("example_files") * 4, F.lit(0)))
    refers = yes(F.col("agent_doc").rlike("[Ss]ee `|[Ee]xample"), 10)
    wide = wide.select(
        "repo_id", F.coalesce("package_documentation", F.lit(0)).alias("package_documentation"), (readme + yes(F.col("docs"), 7) + yes(F.col("adr"), 5)).alias("architecture_docs"),
        (files_ + F.least(F.coalesce("examples", F.lit(0)), F.lit(5)) + refers).alias("canonical_examples"),
    )
    return _rows(wide, "context_quality", {"package_documentation": 25, "architecture_docs": 20, "canonical_examples": 25})


def predictability(files: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Names of verb and noun, package state, error messages and signatures by role (25 points each)."""
    fns = T.functions(files)
    named = fns.where("fn.exported").groupBy("repo_id").agg(_share(F.count_if(S.verb_noun(F.col("fn.name"))), F.count("*"), 25).alias("self_describing_names"))
    source, none = ~T.is_test(F.col("path")), F.array()
    public = F.size(F.filter(F.coalesce("global_vars", none), lambda v: v.rlike(r"^\p{Lu}") & ~F.startswith(v, F.lit("Err"))))
    calls = F.coalesce("error_calls", none)
    by_file = files.groupBy("repo_id").agg(
        F.count_if(source).alias("sources"), F.sum(F.when(source, public + F.coalesce("init_functions", F.lit(0))).otherwise(0)).alias("state"),
        F.sum(F.size(calls)).alias("errors"), F.sum(F.size(F.filter(calls, lambda x: x["has_wrap"]))).alias("wrapped"), F.sum(F.size(F.filter(calls, lambda x: x["has_context"]))).alias("told"),
        F.bool_or(F.exists(F.coalesce("global_vars", none), lambda v: F.startswith(v, F.lit("Err")))).alias("sentinels"),
    )
    methods = fns.where("NOT test AND fn.exported AND fn.receiver <> ''").withColumn("role", T.role_suffix(F.col("path"))).where("role IS NOT NULL")
    ctx, err = F.exists("fn.params", lambda x: x["type"] == "context.Context"), F.array_contains("fn.returns", "error")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    roles = methods.groupBy("repo_id", "role").agg(F.count("*").alias("c"), share(ctx).alias("ctx"), share(err).alias("err")).where("c >= 2")
    same = F.expr("(ctx >= 0.8 OR ctx <= 0.2) AND (err >= 0.8 OR err <= 0.2)")
    patterns = roles.groupBy("repo_id").agg(_share(F.count_if(same), F.count("*"), 25).alias("consistent_patterns"))
    wide = _repos(files).join(named, "repo_id", "left").join(by_file, "repo_id", "left").join(patterns, "repo_id", "left")
    wrap, told = F.col("wrapped") / F.col("errors"), F.col("told") / F.col("errors")
    habit = F.when(wrap > 0.5, 1.0).when(wrap > 0.2, 0.7).otherwise(0.5)
    quality = wrap * 0.4 + told * 0.3 + habit * 0.2 + F.when(F.col("sentinels"), 0.1).otherwise(0.0)
    wide = wide.select(
        "repo_id", F.coalesce("self_describing_names", F.lit(0)).alias("self_describing_names"),
        F.when(F.col("sources") == 0, 0).otherwise(F.greatest(F.lit(0), 25 - F.col("state") * p.global_penalty)).alias("explicit_dependencies"),
        F.when(F.col("errors") > 0, F.least(F.floor(quality * 25.0), F.lit(25))).otherwise(0).alias("error_message_quality"),
        F.coalesce("consistent_patterns", F.lit(12)).alias("consistent_patterns"),
    )
    return _rows(wide, "predictability", dict.fromkeys(wide.columns[1:], 25))


def _issue(category: str, sub: str | None, severity: Column, message: Column, line: Column | None = None, file: Column | None = None, pattern: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        severity.alias("severity"), F.lit(category).alias("category"), (F.lit(sub) if sub else null).alias("sub_metric"), (F.col("path") if file is None else file).alias("file"),
        (F.lit(None) if line is None else line).cast("int").alias("line"), message.alias("message"), (null if pattern is None else pattern).alias("pattern"),
    )


def issues(files: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Rows of ISSUES: sizes, complexity, parameters, names, package state. One scan a grain; each row emits an array."""
    # The messages below.
    own = files.where("NOT coalesce(is_generated, false)")
    fns = limits(T.functions(own), p)
    name, at = F.col("fn.name"), F.col("fn.line_start")
    over = lambda v, t: S.issue_severity(v, t)
    kind = F.when(F.startswith(name, F.lit("Reconstruct")), "reconstruct").when(F.startswith(name, F.lit("New")), "constructor").when(F.startswith(name, F.lit("Test")), "test")
    lines, cc, params = F.col("lines"), F.col("fn.cognitive_complexity"), F.col("n_params")
    n_words = F.size(S.camel_words(name))
    free = ~F.col("test") & F.col("fn.exported")
    alone = F.coalesce(F.col("fn.receiver"), F.lit("")) == ""
    short = free & (alone | (n_words != 1)) & (S.word_count_score(S.camel_words(name)) < p.word_score)
    said = F.when(n_words > 1, F.format_string('exported function "%s" has %d words; consider a shorter verb+noun pattern', name, n_words)).otherwise(
        F.format_string('exported function "%s" has a single-word name; consider a verb+noun pattern', name)
    )
    per_fn = [
        F.when(lines > F.col("max_lines"), _issue("code_health", "function_size", over(lines, F.col("max_lines")), F.format_string("function %s is %d lines (>%d)", name, lines, "max_lines"), at, pattern=kind)),
        F.when(~F.col("dispatch") & (cc > F.col("max_cc")), _issue("code_health", "cognitive_complexity", over(cc, F.col("max_cc")), F.format_string("function %s has cognitive complexity %d (>%d)", name, cc, "max_cc"), at, pattern=kind)),
        F.when(~F.col("exempt") & (params > F.col("max_params")), _issue("code_health", "parameter_count", over(params, F.col("max_params")), F.format_string("function %s has %d parameters (>%d)", name, params, "max_params"), at, pattern=kind)),
        F.when(short, _issue("discoverability", "naming_uniqueness", F.lit("info"), said, at)),
    ]
    path = F.col("path")
    most = F.when(T.is_test(path), 2 * p.file_lines).otherwise(p.file_lines)
    made = F.when(F.contains(path, F.lit("sqlc/")) | F.endswith(path, F.lit("_gen.go")), "generated")
    large = F.when(~F.coalesce("is_generated", F.lit(False)) & (F.col("total_lines") > most), _issue("code_health", "file_size", over(F.col("total_lines"), most), F.format_string("file has %d lines (>%d)", "total_lines", most), pattern=made))
    state = ~T.is_test(path)
    n_vars = F.size(F.coalesce("global_vars", F.array()))
    per_file = [
        large,
        F.when(state & (n_vars > 3), _issue("predictability", None, F.lit("warning"), F.format_string("file has %d package-level variables (prefer explicit injection)", n_vars))),
        F.when(state & (F.col("init_functions") > 0), _issue("predictability", None, F.lit("info"), F.format_string("file has %d init() function(s) (prefer explicit initialization)", "init_functions"))),
    ]
    shared = T.functions(own).where("NOT test AND fn.exported AND coalesce(fn.receiver, '') = ''").groupBy("repo_id", F.col("fn.name").alias("name")).agg(F.count_distinct("package").alias("k")).where("k >= 2")
    shared = shared.select("repo_id", F.array(_issue("discoverability", "naming_uniqueness", F.lit("info"), F.format_string('exported function "%s" appears in %d packages', "name", "k"), file=F.lit(""))).alias("found"))
    vague = own.where(F.col("package").isin(VAGUE_PACKAGES)).groupBy("repo_id", "package").agg(F.min("path").alias("path"))
    vague = vague.select("repo_id", F.array(_issue("discoverability", "naming_uniqueness", F.lit("info"), F.format_string('package "%s" is a vague name; consider a more descriptive name', "package"))).alias("found"))
    parts = [fns.select("repo_id", F.array_compact(F.array(*per_fn)).alias("found")), files.select("repo_id", F.array_compact(F.array(*per_file)).alias("found")), shared, vague]
    return reduce(DataFrame.unionByName, parts).select("repo_id", F.explode("found").alias("i")).select("repo_id", "i.*")


def category_scores(metrics: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (repo_id, category, score): sums of sub-metrics, less the debt of issues in the two categories that have one."""
    fns = T.functions(files.where("NOT coalesce(is_generated, false)")).groupBy("repo_id").agg(F.count("*").alias("code_health"), F.count_if("fn.exported").alias("discoverability"))
    n = fns.select("repo_id", F.explode(F.create_map(F.lit("code_health"), "code_health", F.lit("discoverability"), "discoverability")).alias("category", "n"))
    debt = found.groupBy("repo_id", "category").agg(F.sum(S.severity_weight(F.col("severity"))).alias("w"), F.count_if(F.col("severity") == "error").alias("e"))
    total = metrics.groupBy("repo_id", "category").agg(F.sum("score").alias("sum"))
    out = total.join(n, ["repo_id", "category"], "left").join(debt, ["repo_id", "category"], "left")
    loss = F.when(F.col("n").isNotNull(), F.coalesce(S.debt_penalty(F.col("w"), F.col("n"), F.col("e")), F.lit(0))).otherwise(0)
    return out.select("repo_id", "category", F.greatest(F.lit(0), F.col("sum") - loss).alias("score"))


def overall(categories: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows (repo_id, overall, grade): the weighted mean of categories, rounded; 0 without weight."""
    w = F.lit(0.0)
    for name, x in (WEIGHTS | (weights or {})).items():
        w = F.when(F.col("category") == name, F.lit(float(x))).otherwise(w)
    mean = F.coalesce(F.round(F.sum(F.col("score") * w) / F.nullif(F.sum(w), F.lit(0.0))), F.lit(0.0)).cast("long")
    return categories.groupBy("repo_id").agg(mean.alias("overall")).withColumn("grade", S.grade(F.col("overall")))
