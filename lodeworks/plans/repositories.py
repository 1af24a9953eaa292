"""Queries on whole repositories: orders as source files, their line items as functions, a repository a nation of customers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import facts as T
from lodeworks.operators import layout as L
from lodeworks.operators import modules as M
from lodeworks.operators import packages as G
from lodeworks.operators import relational as R
from lodeworks.operators import reports as P
from lodeworks.operators import scorers as C
from lodeworks.plans.catalogue import SQL, query, table

# Facts of files and functions in words that Spark and DuckDB share; counts stand for lists.
_FILE = """SELECT concat('r', c_nationkey) AS repo_id, c_nationkey AS n, o_orderkey AS k, o_orderkey % 5 = 0 AND c_nationkey % 6 <> 1 AS test,
  concat(CASE WHEN c_nationkey % 5 = 0 THEN 'pkg/f' ELSE 'internal/f' END, o_custkey % 7, '/', CASE o_orderkey % 6 WHEN 0 THEN 'domain' WHEN 1 THEN 'application' WHEN 2 THEN 'adapters/http' WHEN 3 THEN 'adapters/repository' WHEN 4 THEN 'util' ELSE 'domain' END,
    '/f', o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND c_nationkey % 6 <> 1 THEN '_test' WHEN o_orderkey % 4 = 0 THEN '_service' WHEN o_orderkey % 4 = 1 THEN '_handler' ELSE '' END, '.go') AS path,
  CASE WHEN o_orderkey % 9 = 3 THEN 'util' ELSE concat('p', o_orderkey % 9) END AS package, o_totalprice > 300000 AS doc, CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END AS inits, 100 + o_orderkey % 700 AS total_lines,
  o_orderkey % 11 = 0 AS gen, CASE WHEN o_totalprice > 350000 THEN o_orderkey % 30 END AS port, CASE WHEN c_nationkey % 8 = 2 THEN 0 ELSE o_orderkey % 4 END AS errs, o_orderkey % 3 AS wraps, o_orderkey % 2 = 0 AS told,
  CASE WHEN o_orderkey % 50 = 7 THEN 5 WHEN o_orderkey % 50 = 8 THEN 1 ELSE 0 END AS vars, o_orderkey % 3 AS casts, c_nationkey % 3 <> 0 AS safe
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
_FN = """SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber % 2 = 0 AS exported, CASE WHEN l_linestatus = 'O' THEN concat('*T', l_suppkey % 4) ELSE '' END AS receiver, l_partkey % 4 AS m, l_returnflag AS flag,
  CAST(l_quantity AS BIGINT) % 8 AS q, l_discount > 0.015 AS err, CAST(l_quantity AS BIGINT) AS qty FROM {lineitem}"""
#: Parameters' names by q; the first of a function with q = 5 is a context, else it is of any type if i = 1.
PARAMS = ("w r", "r w", "a c", "x", "i j k", "ctx id", "b g r", "")
_NAME = "CASE WHEN test THEN concat('Test', CASE flag WHEN 'R' THEN 'Return' ELSE 'Ship' END, CASE WHEN i % 3 = 0 THEN '_Late' ELSE '' END) WHEN receiver <> '' THEN CASE m WHEN 3 THEN 'Save' ELSE concat('M', m) END WHEN flag = 'R' THEN 'ReturnLine' WHEN flag = 'A' THEN 'ValidateOrder' ELSE 'Orders' END"
_TREE = "SELECT concat('r', n_nationkey) AS repo_id, n_nationkey AS n, n_nationkey * 40 AS readme_size, n_nationkey % 4 = 1 AS has_ci_config, CASE WHEN n_nationkey % 3 = 1 THEN 'Run it. See `docs`.' ELSE '' END AS agent_doc, n_nationkey % 3 = 1 AS has_claude, n_nationkey % 5 = 2 AS has_cursor, n_nationkey % 2 = 0 AS has_agents FROM {nation}"
#: Other files of a repository, by a remainder of its nation's key.
ROOT = (("go.sum", 2, 0), ("Makefile", 3, 0), (".golangci.yml", 4, 0), ("docs/use.md", 5, 1), ("docs/adr-1.md", 5, 1), ("a/example_test.go", 7, 3), ("b/example_test.go", 7, 3), ("c/x_example_test.go", 7, 3), ("CLAUDE.md", 3, 1))


MODULE = "example.com/m"
# Each file of a domain folder imports another feature's folder, others that of the next one; where the nation's key is a
# multiple of three only lower features are imported, so that no cycle can be.
_TO = """SELECT f.*, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CAST(regexp_extract(path, '/f([0-9])/', 1) AS INT) AS a, CASE WHEN k % 6 IN (0, 5) THEN k % 7 ELSE (CAST(regexp_extract(path, '/f([0-9])/', 1) AS INT) + 1) % 7 END AS b,
  concat(regexp_extract(path, '^([a-z]*/f)', 1), CASE WHEN k % 6 IN (0, 5) THEN k % 7 ELSE (CAST(regexp_extract(path, '/f([0-9])/', 1) AS INT) + 1) % 7 END, CASE WHEN k % 9 = 4 THEN '/adapters/http' ELSE '/domain' END) AS target FROM f"""


def facts(spark, d: str, graph: bool = False, functions: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """files, paths, trees and members; an order has a few line items. Derived once, for the many joins that read them.

    graph: files import folders as ``_TO`` has them. Without functions files have none, for what does not look at them.
    """
    t = {x: table(spark, d, x) for x in ("orders", "customer", "lineitem", "nation")}
    f, g = spark.sql(_FILE, orders=t["orders"], customer=t["customer"]), spark.sql(_FN, lineitem=t["lineitem"])
    imports = F.array(F.lit("m/internal/application"))
    if graph:
        f = spark.sql(_TO.replace("FROM f", "FROM {f} f"), f=f)
        imports = F.when(F.expr("a <> b AND (n % 3 <> 0 OR b < a)"), F.array(F.concat(F.lit(f"{MODULE}/"), "target"))).otherwise(F.array().cast("array<string>"))
    names = F.coalesce(*[F.when(F.col("q") == i, F.array(*[F.lit(x) for x in p.split()]).cast("array<string>")) for i, p in enumerate(PARAMS)])
    kind = lambda x, i: F.when(F.col("q") == 5, F.when(i == 0, "context.Context").otherwise("string")).when((i == 0) & (F.col("i") == 1), "any").otherwise("string")
    fn = F.struct(
        F.expr(_NAME).alias("name"), F.expr("IF(test, '', receiver)").alias("receiver"), "exported", (F.col("i") * 10).cast("int").alias("line_start"), (F.col("i") * 10 + 8).cast("int").alias("line_end"),
        F.transform(names, lambda x, i: F.struct(x.alias("name"), kind(x, i).alias("type"))).alias("params"), F.when(F.col("err"), F.array(F.lit("error"))).otherwise(F.array().cast("array<string>")).alias("returns"),
        F.lit(1).alias("max_nesting"), F.lit(1).alias("max_cond_ops"), F.lit(1).alias("cognitive_complexity"), F.lit(0.0).alias("string_literal_ratio"), F.lit(0).alias("max_case_arms"), F.lit(0.0).alias("avg_case_lines"),
    )
    fns = g.join(f.select("k", "test"), "k").groupBy("k").agg(F.collect_list(fn).alias("functions"))
    strings = lambda c, *x: F.when(c, F.array(*x)).otherwise(F.array().cast("array<string>"))
    methods = F.array_compact(F.array(F.concat(F.lit("M"), F.col("port") % 4), F.when(F.col("port") % 2 == 1, F.concat(F.lit("M"), (F.col("port") + 1) % 4))))
    ports = F.when(F.col("port").isNotNull(), F.array(F.struct(F.concat(F.lit("I"), "port").alias("name"), F.when(F.col("port") % 10 == 0, F.array().cast("array<string>")).otherwise(methods).alias("methods"))))
    repeat = lambda n, s: F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), s)
    files = (f.join(fns, "k", "left") if functions else f.withColumn("functions", F.lit(None).cast(f"array<{T.FUNCTION}>"))).select(
        "repo_id", "path", "package", F.col("doc").alias("package_doc"), F.col("inits").cast("int").alias("init_functions"), F.col("total_lines").cast("int").alias("total_lines"), F.col("gen").alias("is_generated"), F.lit(False).alias("has_cgo"),
        strings(F.col("k") % 3 == 0, F.concat(F.lit("T"), F.col("k") % 4)).alias("structs"), strings(F.col("port").isNotNull(), F.concat(F.lit("I"), "port")).alias("interfaces"),
        F.coalesce(ports, F.array().cast("array<struct<name:string,methods:array<string>>>")).alias("interface_defs"), imports.alias("imports"),
        F.when(F.col("vars") == 5, F.array(*map(F.lit, ("ErrX", "Total", "part", "Other", "rest")))).otherwise(strings(F.col("vars") == 1, F.lit("Total"))).alias("global_vars"),
        repeat(F.col("errs").cast("int"), lambda i: F.struct((i <= F.col("wraps")).alias("has_wrap"), F.col("told").alias("has_context"))).alias("error_calls"),
        repeat(F.col("casts").cast("int"), lambda i: F.struct((F.col("safe") | (i == 1)).alias("safe"))).alias("type_assertions"), F.coalesce("functions", F.array().cast(f"array<{T.FUNCTION}>")).alias("functions"),
    )
    files = R.durable(files)
    trees = spark.sql(_TREE, nation=t["nation"])
    extra = [trees.where(F.col("n") % a == b).select("repo_id", F.lit(p).alias("path")) for p, a, b in ROOT]
    paths = reduce(DataFrame.union, extra, files.select("repo_id", "path"))
    return files, paths, trees.drop("n"), R.durable(M.module_files(files))


_LISTS = ", ".join(f"({i}, [{', '.join(repr(x) for x in p.split())}])" for i, p in enumerate(PARAMS))
_ROOT = " UNION ALL ".join(f"SELECT concat('r', n_nationkey), '{p}' FROM nation WHERE n_nationkey % {a} = {b}" for p, a, b in ROOT)
_BASE = f"""WITH f AS ({_FILE.format(orders='orders', customer='customer')}), t AS ({_TREE.format(nation='nation')}), ps(q, names) AS (VALUES {_LISTS.replace('[]', '[]::VARCHAR[]')}),
  g AS (SELECT f.repo_id, f.path, f.package, f.test, f.gen, i, exported, CASE WHEN test THEN '' ELSE receiver END AS receiver, {_NAME} AS name, g.q, err, len(names) AS np, names, CASE WHEN g.q NOT IN (5, 7) AND i = 1 THEN 1 ELSE 0 END AS loose FROM ({_FN.format(lineitem='lineitem')}) g JOIN f USING (k) JOIN ps ON ps.q = g.q),
  repos AS (SELECT DISTINCT repo_id FROM f), paths(repo_id, path) AS (SELECT repo_id, path FROM f UNION ALL {_ROOT}), pathx AS (SELECT paths.* FROM paths JOIN repos USING (repo_id))"""
_LONG = "SELECT repo_id, '{0}' AS category, name, score::BIGINT AS score, 25::BIGINT AS points FROM w UNPIVOT (score FOR name IN ({1}))"
_VER = f"""{_BASE}, a AS (SELECT repo_id, count_if(path LIKE '%#_test.go' ESCAPE '#') AS tests, count_if(path LIKE '%.go' AND NOT path LIKE '%#_test.go' ESCAPE '#') AS sources, bool_or(path = 'go.sum') AS locked, bool_or(path = 'Makefile') AS built, bool_or(path = '.golangci.yml') AS linted FROM pathx GROUP BY 1),
  b AS (SELECT repo_id, count_if(test AND name LIKE 'Test%') AS cases, count_if(test AND name LIKE 'Test%#_%' ESCAPE '#') AS named, sum(np) AS params, sum(loose) AS loose FROM g GROUP BY 1),
  c AS (SELECT repo_id, sum(casts) AS casts, sum(CASE WHEN safe THEN casts ELSE least(casts, 1) END) AS safe FROM f GROUP BY 1),
  v AS (SELECT *, loose / params::DOUBLE AS lr, safe / casts::DOUBLE AS sr FROM a LEFT JOIN b USING (repo_id) LEFT JOIN c USING (repo_id) LEFT JOIN (SELECT repo_id, has_ci_config AS ci FROM t) USING (repo_id)),
  w AS (SELECT repo_id, tests, sources, cases, named, params, loose, casts, safe, CASE WHEN sources = 0 THEN 0 ELSE least(25, floor(tests / sources::DOUBLE / 0.5::DOUBLE * 25)) END::BIGINT AS test_presence, CASE WHEN cases = 0 THEN 0 ELSE floor(named / cases::DOUBLE * 25) END::BIGINT AS test_naming,
    (CASE WHEN locked THEN 10 ELSE 0 END + CASE WHEN built THEN 7 ELSE 0 END + CASE WHEN ci THEN 5 ELSE 0 END + CASE WHEN linted THEN 3 ELSE 0 END)::BIGINT AS build_reproducibility,
    (CASE WHEN linted THEN 10 ELSE 0 END + CASE WHEN params = 0 OR lr < 0.05 THEN 10 WHEN lr < 0.15 THEN 5 ELSE 0 END + CASE WHEN casts = 0 OR sr >= 0.8 THEN 5 WHEN sr >= 0.5 THEN 3 ELSE 0 END)::BIGINT AS type_safety_signals FROM v)"""


@query("q76_verifiability", f"{_VER} {_LONG.format('verifiability', ', '.join(C.VERIFIED))}")
def verifiability(spark, d):
    files, paths, trees, _ = facts(spark, d)
    return C.verifiability(files, paths, trees)


_CTX = f"""{_BASE}, a AS (SELECT repo_id, floor(count_if(doc) / count(*)::DOUBLE * 25) AS package_documentation FROM (SELECT repo_id, package, bool_or(doc) AS doc FROM f WHERE NOT test GROUP BY 1, 2) GROUP BY 1),
  b AS (SELECT repo_id, bool_or(path LIKE 'docs/%') AS docs, bool_or(path LIKE '%adr%.md') AS adr, count_if(path LIKE '%example#_test.go' ESCAPE '#') AS ex FROM pathx GROUP BY 1),
  w AS (SELECT repo_id, coalesce(package_documentation, 0)::BIGINT AS package_documentation, (CASE WHEN readme_size > 500 THEN 8 WHEN readme_size > 0 THEN 4 ELSE 0 END + CASE WHEN docs THEN 7 ELSE 0 END + CASE WHEN adr THEN 5 ELSE 0 END)::BIGINT AS architecture_docs,
    (CASE WHEN ex >= 3 THEN 10 ELSE 4 * ex END + CASE WHEN agent_doc LIKE '%See `%' THEN 10 ELSE 0 END)::BIGINT AS canonical_examples FROM repos LEFT JOIN a USING (repo_id) LEFT JOIN b USING (repo_id) LEFT JOIN t USING (repo_id))"""


@query("q77_context_quality", f"{_CTX} SELECT repo_id, category, name, score, CASE name WHEN 'architecture_docs' THEN 20 ELSE 25 END::BIGINT AS points FROM ({_LONG.format('context_quality', 'package_documentation, architecture_docs, canonical_examples')})")
def context_quality(spark, d):
    files, paths, trees, _ = facts(spark, d)
    return C.context_quality(files, paths, trees)


_PRE = f"""{_BASE}, a AS (SELECT repo_id, floor(count_if(name NOT IN ('Orders', 'Save')) / count(*)::DOUBLE * 25) AS self_describing_names FROM g WHERE exported GROUP BY 1),
  b AS (SELECT repo_id, count_if(NOT test) AS sources, sum(CASE WHEN test THEN 0 ELSE CASE vars WHEN 5 THEN 2 ELSE vars END + inits END) AS state, sum(errs) AS errors, sum(least(errs, wraps)) AS wrapped, sum(CASE WHEN told THEN errs ELSE 0 END) AS told, bool_or(vars = 5) AS sentinels FROM f GROUP BY 1),
  r AS (SELECT repo_id, CASE WHEN path LIKE '%#_service.go' ESCAPE '#' THEN '_service' WHEN path LIKE '%#_handler.go' ESCAPE '#' THEN '_handler' END AS role, avg(CASE WHEN q = 5 THEN 1 ELSE 0 END) AS ctx, avg(CASE WHEN err THEN 1 ELSE 0 END) AS er, count(*) AS c
    FROM g WHERE NOT test AND exported AND receiver <> '' AND (path LIKE '%#_service.go' ESCAPE '#' OR path LIKE '%#_handler.go' ESCAPE '#') GROUP BY 1, 2 HAVING count(*) >= 2),
  p AS (SELECT repo_id, floor(count_if((ctx >= 0.8 OR ctx <= 0.2) AND (er >= 0.8 OR er <= 0.2)) / count(*)::DOUBLE * 25) AS consistent_patterns FROM r GROUP BY 1),
  w AS (SELECT repo_id, coalesce(self_describing_names, 0)::BIGINT AS self_describing_names, CASE WHEN sources = 0 THEN 0 ELSE greatest(0, 25 - 3 * state) END::BIGINT AS explicit_dependencies, CASE WHEN errors > 0 THEN least(25, floor((wrapped / errors::DOUBLE * 0.4::DOUBLE + told / errors::DOUBLE * 0.3::DOUBLE
      + CASE WHEN wrapped / errors::DOUBLE > 0.5 THEN 1.0::DOUBLE WHEN wrapped / errors::DOUBLE > 0.2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE + CASE WHEN sentinels THEN 0.1::DOUBLE ELSE 0 END) * 25)) ELSE 0 END::BIGINT AS error_message_quality,
    coalesce(consistent_patterns, 12)::BIGINT AS consistent_patterns FROM repos LEFT JOIN a USING (repo_id) LEFT JOIN b USING (repo_id) LEFT JOIN p USING (repo_id))"""


@query("q78_predictability", f"{_PRE} {_LONG.format('predictability', 'self_describing_names, explicit_dependencies, error_message_quality, consistent_patterns')}")
def predictability(spark, d):
    return C.predictability(facts(spark, d)[0])


# modules: those of internal/f0 .. f6, in repositories whose nation's key is no multiple of five
_MEMB = """mem AS (SELECT repo_id, regexp_extract(path, '^internal/(f[0-9])/', 1) AS module, CASE WHEN path LIKE '%/domain/%' THEN 'domain' WHEN path LIKE '%/application/%' THEN 'application' WHEN path LIKE '%/adapters/%' THEN 'adapters' END AS layer, path FROM f WHERE path LIKE 'internal/%')"""
_STR = f"""{_BASE}, {_MEMB}, h AS (SELECT DISTINCT repo_id, substr(receiver, 2) AS receiver, name AS method FROM g WHERE receiver <> ''),
  i AS (SELECT repo_id, path, port, CASE WHEN port % 10 = 0 THEN []::VARCHAR[] WHEN port % 2 = 1 THEN ['M' || (port % 4), 'M' || ((port + 1) % 4)] ELSE ['M' || (port % 4)] END AS methods FROM f WHERE port IS NOT NULL AND (path LIKE '%/domain/%' OR path LIKE '%/application/%')),
  hit AS (SELECT im.repo_id, im.path, receiver, count(*) AS c FROM (SELECT repo_id, path, unnest(methods) AS method FROM i) im JOIN h ON h.repo_id = im.repo_id AND h.method = im.method GROUP BY 1, 2, 3),
  ok AS (SELECT i.*, len(methods) = 0 OR path IN (SELECT path FROM hit WHERE hit.repo_id = i.repo_id AND c = len(i.methods)) AS good FROM i),
  c AS (SELECT repo_id, floor(count_if(good) / count(*)::DOUBLE * 25) AS interface_contracts FROM ok GROUP BY 1),
  z AS (SELECT repo_id, module, count(*) AS n FROM mem GROUP BY 1, 2), l AS (SELECT DISTINCT repo_id, module, layer FROM mem WHERE layer IS NOT NULL), y AS (SELECT repo_id, layer, n, max(n) OVER (PARTITION BY repo_id, layer) AS most, count(*) OVER (PARTITION BY repo_id, layer) AS k FROM l JOIN z USING (repo_id, module)),
  e AS (SELECT repo_id, avg(n / most::DOUBLE) AS even FROM y WHERE k >= 2 GROUP BY 1),
  w AS (SELECT repo_id, coalesce(interface_contracts, 0)::BIGINT AS interface_contracts, CASE WHEN NOT EXISTS (SELECT 1 FROM z WHERE z.repo_id = repos.repo_id) THEN 0 ELSE coalesce(floor(round(even, 9) * 25), 25) END::BIGINT AS module_completeness FROM repos LEFT JOIN c USING (repo_id) LEFT JOIN e USING (repo_id))"""


@query("q79_structure", f"{_STR} {_LONG.format('structure', 'interface_contracts, module_completeness')}")
def structure(spark, d):
    files, _, _, members = facts(spark, d)
    return C.structure(files, M.modules(members).withColumnRenamed("module", "name"))


_DOCS = (("has_claude", "warning", "CLAUDE.md not found; add it to provide AI agents with project context"), ("has_cursor", "info", ".cursorrules not found; add it for Cursor IDE integration"), ("has_agents", "info", "AGENTS.md not found; add it to describe agent workflows"))
_ABS = f"""{_VER}, zero AS (SELECT repo_id, CASE WHEN name = 'test_presence' THEN 'error' ELSE 'warning' END AS severity, 'verifiability' AS category, 'missing ' || name || ': ' || CASE name
      WHEN 'test_presence' THEN CASE WHEN sources = 0 THEN 'no Go source files found' ELSE printf('%d test files for %d source files (ratio %.2f, target %.2f)', tests, sources, tests / sources::DOUBLE, 0.5::DOUBLE) END
      WHEN 'test_naming' THEN CASE WHEN cases = 0 THEN 'no test functions found' ELSE printf('%d/%d test functions follow Test<Func>_<Scenario> naming', named, cases) END WHEN 'build_reproducibility' THEN 'no build reproducibility signals found'
      ELSE printf('linter config, %d/%d safe type assertions, %d/%d clean params', safe::BIGINT, casts::BIGINT, (params - loose)::BIGINT, params::BIGINT) END AS message, false AS fix_available
    FROM w UNPIVOT (score FOR name IN (test_presence, test_naming, build_reproducibility, type_safety_signals)) WHERE score = 0),
  absent AS (SELECT * FROM zero UNION ALL SELECT repo_id, 'warning', 'structure', 'no modules detected; cannot evaluate structure', false FROM repos WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = repos.repo_id AND path LIKE 'internal/%')
    UNION ALL SELECT repo_id, 'info', 'predictability', 'no error handling found across all source files', false FROM f GROUP BY 1 HAVING sum(CASE WHEN test THEN 0 ELSE errs END) = 0
    {' '.join(f"UNION ALL SELECT repo_id, '{s}', 'context_quality', '{m}', true FROM repos JOIN t USING (repo_id) WHERE NOT {c}" for c, s, m in _DOCS)})"""


@query("q80_absence_issues", f"{_ABS} SELECT * FROM absent")
def absence_issues(spark, d):
    return P.absence_issues(*facts(spark, d)).select("repo_id", "severity", "category", "message", "fix_available")


_LET = f"""odd AS (SELECT repo_id, path AS file, i * 10 AS line, printf('exported function "%s" has %d single-letter parameters', name, np) AS message FROM g
    WHERE exported AND NOT gen AND NOT test AND receiver = '' AND np >= 2 AND list_bool_and(list_transform(names, lambda x: length(x) = 1)) AND q NOT IN (0, 1, 6))"""


@query("q81_letter_issues", f"{_BASE}, {_LET} SELECT * FROM odd")
def letter_issues(spark, d):
    return P.letter_issues(facts(spark, d)[0]).select("repo_id", "file", "line", "message")


def _issues(spark, d):
    """Issues of the two emitters above, and those of state and names that scorers.issues finds."""
    files, paths, trees, members = facts(spark, d)
    return files, paths, P.absence_issues(files, paths, trees, members).unionByName(P.letter_issues(files)).unionByName(P.file_issues(files).where("category = 'predictability'"))


_ISS = f"""{_ABS}, {_LET}, iss AS (SELECT repo_id, severity, category, NULL AS sub_metric, NULL AS file, NULL AS line, message, CASE category WHEN 'structure' THEN 14 WHEN 'verifiability' THEN 16 WHEN 'context_quality' THEN 17 ELSE 18 END AS ordinal FROM absent
    UNION ALL SELECT repo_id, 'info', 'discoverability', 'naming_uniqueness', file, line, message, 13 FROM odd
    UNION ALL SELECT repo_id, 'warning', 'predictability', NULL, path, NULL, printf('file has %d package-level variables (prefer explicit injection)', vars), 19 FROM f WHERE NOT test AND vars > 3
    UNION ALL SELECT repo_id, 'info', 'predictability', NULL, path, NULL, printf('file has %d init() function(s) (prefer explicit initialization)', inits), 20 FROM f WHERE NOT test AND inits > 0)"""
_SEV = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_CAT = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(P.CATEGORIES)) + " END"


@query(
    "q82_issues_in_order",
    f"""{_ISS} SELECT repo_id, severity, category, file, line, message, ordinal, row_number() OVER (PARTITION BY repo_id ORDER BY {_SEV}, {_CAT}, ordinal, file NULLS FIRST, line NULLS FIRST, message) - 1 AS place FROM iss""",
)
def issues_in_order(spark, d):
    return P.in_order(_issues(spark, d)[2]).select("repo_id", "severity", "category", "file", "line", "message", "ordinal", "place")


# messages that bring each rule to hold by its category, sub-metric or words
_SAID = """SELECT concat('r', o_custkey % 5) AS repo_id, CASE o_orderkey % 6 WHEN 0 THEN 'code_health' WHEN 1 THEN 'discoverability' WHEN 2 THEN 'structure' WHEN 3 THEN 'verifiability' WHEN 4 THEN 'context_quality' ELSE 'predictability' END AS category,
  CASE o_orderkey % 7 WHEN 0 THEN 'file_naming_conventions' WHEN 1 THEN 'dependency_direction' WHEN 2 THEN 'function_size' WHEN 3 THEN 'file_size' WHEN 4 THEN 'parameter_count' END AS sub_metric,
  concat('o', o_orderkey % 100, '.go') AS file, o_orderkey % 90 AS line, CASE o_orderpriority WHEN '1-URGENT' THEN 'naming is odd' WHEN '2-HIGH' THEN 'it imports a dependency' WHEN '3-MEDIUM' THEN 'too many lines' WHEN '4-NOT SPECIFIED' THEN 'params in a file' ELSE 'no docs' END AS message,
  CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity, o_orderkey % 21 AS ordinal FROM {orders}"""
_NORM = "SELECT concat('r', n_nationkey) AS repo_id, 'suffixed' AS style, 0.1 + n_nationkey * 0.15 AS style_share, 30 + n_nationkey AS function_lines, 200 AS file_lines, 3 AS parameters, 3 AS layers, CASE WHEN n_nationkey % 2 = 0 THEN 'internal/tax' END AS golden FROM {nation} WHERE n_nationkey < 4"
_RULE = """CASE WHEN category = 'discoverability' AND (sub_metric = 'file_naming_conventions' OR message LIKE '%naming%') THEN 1 WHEN category = 'discoverability' AND (sub_metric = 'dependency_direction' OR message LIKE '%dependency%' OR message LIKE '%imports%') THEN 2 WHEN category = 'structure' THEN 3
  WHEN category = 'code_health' AND (sub_metric = 'function_size' OR message LIKE '%function%' OR message LIKE '%lines%') THEN 4 WHEN category = 'code_health' AND (sub_metric = 'file_size' OR message LIKE '%file%') THEN 5
  WHEN category = 'code_health' AND (sub_metric = 'parameter_count' OR message LIKE '%param%') THEN 6 WHEN category = 'context_quality' AND message LIKE '%doc%' THEN 7 END"""
_FIX = f"""WITH s AS ({_SAID.format(orders='orders')}), n AS ({_NORM.format(nation='nation')}), x AS (SELECT s.*, {_RULE} AS rule FROM s),
  y AS (SELECT x.*, style, ['naming_drift', 'dependency_drift', 'structure_drift', 'size_drift', 'size_drift', 'size_drift', 'missing_docs'][rule] AS type, ['medium', 'high', 'high', 'medium', 'medium', 'medium', 'low'][rule] AS priority,
    CASE rule WHEN 1 THEN printf('%s naming (%.0f%% of files)', style, style_share * 100) WHEN 2 THEN 'domain/ has zero adapter imports' WHEN 3 THEN CASE WHEN golden IS NULL THEN 'consistent module structure' ELSE '3 layers per module (golden: ' || golden || ')' END
      WHEN 4 THEN 'p90 function length: ' || function_lines || ' lines' WHEN 5 THEN 'p90 file length: ' || file_lines || ' lines' WHEN 6 THEN 'p90 parameter count: ' || parameters ELSE 'see internal/domain/ for doc style' END AS project_norm FROM x LEFT JOIN n USING (repo_id) WHERE rule IS NOT NULL)"""


def _said(spark, d):
    said = spark.sql(_SAID, orders=table(spark, d, "orders")).withColumn("line", F.col("line").cast("int")).withColumn("ordinal", F.col("ordinal").cast("int"))
    return said, spark.sql(_NORM, nation=table(spark, d, "nation")).withColumn("style_share", F.col("style_share").cast("double"))


@query(
    "q83_fix_instructions",
    f"""{_FIX} SELECT repo_id, type, file, line, message, CASE WHEN rule IN (1, 4, 5, 6) AND style IS NULL THEN NULL ELSE project_norm END AS project_norm, priority, category, severity, row_number() OVER (PARTITION BY repo_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, {_CAT}, ordinal, file, line, message, {_SEV}) - 1 AS place
        FROM y QUALIFY place < 40""",
)
def fix_instructions(spark, d):
    """The first 40 instructions of each repository, a top-k report in which every rule is tried on all issues."""
    rows = P.by_priority(P.instructions(*_said(spark, d)))
    return rows.where("place < 40").drop("ordinal")


@query(
    "q84_fix_rules",
    f"{_FIX} SELECT type, priority, project_norm, category, coalesce(sub_metric, '') AS sub_metric, message, count(*) AS n FROM y WHERE style IS NOT NULL GROUP BY ALL",
)
def fix_rules(spark, d):
    """How often each rule holds, by what it looks at."""
    said, norms = _said(spark, d)
    rows = P.instructions(said.join(norms.select("repo_id"), "repo_id").withColumn("file", F.coalesce("sub_metric", F.lit(""))), norms)
    return rows.groupBy("type", "priority", "project_norm", "category", F.col("file").alias("sub_metric"), "message").agg(F.count("*").alias("n"))


@query(
    "q85_drift",
    f"""{_FIX.split(', x AS')[0]} SELECT repo_id, drift_type, severity, CASE WHEN drift_type = 'size_drift' AND function_lines > 0 THEN message || ' (project p90: ' || function_lines || ' lines)' ELSE message END AS message, count(*) AS n FROM (
        SELECT *, CASE category WHEN 'discoverability' THEN CASE WHEN sub_metric = 'dependency_direction' THEN 'dependency_drift' ELSE 'naming_drift' END WHEN 'structure' THEN 'structure_drift' WHEN 'code_health' THEN 'size_drift' END AS drift_type FROM s LEFT JOIN n USING (repo_id)) WHERE drift_type IS NOT NULL GROUP BY ALL""",
)
def drift(spark, d):
    return P.drift(*_said(spark, d)).groupBy("repo_id", "drift_type", "severity", "message").agg(F.count("*").alias("n"))


_SKIP = (("verifiability", "test_naming"), ("predictability", "consistent_patterns"), ("predictability", "explicit_dependencies"), ("context_quality", None))
_OVER = (("verifiability", 0.5), ("structure", 0.0))


@query(
    "q86_configured_overall",
    f"""{_VER.replace(' w AS (', ' w1 AS (', 1)}, {_PRE[len(_BASE) + 2:].replace('a AS (', 'a2 AS (', 1).replace(' b AS (', ' b2 AS (', 1).replace(' w AS (', ' w2 AS (', 1).replace('LEFT JOIN a USING', 'LEFT JOIN a2 USING').replace('LEFT JOIN b USING', 'LEFT JOIN b2 USING')},
        sc AS (SELECT repo_id, round((test_presence + build_reproducibility + type_safety_signals) / 75::DOUBLE * 100) AS v, round((self_describing_names + error_message_quality) / 50::DOUBLE * 100) AS p FROM w1 JOIN w2 USING (repo_id)),
        o AS (SELECT repo_id, round((v * 0.5::DOUBLE + p * 0.1::DOUBLE) / 0.6::DOUBLE)::BIGINT AS overall FROM sc)
        SELECT repo_id, overall, CASE WHEN overall >= 90 THEN 'A+' WHEN overall >= 80 THEN 'A' WHEN overall >= 70 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 50 THEN 'D' ELSE 'F' END AS grade FROM o""",
)
def configured_overall(spark, d):
    """Overall scores with a category and three sub-metrics skipped and a weight changed, of the categories above."""
    files, paths, trees, _ = facts(spark, d)
    metrics = C.verifiability(files, paths, trees).unionByName(C.context_quality(files, paths, trees)).unionByName(C.predictability(files))
    none = spark.createDataFrame([], T.ISSUES)
    config, weights = spark.createDataFrame(list(_SKIP), "category string, sub_metric string"), spark.createDataFrame(list(_OVER), "category string, weight double")
    return P.overall(P.configured(metrics, none, C.category_scores(metrics, none, files), config, weights)[0])


@query(
    "q87_safe_fixes",
    f"""{_ABS} SELECT repo_id, 'create_file' AS type, 'CLAUDE.md' AS path, 'Generated consistency contract from codebase analysis' AS description FROM repos WHERE NOT EXISTS (SELECT 1 FROM pathx WHERE pathx.repo_id = repos.repo_id AND path = 'CLAUDE.md')
        UNION ALL SELECT DISTINCT repo_id, 'create_file', 'checks/checks_test.go', 'Test stub for package checks' FROM zero WHERE message LIKE '%test%'""",
)
def safe_fixes(spark, d):
    """Files to create: contracts, and tests for the folder ``checks``, in which the issues of verifiability are put here."""
    files, paths, issues = _issues(spark, d)
    own = paths.join(files.select("repo_id").distinct(), "repo_id", "left_semi")
    return P.safe_fixes(issues.withColumn("file", F.when(F.col("category") == "verifiability", "checks/all.go").otherwise(F.col("file"))), own)


@query(
    "q88_onboard_naming",
    f"""{_BASE}, b AS (SELECT repo_id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.go$', '') AS b FROM pathx WHERE path LIKE '%.go' AND NOT path LIKE '%#_test.go' ESCAPE '#')
        SELECT repo_id, CASE WHEN 2 * count_if(contains(b, '_')) > count(*) THEN 'suffixed' ELSE 'bare' END AS style, round(greatest(count_if(contains(b, '_')), count(*) - count_if(contains(b, '_'))) / count(*)::DOUBLE, 9) AS style_share FROM b WHERE b NOT IN ('main', 'doc') GROUP BY 1""",
)
def onboard_naming(spark, d):
    files, paths, _, _ = facts(spark, d)
    return P.onboard_naming(paths.join(files.select("repo_id").distinct(), "repo_id", "left_semi")).withColumn("style_share", F.round("style_share", 9))


@query(
    "q89_build_commands",
    f"""{_BASE} SELECT repo_id, 'make build' AS build, 'make test' AS test FROM pathx WHERE path = 'Makefile' UNION ALL SELECT repo_id, 'go build ./...', 'go test ./...' FROM t WHERE n % 2 = 0""",
)
def build_commands(spark, d):
    files, paths, trees, _ = facts(spark, d)
    own = paths.join(files.select("repo_id").distinct(), "repo_id", "left_semi")
    return P.build_commands(own, trees.select("repo_id", F.col("has_agents").alias("has_go_mod")))


_GRAPH = f"""{_BASE.replace('WITH f', 'WITH RECURSIVE f', 1)}, x AS ({_TO}), e AS (SELECT DISTINCT repo_id, folder AS src, target AS dst FROM x WHERE NOT gen AND NOT test AND a <> b AND (n % 3 <> 0 OR b < a) AND folder <> target),
  nd AS (SELECT repo_id, folder AS p, count_if(port IS NOT NULL) AS ifc, count_if(k % 3 = 0) AS st FROM x WHERE NOT gen AND NOT test GROUP BY 1, 2), every AS (SELECT * FROM nd UNION ALL SELECT DISTINCT repo_id, dst, 0, 0 FROM e WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.repo_id = e.repo_id AND nd.p = e.dst)),
  node AS (SELECT every.*, (SELECT count(*) FROM e WHERE e.repo_id = every.repo_id AND dst = p) AS ca, (SELECT count(*) FROM e WHERE e.repo_id = every.repo_id AND src = p) AS ce FROM every),
  walk AS (SELECT repo_id, src, dst FROM e UNION SELECT walk.repo_id, walk.src, e.dst FROM walk JOIN e ON walk.repo_id = e.repo_id AND walk.dst = e.src), loops AS (SELECT DISTINCT repo_id FROM walk WHERE src = dst),
  md AS (SELECT repo_id, median(ce) AS m FROM node GROUP BY 1),
  ds AS (SELECT repo_id, count(*) AS packages, coalesce(avg(CASE WHEN ifc + st > 0 THEN abs(ifc / (ifc + st)::DOUBLE + CASE WHEN ca + ce = 0 THEN 0 ELSE ce / (ca + ce)::DOUBLE END - 1) END), 0) AS mean, count_if(m >= 1 AND ce > 2 * m) AS far FROM node JOIN md USING (repo_id) GROUP BY 1),
  gs AS (SELECT repo_id, packages, far, CASE WHEN packages <= 1 THEN 1 ELSE CASE WHEN repo_id IN (SELECT repo_id FROM loops) THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN mean > 0.4 THEN greatest(0, 1 - (mean - 0.4::DOUBLE) / 0.8::DOUBLE) ELSE 1 END * 0.36::DOUBLE + (1 - far / packages::DOUBLE) * 0.24::DOUBLE END AS score FROM ds)"""


def _scored_graph(spark, d, functions: bool = False):
    """files, paths, trees, members, and the graph's nodes, edges and scores, which need no functions."""
    files, paths, trees, members = facts(spark, d, True, functions)
    trees = trees.withColumn("module_path", F.lit(MODULE))
    nodes, edges = G.package_graph(files, trees)
    edges = R.durable(edges)
    nodes = R.durable(G.coupled(nodes.drop("io", "io_params", "has_main"), edges))
    node = lambda c: F.struct("repo_id", F.col(c).alias("package")).alias(c)
    on = R.cycle_members(edges.select(node("src"), node("dst"))).select("node.*")
    return files, paths, trees, members, nodes, edges, G.graph_score(nodes, on)


@query("q90_graph_scores", f"{_GRAPH} SELECT repo_id, packages, round(score, 6) AS score FROM gs")
def graph_scores(spark, d):
    """Graphs with and without cycles, far from the main sequence or near it, and with outliers."""
    return _scored_graph(spark, d)[-1].withColumn("score", F.round("score", 6))


_SIDES = f"""{_GRAPH}, lf AS (SELECT *, CASE WHEN path LIKE '%/adapters/%' THEN 'adapters' WHEN path LIKE '%/application/%' THEN 'application' WHEN path LIKE '%/domain/%' THEN 'domain' END AS layer, CASE WHEN NOT (a <> b AND (n % 3 <> 0 OR b < a)) THEN NULL WHEN k % 9 = 4 THEN 'adapters' ELSE 'domain' END AS tl FROM x WHERE path LIKE 'internal/%' AND NOT test),
  lv AS (SELECT *, coalesce(layer IN ('domain', 'application') AND tl = 'adapters', false) AS bad FROM lf WHERE layer IS NOT NULL)"""


@query(
    "q91_direction_scores",
    f"""{_SIDES}, lr AS (SELECT repo_id, greatest(0, 1 - count_if(bad) / count(*)::DOUBLE) AS rate FROM lv GROUP BY 1), g2 AS (SELECT * FROM gs WHERE packages > 1)
        SELECT repo_id, round(CASE WHEN rate IS NULL AND score IS NULL THEN 1 WHEN rate IS NULL THEN score WHEN score IS NULL THEN rate ELSE (rate + score) / 2 END * 25)::BIGINT AS score FROM repos LEFT JOIN lr USING (repo_id) LEFT JOIN g2 USING (repo_id)""",
)
def direction_scores(spark, d):
    """Both sides of the score; repositories without modules have the graph's alone."""
    files, _, _, members, _, _, graph = _scored_graph(spark, d)
    return L.dependency_direction(files, L.layer_violations(files, members)[1], graph)


@query(
    "q92_direction_issues",
    f"""{_SIDES} SELECT repo_id, 'error' AS severity, path AS file, layer || ' layer imports {MODULE}/' || target || ' (dependency direction violation)' AS message, layer || '→adapters' AS pattern FROM lv WHERE bad
        UNION ALL SELECT repo_id, 'warning', NULL, printf('package "%s" imports %d internal packages (median is %.0f)', '{MODULE}/' || p, ce, m), 'coupling-outlier' FROM node JOIN md USING (repo_id) WHERE m >= 1 AND ce > 2 * m""",
)
def direction_issues(spark, d):
    """Issues of imports against the layers' direction, and of packages that import far more than most."""
    files, _, _, members, nodes, edges, _ = _scored_graph(spark, d)
    none = edges.where("false")
    found = P.layout_issues(files, members, ()).where("sub_metric = 'dependency_direction'").unionByName(P.graph_issues(nodes, none))
    return found.select("repo_id", "severity", "file", "message", "pattern")


@query(
    "q93_expected_layers",
    f"""{_BASE}, dirs AS (SELECT repo_id, count(DISTINCT CASE WHEN path LIKE 'internal/%' THEN 1 WHEN path LIKE 'docs/%' THEN 2 WHEN path LIKE 'cmd/%' THEN 3 END) AS d FROM pathx GROUP BY 1), lay AS (SELECT repo_id, count(DISTINCT CASE WHEN path LIKE '%/domain/%' THEN 1 WHEN path LIKE '%/application/%' THEN 2 WHEN path LIKE '%/adapters/%' THEN 3 END) AS l FROM f WHERE path LIKE 'internal/%' GROUP BY 1)
        SELECT repo_id, floor((d + coalesce(l, 0)) / 6::DOUBLE * 25)::BIGINT AS score FROM dirs LEFT JOIN lay USING (repo_id)""",
)
def expected_layers(spark, d):
    files, paths, _, members = facts(spark, d)
    own = paths.join(files.select("repo_id").distinct(), "repo_id", "left_semi")
    return L.expected_layers(members, own, ("internal", "docs", "cmd"), ("domain", "application", "adapters"))


@query(
    "q94_forced_naming",
    f"""{_BASE}, b AS (SELECT repo_id, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.go$', '') AS b, (k % 4 = 0) AS s FROM f WHERE NOT test AND NOT gen), c AS (SELECT repo_id, count_if(s AND NOT path LIKE '%#_test.go' ESCAPE '#') / count(*)::DOUBLE AS share FROM b GROUP BY 1)
        SELECT repo_id, path AS file, CASE WHEN share < 0.4 THEN 'warning' ELSE 'info' END AS severity, 'file "' || b || '.go" uses bare naming but project uses suffixed pattern' AS message FROM b JOIN c USING (repo_id) WHERE share >= 0.25 AND NOT s""",
)
def forced_naming(spark, d):
    """Files without the suffix that a configuration asks for, in repositories where at least a quarter has it."""
    return L.naming_issues(facts(spark, d)[0], ("_service",), "suffixed", 0.25)


@query(
    "q95_suffix_reuse",
    "SELECT c_nationkey, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS reuse FROM (SELECT c_nationkey, c_custkey % 37 AS suffix, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1",
)
def suffix_reuse(spark, d):
    """Share of customers, by nation, whose suffix another one has."""
    rows = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 37).cast("string").alias("suffix"))
    return R.reuse_ratio(rows, ["c_nationkey"], "suffix")


@query(
    "q96_severity_table",
    f"""{_ISS} SELECT repo_id, count_if(severity = 'error') AS error, count_if(severity = 'warning') AS warning, count_if(severity = 'info') AS info, count(*) AS total FROM iss GROUP BY 1""",
)
def severity_table(spark, d):
    """Issues of each severity, in columns."""
    wide = _issues(spark, d)[2].groupBy("repo_id").pivot("severity", list(P.SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", F.col("error") + F.col("warning") + F.col("info"))


_LAYOUT = P.Layout(("_service", "_handler"), "auto", ("internal", "docs", "cmd"), ("domain", "application", "adapters"), (("CLAUDE.md", 10, 5), ("AGENTS.md", 10, 0), (".cursorrules", 5, 400)))


def _scored(spark, d):
    files, paths, trees, members, nodes, edges, _ = _scored_graph(spark, d, True)
    own = paths.join(files.select("repo_id").distinct(), "repo_id", "left_semi")
    there = (("has_claude", "CLAUDE.md"), ("has_agents", "AGENTS.md"), (".cursorrules", ".cursorrules"))
    docs = F.array_compact(F.array(*[F.when(F.col("has_cursor" if c == ".cursorrules" else c), F.struct(F.lit(n).alias("name"), F.length("agent_doc").alias("size"))) for c, n in there]))
    documents = trees.select("repo_id", F.explode(docs).alias("x")).select("repo_id", "x.*")
    return P.score_repositories(files, own, trees, members, nodes, edges, documents, None, _LAYOUT)


_FILES_SCORE = f"""{_BASE}, {_MEMB}, r AS (SELECT repo_id, module, avg(CASE WHEN path LIKE '%#_service.go' ESCAPE '#' OR path LIKE '%#_handler.go' ESCAPE '#' OR path LIKE '%#_test.go' ESCAPE '#' THEN 1 ELSE 0 END) AS s FROM mem GROUP BY 1, 2)
  SELECT repo_id, floor(round(avg(s), 9) * 25)::BIGINT AS score FROM r GROUP BY 1"""
_AGENTS = f"""{_BASE} SELECT repo_id, CASE WHEN has_claude THEN 5 + CASE WHEN length(agent_doc) >= 5 THEN 5 ELSE 0 END ELSE 0 END + CASE WHEN has_agents THEN 10 ELSE 0 END + CASE WHEN has_cursor THEN 2 + CASE WHEN length(agent_doc) >= 400 THEN 3 ELSE 0 END ELSE 0 END AS score FROM t JOIN repos USING (repo_id)"""


@query(
    "q97_category_scores",
    "SELECT repo_id, category, sum(score)::BIGINT AS score FROM ("
    + " UNION ALL ".join(f"SELECT repo_id, category, score FROM ({SQL[q]})" for q in ("q76_verifiability", "q77_context_quality", "q78_predictability", "q79_structure"))
    + f" UNION ALL SELECT repo_id, 'structure', score FROM ({SQL['q93_expected_layers']}) UNION ALL SELECT repo_id, 'structure', score FROM ({_FILES_SCORE}) UNION ALL SELECT repo_id, 'context_quality', score FROM ({_AGENTS})) GROUP BY 1, 2",
)
def category_scores(spark, d):
    """The categories that no debt of issues lowers, from the plan that scores all."""
    return _scored(spark, d)[1].where("category NOT IN ('code_health', 'discoverability')")


@query("q98_sub_metrics_scored", f"{_BASE} SELECT repo_id, count(*) AS sub_metrics, sum(points)::BIGINT AS points FROM repos, (SELECT unnest([20, 20, 20, 20, 20, 25, 25, 25, 25, 25, 25, 25, 25, 25, 25, 25, 25, 25, 25, 20, 25, 25, 25, 25, 25]) AS points) GROUP BY 1")
def sub_metrics_scored(spark, d):
    """Every repository has each of the 25 sub-metrics, with its points."""
    return _scored(spark, d)[0].groupBy("repo_id").agg(F.count_distinct("name").alias("sub_metrics"), F.sum("points").alias("points"))
