"""Queries on layouts: parts as source files, brands as modules and types as repositories; documents as files of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import layout as L
from lodeworks.plans.catalogue import _credit_sql, query, table

EXPECTED = ("_ring", "_bolt", "_gear")
WIDTH, PERCENT = 20, 15
_LAYER = "CASE p_size % 5 WHEN 0 THEN 'domain' WHEN 1 THEN 'application' WHEN 2 THEN 'adapters' WHEN 3 THEN 'ports' ELSE 'pkg' END"
_TO = "CASE p_partkey % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'application' WHEN 2 THEN 'adapters' ELSE 'pkg' END"
_PATH = f"concat('internal/', {_LAYER}, '/', replace(p_brand, '#', ''), '/', p_partkey, '_', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 6 = 0 THEN '_test' ELSE '' END, '.go')"
_P = f"""WITH p AS (SELECT p_type AS repo_id, p_brand AS name, {_LAYER} AS layer, {_TO} AS target, {_PATH} AS path, p_partkey AS k, p_partkey % 6 = 0 AS test, p_partkey % 7 = 0 AS gen,
  '_' || regexp_extract(p_name, '[^ ]*$') AS suffix, p_size FROM part)"""
_KNOWN = "(" + ", ".join(f"'{x}'" for x in EXPECTED) + ")"


def part_files(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts: files (repo_id, path, imports, interfaces, is_generated), and members: the module and layer of each."""
    p = table(spark, d, "part").selectExpr(
        "p_type AS repo_id", "p_brand AS name", f"{_LAYER} AS layer", f"{_PATH} AS path", f"array(concat('m/internal/', {_TO})) AS imports",
        "IF(p_size > 45, array('I'), CAST(array() AS ARRAY<STRING>)) AS interfaces", "p_partkey % 7 = 0 AS is_generated",
    )
    return p.drop("name", "layer"), p.select("repo_id", F.col("name").alias("module"), "layer", "path")


_VIOLATES = "(layer = 'domain' AND target IN ('application', 'adapters') OR layer = 'application' AND target = 'adapters')"


@query("q54_layer_violations", f"{_P} SELECT repo_id, path, layer, 'm/internal/' || target AS \"import\", layer || '→' || target AS pattern FROM p WHERE NOT test AND {_VIOLATES}")
def layer_violations(spark, d):
    return L.layer_violations(*part_files(spark, d))[0]


@query(
    "q55_dependency_direction",
    f"""{_P} SELECT repo_id, round(greatest(0, 1 - count_if({_VIOLATES}) / count(*)::DOUBLE) * 25)::BIGINT AS score FROM p
        WHERE NOT test AND layer IN ('domain', 'application', 'adapters') GROUP BY 1""",
)
def dependency_direction(spark, d):
    """The score of repositories without a graph."""
    files, members = part_files(spark, d)
    return L.dependency_direction(files, L.layer_violations(files, members)[1], spark.createDataFrame([], "repo_id string, packages long, score double"))


_NAMES = f"{_P}, n AS (SELECT repo_id, path, suffix IN {_KNOWN} AS s FROM p WHERE NOT test AND NOT gen), c AS (SELECT repo_id, 2 * count_if(s) > count(*) AS dominant, greatest(count_if(s), count(*) - count_if(s)) / count(*)::DOUBLE AS consistency FROM n GROUP BY 1)"


@query(
    "q56_file_naming_score",
    f"""{_NAMES}, u AS (SELECT repo_id, sum(CASE WHEN k > 1 THEN k ELSE 0 END) / sum(k)::DOUBLE AS reuse FROM (SELECT repo_id, suffix, count(*) AS k FROM p WHERE NOT test AND suffix IN {_KNOWN} GROUP BY ALL) GROUP BY 1)
        SELECT repo_id, round((CASE WHEN dominant THEN (consistency + coalesce(reuse, 1)) / 2 ELSE consistency END) * 25)::BIGINT AS score FROM c LEFT JOIN u USING (repo_id)""",
)
def file_naming_score(spark, d):
    return L.file_naming(part_files(spark, d)[0], EXPECTED)


@query(
    "q57_naming_issues",
    f"""{_NAMES} SELECT repo_id, path AS file, CASE WHEN consistency < 0.4 THEN 'warning' ELSE 'info' END AS severity,
        'file "' || regexp_extract(path, '[^/]*$') || CASE WHEN dominant THEN '" uses bare naming but project uses suffixed pattern' ELSE '" uses suffixed naming but project uses bare pattern' END AS message
        FROM n JOIN c USING (repo_id) WHERE s <> dominant AND consistency >= 0.6""",
)
def naming_issues(spark, d):
    return L.naming_issues(part_files(spark, d)[0], EXPECTED)


_MODULES = f"{_P}, m AS (SELECT repo_id, name, list(DISTINCT layer) AS l, count_if(NOT test) AS n, list(DISTINCT suffix) FILTER (NOT test AND suffix IN {_KNOWN}) AS s FROM p GROUP BY 1, 2)"


@query(
    "q58_predictable_structure",
    f"""{_MODULES}, c AS (SELECT repo_id, 2 * count_if(suffix IN {_KNOWN}) > count(*) AS dominant FROM p WHERE NOT test AND NOT gen GROUP BY 1),
        x AS (SELECT a.repo_id, len(list_intersect(a.l, b.l)) / len(list_distinct(a.l || b.l))::DOUBLE AS jl, CASE WHEN a.n = 0 AND b.n = 0 THEN 1 ELSE least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE END AS jn,
          CASE WHEN NOT dominant THEN 1 WHEN len(coalesce(a.s, []) || coalesce(b.s, [])) = 0 THEN 1
          ELSE len(list_intersect(coalesce(a.s, []), coalesce(b.s, []))) / len(list_distinct(coalesce(a.s, []) || coalesce(b.s, [])))::DOUBLE END AS js
          FROM m a JOIN m b ON a.repo_id = b.repo_id AND a.name < b.name AND list_has_any(a.l, b.l) JOIN c ON c.repo_id = a.repo_id)
        SELECT repo_id, round((avg(jl) * 0.5 + avg(js) * 0.3 + avg(jn) * 0.2) * 25)::BIGINT AS score FROM x GROUP BY 1""",
)
def predictable_structure(spark, d):
    files, members = part_files(spark, d)
    return L.predictable_structure(members, files, EXPECTED)


@query(
    "q59_missing_layers",
    f"""{_MODULES}, l AS (SELECT DISTINCT repo_id, name, layer FROM p), k AS (SELECT repo_id, layer, count(*) AS c FROM l GROUP BY 1, 2), t AS (SELECT repo_id, count(*) AS t FROM k GROUP BY 1),
        n AS (SELECT repo_id, count(*) AS n FROM m GROUP BY 1), x AS (SELECT m.repo_id, m.name, k.layer FROM m JOIN k USING (repo_id) JOIN n USING (repo_id) WHERE c > n.n // 2 AND n.n > 1 AND NOT list_contains(m.l, k.layer))
        SELECT repo_id, name, layer, CASE WHEN count(*) OVER (PARTITION BY repo_id, name) > 0.75 * t THEN 'warning' ELSE 'info' END AS severity FROM x JOIN t USING (repo_id)""",
)
def missing_layers(spark, d):
    return L.missing_layers(part_files(spark, d)[1])


@query(
    "q60_expected_layers",
    f"""{_P} SELECT repo_id, floor((2 + count(DISTINCT CASE WHEN layer IN ('domain', 'application', 'adapters') THEN layer END) - 1) / 5::DOUBLE * 25)::BIGINT AS score FROM p GROUP BY 1""",
)
def expected_layers(spark, d):
    files, members = part_files(spark, d)
    return L.expected_layers(members, files.select("repo_id", "path"), ("internal", "cmd"), ("domain", "application", "adapters"))


@query(
    "q61_expected_files",
    f"""{_P}, r AS (SELECT repo_id, name, count_if(test OR suffix IN {_KNOWN}) / count(*)::DOUBLE AS r FROM p GROUP BY 1, 2) SELECT repo_id, floor(round(avg(r), 9) * 25)::BIGINT AS score FROM r GROUP BY 1""",
)
def expected_files(spark, d):
    return L.expected_files(part_files(spark, d)[1], EXPECTED)


@query("q62_bare_contracts", f"{_P} SELECT repo_id, name FROM p WHERE layer IN ('domain', 'application') GROUP BY 1, 2 HAVING NOT bool_or(p_size > 45)")
def bare_contracts(spark, d):
    files, members = part_files(spark, d)
    return L.bare_contracts(members, files)


_AGENTS = (("CLAUDE.md", 10, 60), ("AGENTS.md", 10, None), (".cursorrules", 5, 400))


@query(
    "q63_agent_files",
    f"""WITH w(name, points, least) AS (VALUES {', '.join(f"('{a}', {b}, {'NULL' if c is None else c})" for a, b, c in _AGENTS)}),
        f AS (SELECT source AS repo_id, CASE WHEN n_chars < 100 THEN 'CLAUDE.md' WHEN lang = 'de' THEN 'AGENTS.md' ELSE '.cursorrules' END AS name, max(n_chars) AS size FROM documents GROUP BY ALL),
        x AS (SELECT r.repo_id, points, CASE WHEN size IS NULL THEN 0 WHEN least IS NULL THEN points ELSE points // 2 + CASE WHEN size >= least THEN points - points // 2 ELSE 0 END END AS got
          FROM (SELECT DISTINCT repo_id FROM f) r CROSS JOIN w LEFT JOIN f ON f.name = w.name AND f.repo_id IS NOT DISTINCT FROM r.repo_id)
        SELECT repo_id, sum(got)::BIGINT AS score, sum(points)::BIGINT AS points FROM x GROUP BY 1""",
)
def agent_files(spark, d):
    name = F.when(F.col("n_chars") < 100, "CLAUDE.md").when(F.col("lang") == "de", "AGENTS.md").otherwise(".cursorrules")
    present = table(spark, d, "documents").groupBy(F.col("source").alias("repo_id"), name.alias("name")).agg(F.max("n_chars").alias("size"))
    return L.agent_files(present, spark.createDataFrame(list(_AGENTS), "name string, points int, min_size int"))


def token_files(spark, d: str) -> DataFrame:
    """Facts: documents as files of tokens, a repository a source and language."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", "_test.go").otherwise(".go"))
    return t.select(F.col("source").alias("repo_id"), path.alias("path"), F.lit(False).alias("is_generated"), (F.size(F.split("text", "\n"))).alias("total_lines"), F.split("text", " ").alias("tokens"))


_DUP = f"""WITH w AS (SELECT source AS r, doc_id, lang, string_split(text, ' ') AS ws, len(string_split(text, chr(10))) AS n FROM documents WHERE len(string_split(text, ' ')) >= {WIDTH}),
  g AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + {WIDTH - 1}], ' ')) AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM w)),
  h AS (SELECT r, g FROM g GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2), q AS (SELECT DISTINCT g.r, doc_id, i FROM g JOIN h ON g.g = h.g AND g.r = h.r),
  c AS (SELECT r, doc_id, sum(least({WIDTH}, coalesce(i - prev, {WIDTH}))) AS d FROM (SELECT *, lag(i) OVER (PARTITION BY r, doc_id ORDER BY i) AS prev FROM q) GROUP BY 1, 2),
  x AS (SELECT w.r, w.doc_id, lang, n, least(floor(coalesce(d, 0) / greatest(1, len(ws) / n::DOUBLE)), n)::BIGINT AS lines FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.r = c.r),
  y AS (SELECT r, doc_id, 'd' || doc_id || CASE WHEN lang = 'de' THEN '_test.go' ELSE '.go' END AS path, lines, lines * 100 // n AS percent, CASE WHEN lang = 'de' THEN {2 * PERCENT} ELSE {PERCENT} END AS most FROM x)"""


@query("q64_code_duplication", f"{_DUP} SELECT r AS repo_id, round(round(CASE WHEN count(*) < 2 THEN 1 ELSE avg({_credit_sql('percent', 'most')}) END, 9) * 20)::BIGINT AS score FROM y GROUP BY 1")
def code_duplication(spark, d):
    return L.code_duplication(token_files(spark, d), WIDTH, PERCENT)


@query("q65_duplication_issues", f"{_DUP} SELECT r AS repo_id, path AS file, CASE WHEN percent >= 3 * most THEN 'error' WHEN percent >= 1.5 * most THEN 'warning' ELSE 'info' END AS severity, lines, percent FROM y WHERE percent > most")
def duplication_issues(spark, d):
    return L.duplication_issues(token_files(spark, d), WIDTH, PERCENT)
