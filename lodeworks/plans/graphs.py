"""Queries on package graphs: nations as packages that import the nations they sell more to, a repository an order priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import packages as P
from lodeworks.operators import relational as R
from lodeworks.plans.catalogue import query, table, trade_edges

MODULE = "example.com/m"
#: Folder of a nation's package, by its key modulo 8.
FOLDERS = ("internal/domain", "internal/application", "internal/adapters/inbound", "internal/adapters/outbound", "cmd", "pkg", "internal/ports", "internal/store")
_FOLDER = f"CASE n_nationkey % 8 {' '.join(f'WHEN {i} THEN {chr(39)}{x}{chr(39)}' for i, x in enumerate(FOLDERS))} END || '/n' || n_nationkey"


def trade_files(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts: a file a nation that sells more than it buys to any other. A nation that never does is only imported."""
    folder = F.expr(_FOLDER)
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", folder.alias("folder"))
    edges = trade_edges(spark, d, "o_orderpriority")
    to = n.select(F.col("n_nationkey").alias("dst"), F.concat_ws("/", F.lit(MODULE), "folder").alias("import"))
    imports = edges.join(F.broadcast(to), "dst").groupBy(F.col("o_orderpriority").alias("repo_id"), F.col("src").alias("n_nationkey")).agg(F.collect_set("import").alias("own"))  # a name a nation
    k, no = F.col("n_nationkey"), lambda t: F.array().cast(f"array<{t}>")
    fn = F.expr("""named_struct('name', IF(n_nationkey % 12 = 4, 'main', 'Sell'), 'receiver', '', 'exported', true, 'line_start', 1, 'line_end', 9,
        'params', array(named_struct('name', 'p', 'type', IF(n_nationkey % 9 = 2, '*sql.DB', 'string'))), 'returns', array('error'), 'max_nesting', 1, 'max_cond_ops', 1,
        'cognitive_complexity', 1, 'string_literal_ratio', 0.0D, 'max_case_arms', 0, 'avg_case_lines', 0.0D)""")
    files = imports.join(F.broadcast(n), "n_nationkey").select(
        "repo_id", F.concat_ws("/", "folder", F.lit("f.go")).alias("path"), F.lit("p").alias("package"), F.lit(False).alias("package_doc"), F.lit(0).alias("init_functions"), F.lit(9).alias("total_lines"),
        F.lit(False).alias("is_generated"), F.lit(False).alias("has_cgo"), F.array_repeat(F.lit("T"), (k % 4).cast("int")).alias("structs"), F.array_repeat(F.lit("I"), (F.col("n_regionkey") % 3).cast("int")).alias("interfaces"),
        no("struct<name:string,methods:array<string>>").alias("interface_defs"), F.concat("own", F.when(k % 6 == 1, F.array(F.lit("net/http"), F.lit("fmt"))).otherwise(F.array(F.lit("fmt")))).alias("imports"),
        no("string").alias("global_vars"), no("struct<has_wrap:boolean,has_context:boolean>").alias("error_calls"), no("struct<safe:boolean>").alias("type_assertions"), F.array(fn).alias("functions"),
    )
    trees = table(spark, d, "orders").select(F.col("o_orderpriority").alias("repo_id")).distinct().select("repo_id", F.lit(MODULE).alias("module_path"))
    return files, trees


def _graph(spark, d: str):
    nodes, edges = P.package_graph(*trade_files(spark, d))
    return P.coupled(nodes, edges), edges


_F = """SELECT o_orderpriority AS r, s_nationkey AS a, c_nationkey AS b, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2, 3"""
_BASE = f"""WITH RECURSIVE f AS ({_F}), e AS (SELECT f.r, f.a AS src, f.b AS dst FROM f LEFT JOIN f g ON f.r = g.r AND f.a = g.b AND f.b = g.a WHERE f.q > coalesce(g.q, 0)),
  o AS (SELECT r, src AS k, count(*) AS ce FROM e GROUP BY ALL), i AS (SELECT r, dst AS k, count(*) AS ca FROM e GROUP BY ALL),
  n AS (SELECT coalesce(o.r, i.r) AS r, coalesce(o.k, i.k) AS k, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM o FULL JOIN i ON o.r = i.r AND o.k = i.k),
  g AS (SELECT r, k, ca, ce, {_FOLDER} AS folder, k % 8 AS kind, CASE WHEN ce > 0 THEN n_regionkey % 3 ELSE 0 END AS ifaces, CASE WHEN ce > 0 THEN k % 4 ELSE 0 END AS structs,
    ce > 0 AND k % 6 = 1 AS io, ce > 0 AND k % 9 = 2 AS iop, ce > 0 AND k % 12 = 4 AS main FROM n JOIN nation ON k = n_nationkey)"""
_ROLES = f"""{_BASE}, v AS (
    SELECT r, k, CASE kind WHEN 0 THEN 'core' WHEN 1 THEN 'orchestrator' ELSE 'adapter' END AS role, CASE kind WHEN 1 THEN 0.80::DOUBLE WHEN 7 THEN 0.75::DOUBLE ELSE 0.85::DOUBLE END AS c FROM g WHERE kind IN (0, 1, 2, 3, 7)
    UNION ALL SELECT r, k, CASE WHEN io THEN 'adapter' ELSE 'core' END, CASE WHEN io THEN 0.70::DOUBLE WHEN ifaces > 0 AND ce = 0 THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END FROM g
      WHERE io OR ifaces > 0 OR (NOT iop AND structs > 0 AND ca > 0)
    UNION ALL SELECT r, k, CASE WHEN main THEN 'entry_point' WHEN iop THEN 'adapter' WHEN 2 * ifaces > ifaces + structs THEN 'ports' ELSE 'core' END,
      CASE WHEN main THEN 0.95::DOUBLE WHEN iop THEN 0.75::DOUBLE WHEN 2 * ifaces > ifaces + structs THEN 0.70::DOUBLE ELSE 0.60::DOUBLE END FROM g
      WHERE main OR iop OR 2 * ifaces > ifaces + structs OR (ca >= 2 AND ifaces + structs > 0 AND NOT io)),
  t AS (SELECT r, k, role, count(*) AS m, max(c) AS c FROM v GROUP BY ALL),
  b AS (SELECT r, k, role, least(0.95::DOUBLE, CASE WHEN m >= 2 THEN c + 0.10::DOUBLE ELSE c END) AS c FROM
    (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY m DESC, c DESC, CASE role WHEN 'entry_point' THEN 0 WHEN 'adapter' THEN 1 WHEN 'orchestrator' THEN 2 WHEN 'ports' THEN 3 ELSE 4 END) AS p FROM t) WHERE p = 1),
  role AS (SELECT g.r, g.k, folder, kind, CASE WHEN kind = 4 THEN 'entry_point' WHEN kind = 6 THEN 'ports' WHEN b.c >= 0.7 THEN b.role END AS role,
    CASE WHEN kind = 4 THEN 0.95::DOUBLE WHEN kind = 6 THEN 0.90::DOUBLE ELSE coalesce(b.c, 0) END AS confidence FROM g LEFT JOIN b USING (r, k))"""
_CYCLE = "w AS (SELECT r, src, dst FROM e UNION SELECT w.r, w.src, e.dst FROM w JOIN e ON w.r = e.r AND w.dst = e.src), oc AS (SELECT DISTINCT r, src AS k FROM w WHERE src = dst)"
_VIOLATIONS = f"""{_ROLES}, {_CYCLE}, x AS (SELECT e.r, s.folder AS package, CASE
      WHEN s.role IN ('core', 'ports') AND t.role = 'adapter' THEN 'imports adapter' WHEN s.role IN ('core', 'ports') AND t.role = 'orchestrator' THEN 'imports application'
      WHEN s.role = 'orchestrator' AND t.role = 'adapter' THEN 'imports adapter'
      WHEN s.role = 'adapter' AND t.role = 'adapter' AND NOT (s.kind = 2 AND t.kind = 3) THEN 'imports n' || t.k END AS message
    FROM e JOIN role s ON e.r = s.r AND e.src = s.k JOIN role t ON e.r = t.r AND e.dst = t.k
    UNION ALL SELECT oc.r, folder, 'in import cycle' FROM oc JOIN g USING (r, k)),
  viol AS (SELECT r AS repo_id, '{MODULE}/' || package AS package, message FROM x WHERE message IS NOT NULL)"""


def _on_cycle(edges: DataFrame) -> DataFrame:
    node = lambda c: F.struct("repo_id", F.col(c).alias("package")).alias(c)
    return R.cycle_members(edges.select(node("src"), node("dst"))).select("node.*")


@query("q49_package_roles", f"{_ROLES} SELECT r AS repo_id, '{MODULE}/' || folder AS package, role, round(confidence, 6) AS confidence FROM role")
def package_roles(spark, d):
    nodes, _ = _graph(spark, d)
    return P.package_roles(nodes).withColumn("confidence", F.round("confidence", 6))


@query("q50_package_violations", f"{_VIOLATIONS} SELECT repo_id, package, message FROM viol")
def package_violations(spark, d):
    nodes, edges = _graph(spark, d)
    return P.package_violations(nodes, edges, P.package_roles(nodes), _on_cycle(edges))


@query(
    "q51_graph_score",
    f"""{_BASE}, {_CYCLE}, m AS (SELECT r, median(ce) AS m FROM g GROUP BY 1),
       dist AS (SELECT r, count(*) AS packages, coalesce(avg(CASE WHEN ifaces + structs > 0 THEN abs(ifaces / (ifaces + structs)::DOUBLE + ce / (ca + ce)::DOUBLE - 1) END), 0) AS mean,
         count_if(m >= 1 AND ce > 2 * m) AS far FROM g JOIN m USING (r) GROUP BY 1)
       SELECT r AS repo_id, packages, CASE WHEN packages <= 1 THEN 1 ELSE round((CASE WHEN EXISTS (SELECT 1 FROM oc WHERE oc.r = dist.r) THEN 0 ELSE 0.4::DOUBLE END)
         + (CASE WHEN mean > 0.4 THEN greatest(0, 1 - (mean - 0.4::DOUBLE) / 0.8::DOUBLE) ELSE 1 END) * 0.36::DOUBLE + (1 - far / packages::DOUBLE) * 0.24::DOUBLE, 6) END AS score FROM dist""",
)
def graph_score(spark, d):
    nodes, edges = _graph(spark, d)
    return P.graph_score(nodes, _on_cycle(edges)).withColumn("score", F.round("score", 6))


@query(
    "q52_coupling_outliers",
    f"""{_BASE}, m AS (SELECT r, median(ca) AS m FROM g GROUP BY 1)
       SELECT r AS repo_id, '{MODULE}/' || folder AS package, ca AS ce, m AS median FROM g JOIN m USING (r) WHERE m >= 1 AND ca > 1.5::DOUBLE * m""",
)
def coupling_outliers(spark, d):
    """Outliers of the graph with its edges turned round, whose degrees differ more."""
    nodes, _ = _graph(spark, d)
    return P.coupling_outliers(nodes.withColumn("ce", F.col("ca")), 1.5)


@query(
    "q53_graph_report",
    f"""{_VIOLATIONS}, c AS (SELECT r, '{MODULE}/' || folder AS package, role, ca, ce FROM g JOIN role USING (r, k, folder)), y AS (SELECT repo_id AS r, package, count(*) AS v FROM viol GROUP BY ALL),
       z AS (SELECT c.r AS repo_id, c.package, role, ca, ce, coalesce(v, 0) AS n_violations, row_number() OVER (PARTITION BY c.r ORDER BY coalesce(v, 0) > 0 DESC, ca DESC, c.package) AS place FROM c LEFT JOIN y ON c.r = y.r AND c.package = y.package)
       SELECT repo_id, place, package, role, ca, ce, n_violations FROM z WHERE place <= 15""",
)
def graph_report(spark, d):
    """The first 15 packages of each repository: a top-k report."""
    nodes, edges = _graph(spark, d)
    roles = P.package_roles(nodes)
    return P.graph_report(nodes, roles, P.package_violations(nodes, edges, roles, _on_cycle(edges)), 15)
