"""Queries on modules, blueprints and checks: parts as source files of repositories of both layouts, a repository a type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import blueprints as B
from lodeworks.operators import modules as M
from lodeworks.operators import relational as R
from lodeworks.plans.catalogue import query, table

# A part's size says which file of its module (brand) it is: by layout, folder and name, and what the file holds.
# {m} is the module, {e} the entity's snake name, {M} and {E} both in Pascal case, z the sum of sizes of the file's parts.
_SLOTS = (
    ("internal/{m}/domain/{e}.go", "internal/domain/{m}/{e}.go", "struct:{E} struct:{E}Input function:New{E} method:Validate?z%3 method:Total?z%2"),
    ("internal/{m}/domain/{e}_test.go", "internal/domain/{m}/{e}_test.go", "function:TestNew{E} function:TestTotal?z%2"),
    ("internal/{m}/domain/{m}_errors.go", "internal/domain/{m}_errors.go", "struct:{M}Error method:Error"),
    ("internal/{m}/application/{m}_service.go", "internal/application/{m}/{m}_service.go", "struct:{M}Service function:New{M}Service method:Create method:List?z%4"),
    ("internal/{m}/application/{m}_ports.go", "internal/ports/{m}/{m}_ports.go", "interface:{E}Repository interface:Clock?z%2"),
    ("internal/{m}/application/{m}_service_test.go", "internal/app/{m}/{m}_service_test.go", "function:Test{M}Service"),
    ("internal/{m}/adapters/http/{e}_handler.go", "internal/adapters/inbound/{m}/{e}_handler.go", "struct:{E}Handler function:New{E}Handler method:Register?z%3"),
    ("internal/{m}/adapters/http/{e}_routes.go", "internal/adapters/inbound/{m}_routes.go", "function:Routes?z%2"),
    ("internal/{m}/adapters/repository/{e}_repository.go", "internal/adapters/outbound/{m}/{e}_repository.go", "struct:Sql{E}Repository method:Save method:Find?z%2"),
    ("internal/{m}/adapters/repository/{m}_store.go", "internal/infra/{m}/{m}_store.go", "struct:Store?z%2"),
    ("internal/{m}/{m}.go", "internal/platform/{m}.go", "function:Run"),
    ("pkg/internal/{m}/adapters/grpc/{e}_server.go", "pkg/internal/core/{m}/{e}_server.go", "struct:{E}Server interface:{E}Stream?z%4"),
    ("internal/{m}/domain/{m}_value.go", "internal/adapter/outbound/{m}/{m}_value.go", "struct:Amount?z%2 function:Parse"),
    ("cmd/{m}/main.go", "cmd/{m}/main.go", "function:Run"),
    ("internal/{m}_root.go", "internal/tools/{m}_root.go", "struct:Root"),
)
_NAMES = {"{m}": "m", "{e}": "e", "{M}": "mp", "{E}": "ep"}


def _text(template: str) -> str:
    """SQL of a template: its constant parts and names, joined."""
    parts, rest = [], template
    while rest:
        at = min((rest.find(k) for k in _NAMES if k in rest), default=len(rest))
        if at:
            parts.append(f"'{rest[:at]}'")
        if rest[at:]:
            parts.append(_NAMES[rest[at : at + 3]])
        rest = rest[at + 3 :]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _facts(items: str, array: str) -> str:
    """SQL of the array of (kind, name) of a file, in this dialect's words for an array."""
    each = []
    for item in items.split():
        fact, _, when = item.partition("?")
        kind, name = fact.split(":")
        value = f"concat('{kind}:', {_text(name)})"
        each.append(f"CASE WHEN {when.replace('%', ' % ')} <> 0 THEN {value} END" if when else value)
    return array.format(", ".join(each))


_CROSS = "p_type IN ('ECONOMY', 'PROMO')"
_SLOT = f"p_size % {len(_SLOTS)}"


def _case(values: list[str]) -> str:
    return "CASE slot " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _sql(array: str) -> str:
    """(repo_id, path, facts): a row a file."""
    return f"""SELECT repo_id, CASE WHEN cross_cut THEN {_case([_text(b) for _, b, _ in _SLOTS])} ELSE {_case([_text(a) for a, _, _ in _SLOTS])} END AS path, {_case([_facts(c, array) for _, _, c in _SLOTS])} AS facts
      FROM (SELECT *, concat(upper(substr(m, 1, 1)), substr(m, 2), CASE WHEN b THEN '' ELSE 'Rule' END) AS ep, concat(m, CASE WHEN b THEN '' ELSE '_rule' END) AS e, concat(upper(substr(m, 1, 1)), substr(m, 2)) AS mp
        FROM (SELECT p_type AS repo_id, {_CROSS} AS cross_cut, lower(replace(p_brand, '#', '')) AS m, p_brand LIKE '%3' AS b, {_SLOT} AS slot, sum(p_size) AS z FROM {{part}} GROUP BY p_type, p_brand, {_SLOT}) t) u"""


def source_files(spark, d: str) -> DataFrame:
    """Facts: files (repo_id, path, structs, interfaces, functions), of which each holds a handful."""
    rows = spark.sql(_sql("filter(array({}), x -> x IS NOT NULL)").format(part="{part}"), part=table(spark, d, "part"))
    of = lambda k: F.transform(F.filter("facts", lambda x: F.startswith(x, F.lit(f"{k}:"))), lambda x: F.substring_index(x, ":", -1))
    fn = lambda k, r: F.transform(of(k), lambda x: F.struct(x.alias("name"), F.lit(r).alias("receiver")))
    return rows.select("repo_id", "path", of("struct").alias("structs"), of("interface").alias("interfaces"), F.concat(fn("function", ""), fn("method", "*T")).alias("functions"))


_F = f"f AS ({_sql('list_filter([{}], lambda x: x IS NOT NULL)').replace('{part}', 'part')})"
# split at the first ``internal``; what follows it, b, begins with the layer or the module
_TOP = "(" + ", ".join(f"'{x}'" for x in M.TOP_LAYERS) + ")"
_TOP_CASE = "CASE b[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.TOP_LAYERS.items()) + " END"
_MEMBERS = f"""WITH {_F}, s AS (SELECT repo_id, path, string_split(path, '/') AS p FROM f), i AS (SELECT repo_id, path, p[list_position(p, 'internal') + 1:] AS b FROM s WHERE list_contains(p, 'internal')),
  lay AS (SELECT repo_id, CASE WHEN count(DISTINCT CASE WHEN b[1] IN {_TOP} THEN b[1] END) >= 0.5 * count(DISTINCT b[1]) THEN 'cross-cutting' ELSE 'per-feature' END AS layout FROM i GROUP BY 1),
  c AS (SELECT repo_id, 'cross-cutting' AS layout, CASE WHEN len(b) <= 2 THEN b[1] WHEN b[1] IN ('adapters', 'adapter') AND len(b) > 3 AND b[2] IN ('inbound', 'outbound') THEN b[3] ELSE b[2] END AS module, {_TOP_CASE} AS layer, path FROM i WHERE b[1] IN {_TOP}),
  g AS (SELECT repo_id, 'per-feature' AS layout, b[1] AS module, CASE WHEN regexp_matches(array_to_string(b[2:], '/'), '^adapters/(http|repository|grpc|inbound|outbound)(/|$)') THEN 'adapters'
    WHEN b[2] IN ('application', 'domain') THEN b[2] END AS layer, path FROM i WHERE len(b) > 1),
  m AS (SELECT repo_id, layout, module, 'internal/' || module AS module_path, layer, path FROM (SELECT * FROM c UNION ALL SELECT * FROM g) JOIN lay USING (repo_id, layout))"""


@query("q66_module_files", f"{_MEMBERS} SELECT * FROM m")
def module_files(spark, d):
    return M.module_files(source_files(spark, d))


@query(
    "q67_modules",
    f"""{_MEMBERS} SELECT repo_id, module, module_path, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS layers, count(*) AS n_files, count_if(path LIKE '%\\_test.go' ESCAPE '\\') AS n_tests FROM m GROUP BY ALL ORDER BY 1, 2""",
)
def module_table(spark, d):
    """Modules by name."""
    return M.modules(M.module_files(source_files(spark, d))).withColumn("layers", F.array_join("layers", ",")).orderBy("repo_id", "module")


_HAS = "has AS (SELECT repo_id, count_if(layer = 'domain') > 0 AS d, count_if(layer = 'application') > 0 AS a, count_if(layer = 'adapters') > 0 AS x FROM m GROUP BY 1)"


@query(
    "q68_dependency_rules",
    f"""{_MEMBERS}, {_HAS} SELECT repo_id, CASE WHEN d AND a AND x THEN 'hexagonal' WHEN d OR a THEN 'layered' ELSE 'flat' END AS style, source, forbids, reason FROM has, LATERAL (
        SELECT 'domain' AS source, 'application' AS forbids, 'domain layer must not depend on application layer' AS reason WHERE d AND a
        UNION ALL SELECT 'domain', 'adapters', 'domain layer must not depend on adapter layer' WHERE d AND x
        UNION ALL SELECT 'application', 'adapters', 'application layer must not depend on adapter layer' WHERE a AND x)""",
)
def dependency_rules(spark, d):
    members = M.module_files(source_files(spark, d))
    return M.architecture(members).join(M.dependency_rules(members), "repo_id")


_ELEMENTS = "e AS (SELECT repo_id, path, string_split(x, ':')[1] AS kind, string_split(x, ':')[2] AS name, pos FROM (SELECT repo_id, path, unnest(facts) AS x, generate_subscripts(facts, 1) AS pos FROM f))"
_BASE = "regexp_extract(path, '[^/]*$')"
_GOLDEN = f"""{_ELEMENTS}, w AS (SELECT repo_id, module, count(*) AS n, count(DISTINCT layer) AS l, count_if(path LIKE '%#_test.go' ESCAPE '#') AS t, count_if(path LIKE '%error%' AND NOT path LIKE '%#_test.go' ESCAPE '#') > 0 AS err FROM m GROUP BY 1, 2),
  v AS (SELECT m.repo_id, m.module, coalesce(bool_or(kind = 'method' AND name = 'Validate'), false) AS val, coalesce(bool_or(kind = 'function' AND name LIKE 'New%'), false) AS con, coalesce(bool_or(kind = 'interface'), false) AS ifc
    FROM m LEFT JOIN e ON e.repo_id = m.repo_id AND e.path = m.path GROUP BY 1, 2),
  terms AS (SELECT repo_id, module, n / (max(n) OVER (PARTITION BY repo_id))::DOUBLE AS completeness, least(l / 4::DOUBLE, 1::DOUBLE) AS depth, CASE WHEN n = t THEN 0::DOUBLE ELSE least(t / (n - t)::DOUBLE, 1::DOUBLE) END AS tests,
    CASE WHEN val THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN con THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN ifc THEN 0.3::DOUBLE ELSE 0 END AS patterns, CASE WHEN err THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN t > 0 THEN 0.5::DOUBLE ELSE 0 END AS documents FROM w JOIN v USING (repo_id, module)),
  sc AS (SELECT *, round(completeness * 0.30::DOUBLE + depth * 0.25::DOUBLE + tests * 0.20::DOUBLE + patterns * 0.15::DOUBLE + documents * 0.10::DOUBLE, 9) AS score FROM terms),
  gold AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, module) = 1 AS golden FROM sc)"""


def _golden(spark, d):
    """Facts are derived, and members found, once for the many joins that read them."""
    files = R.durable(source_files(spark, d))
    members = R.durable(M.module_files(files))
    return files, members, B.golden_scores(members, B.elements(files))


@query("q69_golden_scores", f"{_MEMBERS}, {_GOLDEN} SELECT * FROM gold")
def golden_scores(spark, d):
    return _golden(spark, d)[2]


# the entity, from the lists' order: the first struct of the first file that has one
_ENTITY = f"""ent AS (SELECT repo_id, module, any_value(entity) FILTER (k = 1) AS entity FROM (
    SELECT m.repo_id, m.module, s.name AS entity, row_number() OVER (PARTITION BY m.repo_id, m.module ORDER BY s.name IS NULL, m.path, s.pos) AS k FROM m LEFT JOIN e s ON s.repo_id = m.repo_id AND s.path = m.path AND s.kind = 'struct'
      AND m.path LIKE m.module_path || '/domain/%' AND NOT m.path LIKE '%#_test.go' ESCAPE '#' AND NOT regexp_extract(m.path, '[^/]*$') LIKE '%error%') GROUP BY 1, 2)"""
_SNAKE = "lower(regexp_replace(substr({0}, 1, 1) || regexp_replace(substr({0}, 2), '([A-Z])', '_\\1', 'g'), '^_', ''))"
_PASCAL = "(upper(substr({0}, 1, 1)) || substr({0}, 2))"
_TYPE = f"""CASE WHEN path LIKE '%/domain/%' AND path LIKE '%#_test.go' ESCAPE '#' THEN 'domain_test' WHEN path LIKE '%/domain/%' AND {_BASE} LIKE '%error%' THEN 'domain_errors' WHEN path LIKE '%/domain/%' THEN 'domain_entity'
  WHEN path LIKE '%/application/%' AND {_BASE} LIKE '%service%' THEN 'service' WHEN path LIKE '%/application/%' AND {_BASE} LIKE '%port%' THEN 'ports' WHEN path LIKE '%/adapters/http/%' AND {_BASE} LIKE '%handler%' THEN 'handler'
  WHEN path LIKE '%/adapters/http/%' AND {_BASE} LIKE '%route%' THEN 'routes' WHEN path LIKE '%/adapters/repository/%' THEN 'repository' ELSE 'unknown' END"""
_BLUE = f"""{_ENTITY}, own AS (SELECT m.*, entity, {_SNAKE.format('entity')} AS es, lower(m.module) AS ms FROM m JOIN gold USING (repo_id, module) JOIN ent USING (repo_id, module) WHERE golden),
  rel AS (SELECT *, CASE WHEN starts_with(path, module_path || '/') THEN substr(path, length(module_path) + 2) ELSE path END AS r FROM own WHERE entity IS NOT NULL),
  stem AS (SELECT *, regexp_extract(r, '^(.*/)?', 0) AS dir, regexp_replace(regexp_extract(r, '[^/]*$'), '(_test)?\\.go$', '') AS st, CASE WHEN r LIKE '%#_test.go' ESCAPE '#' THEN '_test.go' ELSE '.go' END AS fin FROM rel),
  bf AS (SELECT repo_id, module AS golden, path AS file, dir || CASE WHEN es <> ms THEN replace(replace(st, es, '{{entity}}'), ms, '{{module}}') ELSE replace(st, es, '{{entity}}') END || fin AS template, {_TYPE} AS type, entity FROM stem),
  bn AS (SELECT e.repo_id, e.path AS file, kind, pos, CASE WHEN contains(name, entity) THEN replace(name, entity, '{{Entity}}') ELSE replace(name, {_PASCAL.format('module')}, '{{Entity}}') END AS template FROM e JOIN rel ON rel.repo_id = e.repo_id AND rel.path = e.path)"""


def _blueprint(spark, d):
    files, members, scores = _golden(spark, d)
    return files, members, B.blueprints(members, files, scores.where("golden"))


@query(
    "q70_blueprints",
    f"""{_MEMBERS}, {_GOLDEN}, {_BLUE} SELECT repo_id, golden, file, template, type, entity, NULL AS error FROM bf
        UNION ALL SELECT DISTINCT repo_id, module, NULL, NULL, NULL, NULL, 'could not detect entity name for module ' || module FROM own WHERE entity IS NULL""",
)
def blueprint_files(spark, d):
    """Files of each repository's blueprint, or why there is none."""
    wanted, _, errors = _blueprint(spark, d)[2]
    return wanted.withColumn("error", F.lit(None).cast("string")).unionByName(errors.withColumnRenamed("module", "golden"), allowMissingColumns=True)


@query("q71_blueprint_names", f"{_MEMBERS}, {_GOLDEN}, {_BLUE} SELECT repo_id, file, kind, template, count(*) AS n FROM bn GROUP BY ALL")
def blueprint_names(spark, d):
    return _blueprint(spark, d)[2][1].groupBy("repo_id", "file", "kind", "template").agg(F.count("*").alias("n"))


_CHECK = f"""{_BLUE}, tgt AS (SELECT repo_id, module, coalesce(entity, '') AS entity, {_SNAKE.format("coalesce(entity, '')")} AS es, lower(module) AS ms, {_PASCAL.format('module')} AS mp, golden AS gm FROM ent JOIN (SELECT DISTINCT repo_id, golden FROM bf) x USING (repo_id) WHERE module <> golden),
  pr AS (SELECT tgt.*, bf.file, bf.type, replace(replace(bf.template, '{{entity}}', es), '{{module}}', ms) AS c1, replace(replace(bf.template, '{{entity}}', es), '{{module}}', es) AS c2 FROM tgt JOIN bf USING (repo_id)),
  th AS (SELECT repo_id, module, substr(path, length(module_path) + 2) AS r, path FROM m WHERE starts_with(path, module_path || '/')),
  mt AS (SELECT pr.*, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL AND b.path IS NOT NULL THEN c2 ELSE c1 END AS shown FROM pr LEFT JOIN th a ON a.repo_id = pr.repo_id AND a.module = pr.module AND a.r = c1 LEFT JOIN th b ON b.repo_id = pr.repo_id AND b.module = pr.module AND b.r = c2),
  nm AS (SELECT mt.repo_id, mt.module, mt.gm, mt.file AS at_file, mt.shown, mt.path, bn.kind, bn.template, replace(bn.template, '{{Entity}}', entity) AS n1, replace(bn.template, '{{Entity}}', mp) AS n2 FROM mt JOIN bn ON bn.repo_id = mt.repo_id AND bn.file = mt.file),
  miss AS (SELECT repo_id, module, 'file' AS kind, c1 AS name, type AS expected, c1 AS file, NULL AS matched FROM mt WHERE path IS NULL
    UNION ALL SELECT repo_id, module, kind, n1, template, shown, path FROM nm WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo_id = nm.repo_id AND e.path = nm.path AND e.kind = nm.kind AND e.name IN (nm.n1, nm.n2))
    UNION ALL SELECT v.repo_id, v.module, 'pattern', p.name, p.expected, NULL, NULL FROM v JOIN tgt USING (repo_id, module), LATERAL (SELECT 'Validate' AS name, 'method' AS expected WHERE NOT val
      UNION ALL SELECT 'New{{Entity}}', 'function' WHERE NOT con UNION ALL SELECT 'port interfaces', 'interface' WHERE NOT ifc) p)"""


def _checked(spark, d):
    files, members, (wanted, names, _) = _blueprint(spark, d)
    return B.check(members, files, (wanted, names))


@query(
    "q72_missing_things",
    f"{_MEMBERS}, {_GOLDEN}, {_CHECK} SELECT repo_id, module, kind, name, expected, file, count(*) AS n FROM miss GROUP BY ALL",
)
def missing_things(spark, d):
    return _checked(spark, d)[0].groupBy("repo_id", "module", "kind", "name", "expected", "file").agg(F.count("*").alias("n"))


@query(
    "q73_check_issues",
    f"""{_MEMBERS}, {_GOLDEN}, {_CHECK} SELECT repo_id, module, CASE WHEN kind = 'file' THEN 'error' ELSE 'warning' END AS severity, CASE WHEN kind = 'pattern' THEN 'pattern' ELSE 'completeness' END AS category, matched AS file,
        CASE WHEN kind = 'file' THEN 'missing ' || expected || ' file: ' || name WHEN name = 'Validate' AND kind = 'pattern' THEN 'missing Validate() method on domain entity' WHEN name = 'New{{Entity}}' AND kind = 'pattern' THEN 'missing constructor function (New...)'
          WHEN kind = 'pattern' THEN 'no interfaces defined (expected port interfaces)' ELSE 'missing ' || kind || ' ' || name || ' (expected from blueprint pattern ' || expected || ')' END AS message,
        CASE WHEN kind <> 'pattern' THEN NULL WHEN name = 'Validate' THEN 'validate_method' WHEN name = 'New{{Entity}}' THEN 'constructor' ELSE 'port_interfaces' END AS pattern
        FROM miss WHERE kind IN ('file', 'pattern') OR matched IS NOT NULL""".replace("{{Entity}}", "{Entity}"),
)
def check_issues(spark, d):
    return _checked(spark, d)[1].drop("at_file", "at")


@query(
    "q74_module_check",
    f"""{_MEMBERS}, {_GOLDEN}, {_CHECK}, k AS (SELECT repo_id, module, count_if(kind = 'file') AS files, count_if(kind = 'struct') AS structs, count_if(kind IN ('function', 'method')) AS methods, count_if(kind = 'interface') AS interfaces, count_if(kind = 'pattern') AS patterns FROM miss GROUP BY 1, 2)
        SELECT repo_id, module, gm AS golden, greatest(0, 100 - 10 * coalesce(files, 0) - 5 * (coalesce(structs, 0) + coalesce(methods, 0) + coalesce(interfaces, 0)) - 3 * coalesce(patterns, 0))::BIGINT AS score, coalesce(files, 0) AS files, coalesce(structs, 0) AS structs,
          coalesce(methods, 0) AS methods, coalesce(interfaces, 0) AS interfaces, coalesce(patterns, 0) AS patterns FROM tgt LEFT JOIN k USING (repo_id, module)""",
)
def module_check(spark, d):
    """Every module but the golden one, checked."""
    return _checked(spark, d)[2]


_METHODS = 25
_PORTS = f"""SELECT n_nationkey AS k, concat('N', n_nationkey) AS interface, concat('ports/n', n_nationkey, '.go') AS path, CASE n_nationkey % 6 WHEN 0 THEN 'economy' WHEN 1 THEN 'promo' WHEN 2 THEN 'standard' ELSE 'ports' END AS package,
  concat('M', (n_nationkey + i * (3 + n_nationkey % 5)) % {_METHODS}) AS method FROM nation, {{sizes}} WHERE i <= 1 + n_nationkey % 4"""
_RECEIVERS = f"SELECT DISTINCT lower(p_type) AS package, concat('types/', lower(p_type), '.go') AS file, replace(p_brand, '#', '') AS receiver, concat('M', p_size % {_METHODS}) AS method FROM part"


@query(
    "q75_implementations",
    f"""WITH w AS ({_PORTS.format(sizes='range(0, 5) t(i)')}), h AS ({_RECEIVERS}), n AS (SELECT k, count(*) AS n FROM w GROUP BY 1)
        SELECT 'all' AS repo_id, w.interface, w.path AS defined, receiver AS implementation, file, h.package, n FROM w JOIN h ON h.method = w.method AND h.package <> w.package JOIN n USING (k)
        GROUP BY ALL HAVING count(*) = n""",
)
def implementations(spark, d):
    """Nations as interfaces of two to five methods, brands as receivers, one file a type: which have all methods, outside of the interface's package."""
    nation, part = table(spark, d, "nation"), table(spark, d, "part")
    wanted = spark.sql(f"SELECT 'all' AS repo_id, path, package, 0 AS at, interface, method FROM ({_PORTS.format(sizes='explode(sequence(0, 4)) t(i)').replace('FROM nation, explode', 'FROM {nation} LATERAL VIEW explode').replace('t(i)', 't AS i')})", nation=nation)
    have = spark.sql(f"SELECT 'all' AS repo_id, file AS path, package, receiver, method FROM ({_RECEIVERS.replace('FROM part', 'FROM {part}')})", part=part)
    sizes = wanted.groupBy("interface").agg(F.count("*").alias("n"))
    return B.implementations(wanted, have).join(sizes, "interface").select("repo_id", "interface", "defined", "implementation", "file", "package", "n")
