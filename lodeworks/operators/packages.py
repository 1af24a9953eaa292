"""Package graphs of repositories from facts: nodes and edges, roles, cycles, violations, coupling and a score.

All repositories are worked on by one plan: a node is (repo_id, package), so that every step is a join or an aggregation on
it, and a large repository is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import scoring as S
from lodeworks.operators import facts as T
from lodeworks.operators import relational as R

# Folder names that tell a role, with its confidence.
ROLE_HINTS = {
    ("core", 0.85): "domain model models entity entities", ("core", 0.80): "types core", ("core", 0.75): "schema",
    ("orchestrator", 0.80): "application usecase usecases interactor", ("orchestrator", 0.75): "service services", ("orchestrator", 0.70): "app",
    ("adapter", 0.85): "adapter adapters grpc graphql infra infrastructure", ("adapter", 0.75): "middleware server client store", ("adapter", 0.70): "api",
    ("adapter", 0.80): "handler handlers controller controllers repository repositories gateway cache queue transport delivery driver drivers",
    ("ports", 0.90): "ports port", ("entry_point", 0.95): "cmd",
}
# Imports and parameter types that tell input and output.
IO_IMPORTS = "net net/http net/rpc net/smtp os database/sql encoding/json encoding/xml encoding/csv crypto/tls html/template text/template log log/slog".split()
IO_PREFIXES = (
    "github.com/lib/pq github.com/go-redis/ github.com/jackc/pgx github.com/go-sql-driver/ google.golang.org/grpc go.mongodb.org/ "
    "github.com/nats-io/ github.com/segmentio/kafka github.com/gin-gonic/ github.com/labstack/echo github.com/gorilla/ github.com/gofiber/"
).split()
IO_TYPES = (
    "http.Request http.ResponseWriter http.Handler http.HandlerFunc sql.DB sql.Tx sql.Conn sql.Row sql.Rows "
    "io.Reader io.Writer io.ReadCloser io.WriteCloser io.ReadWriter net.Conn net.Listener"
).split()
ADAPTER_FOLDERS = "adapters adapter infra infrastructure".split()
# The least confidence of a role; weights and limits of the graph's score.
SURE, CYCLE_WEIGHT, DISTANCE_SHARE, MAX_DISTANCE, OUTLIER_TIMES = 0.70, 0.40, 0.60, 0.40, 2.0
NODE = ["repo_id", "package"]


def io_import(name: Column) -> Column:
    exact = [(name == x) | F.startswith(name, F.lit(f"{x}/")) for x in IO_IMPORTS]
    return reduce(lambda a, b: a | b, [*exact, *(F.startswith(name, F.lit(x)) for x in IO_PREFIXES)])


def io_type(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(x)) for x in IO_TYPES])


def package_graph(files: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, package, folder, interfaces, structs, io, io_params, has_main) and edges (repo_id, src, dst).

    A node is a folder with a source file that is neither test nor generated, or one that is only imported.
    """
    own = files.where("NOT coalesce(is_generated, false)").where(~T.is_test(F.col("path")))
    own = own.join(trees.select("repo_id", "module_path").where("module_path <> ''"), "repo_id")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = own.withColumn("_folder", folder).withColumn("_pkg", F.when(F.col("_folder") == "", F.col("module_path")).otherwise(F.concat_ws("/", "module_path", "_folder")))
    inside = lambda x: (x == F.col("module_path")) | F.startswith(x, F.concat("module_path", F.lit("/")))
    imports, fns = F.coalesce("imports", F.array()), F.coalesce("functions", F.array())
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    mains = F.exists(fns, lambda f: (f["name"] == "main") & (F.coalesce(f["receiver"], F.lit("")) == ""))
    nodes = own.groupBy("repo_id", F.col("_pkg").alias("package")).agg(
        F.first("_folder").alias("folder"), F.sum(F.greatest(size("interfaces"), F.lit(0))).alias("interfaces"), F.sum(F.greatest(size("structs"), F.lit(0))).alias("structs"),
        F.bool_or(F.exists(imports, lambda x: ~inside(x) & io_import(x))).alias("io"),
        F.bool_or(F.exists(fns, lambda f: F.exists(F.coalesce(f["params"], F.array()), lambda p: io_type(p["type"])))).alias("io_params"), F.bool_or(mains).alias("has_main"),
    )
    edges = own.select("repo_id", F.col("_pkg").alias("src"), "module_path", F.explode(imports).alias("dst")).where(inside(F.col("dst")) & (F.col("dst") != F.col("src")))
    edges = edges.select("repo_id", "src", "dst").distinct()
    stub = edges.select("repo_id", F.col("dst").alias("package")).distinct().join(nodes.select(*NODE), NODE, "left_anti").join(trees.select("repo_id", "module_path"), "repo_id")
    below = F.substring("package", F.length("module_path") + 2, 1 << 20)
    stub = stub.select(*NODE, below.alias("folder"), F.lit(0).alias("interfaces"), F.lit(0).alias("structs"), *[F.lit(False).alias(c) for c in ("io", "io_params", "has_main")])
    return nodes.unionByName(stub), edges


def coupled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with ca, ce, instability, abstractness and distance."""
    end = lambda c, n: edges.groupBy("repo_id", F.col(c).alias("package")).agg(F.count("*").alias(n))
    out = nodes.join(end("dst", "ca"), NODE, "left").join(end("src", "ce"), NODE, "left").na.fill(0, ["ca", "ce"])
    i, a = S.instability(F.col("ca"), F.col("ce")), S.abstractness(F.col("interfaces"), F.col("structs"))
    return out.withColumn("instability", i).withColumn("abstractness", a).withColumn("distance", S.main_sequence_distance(a, i))


def role_hint(folder: Column) -> Column:
    """(role, conf) of the deepest folder that has a hint, else null."""
    hints = F.create_map(*[x for (role, conf), names in ROLE_HINTS.items() for n in names.split() for x in (F.lit(n), F.struct(F.lit(role).alias("role"), F.lit(conf).alias("conf")))])
    return F.get(F.array_compact(F.transform(F.reverse(F.split(folder, "/")), lambda x: F.try_element_at(hints, x))), 0)


def package_roles(nodes: DataFrame) -> DataFrame:
    """Rows (repo_id, package, role, confidence) of coupled nodes; role is null where no signal is sure enough.

    Folders named for commands or ports, and the root, have their role by rule. Else names, imports and contents vote.
    """
    path, types = F.concat(F.lit("/"), "folder", F.lit("/")), F.col("interfaces") + F.col("structs")
    vote = lambda role, conf: F.struct(F.lit(role).alias("role"), F.lit(conf).alias("conf"))
    last = F.element_at(F.split("folder", "/"), -1)
    by_name = F.when(last == "main", vote("entry_point", 0.95)).otherwise(role_hint(F.col("folder")))
    by_import = (
        F.when(F.col("io"), vote("adapter", 0.70)).when((F.col("interfaces") > 0) & (F.col("ce") == 0), vote("core", 0.65)).when(F.col("interfaces") > 0, vote("core", 0.55))
        .when(~F.col("io_params") & (types > 0) & (F.col("ca") > 0), vote("core", 0.55))
    )
    by_content = (
        F.when(F.col("has_main"), vote("entry_point", 0.95)).when(F.col("io_params"), vote("adapter", 0.75)).when(2 * F.col("interfaces") > types, vote("ports", 0.70))
        .when((F.col("ca") >= 2) & (types > 0) & ~F.col("io"), vote("core", 0.60))
    )
    ruled = F.when(F.contains(path, F.lit("/cmd/")) | (F.col("folder") == ""), vote("entry_point", 0.95)).when(F.contains(path, F.lit("/ports/")), vote("ports", 0.90))
    known = nodes.select(*NODE, ruled.alias("rule"), F.array_compact(F.array(by_name, by_import, by_content)).alias("votes"))
    fused = R.fuse_votes(known.where("rule IS NULL").select(*NODE, F.explode("votes").alias("v")).select(*NODE, "v.role", "v.conf"), NODE).drop("votes")
    sure = known.where("rule IS NULL").select(*NODE).join(fused, NODE, "left").select(*NODE, F.when(F.col("confidence") >= SURE, F.col("role")).alias("role"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return sure.union(known.where("rule IS NOT NULL").select(*NODE, "rule.role", F.col("rule.conf").alias("confidence")))


def _from_adapter(folder: Column) -> Column:
    """The folder's segments from the first that is named for adapters; empty if there is none."""
    parts = F.split(folder, "/")
    at = F.array_position(F.transform(parts, lambda x: x.isin(ADAPTER_FOLDERS)), True)
    return F.when(at > 0, F.slice(parts, at.cast("int"), F.size(parts))).otherwise(F.array().cast("array<string>"))


def adapter_direction(folder: Column) -> Column:
    """inbound or outbound, if that follows the folder of adapters; else empty."""
    second = F.get(_from_adapter(folder), 1)
    return F.when(second.isin("inbound", "outbound"), second).otherwise(F.lit(""))


def adapter_subtree(folder: Column) -> Column:
    """The folder up to two segments below the one of adapters; all of it if there is none."""
    tail = _from_adapter(folder)
    parts = F.split(folder, "/")
    cut = F.slice(parts, 1, F.size(parts) - F.size(tail) + F.least(F.size(tail), F.lit(3)))
    return F.when(F.size(tail) == 0, folder).otherwise(F.array_join(cut, "/"))


def below_root(folder: Column, roots: tuple[str, ...]) -> Column:
    """Whether folder is one of roots or lies below one."""
    return reduce(lambda a, b: a | b, [(folder == r) | F.startswith(folder, F.lit(f"{r}/")) for r in roots], F.lit(False))


def package_violations(nodes: DataFrame, edges: DataFrame, roles: DataFrame, on_cycle: DataFrame, composition_roots: tuple[str, ...] = ()) -> DataFrame:
    """Rows (repo_id, package, message): edges that break the direction of roles, and packages on a cycle (repo_id, package)."""
    known = roles.join(nodes.select(*NODE, "folder"), NODE)
    side = lambda a, p: known.select("repo_id", F.col("package").alias(a), F.col("role").alias(f"{p}role"), F.col("folder").alias(f"{p}folder"))
    e = edges.join(side("src", "s"), ["repo_id", "src"]).join(side("dst", "d"), ["repo_id", "dst"])
    s, d = F.col("sfolder"), F.col("dfolder")
    inner = F.when(F.col("drole") == "adapter", "imports adapter").when(F.col("drole") == "orchestrator", "imports application")
    apart = (adapter_subtree(s) != "") & (adapter_subtree(d) != "") & (adapter_subtree(s) != adapter_subtree(d))
    wired = (adapter_direction(s) == "inbound") & (adapter_direction(d) == "outbound") | below_root(s, composition_roots)
    message = (
        F.when(F.col("srole").isin("core", "ports"), inner).when((F.col("srole") == "orchestrator") & (F.col("drole") == "adapter"), F.lit("imports adapter"))
        .when((F.col("srole") == "adapter") & (F.col("drole") == "adapter") & apart & ~wired, F.concat(F.lit("imports "), F.element_at(F.split(d, "/"), -1)))
    )
    broken = e.select("repo_id", F.col("src").alias("package"), message.alias("message")).where("message IS NOT NULL")
    return broken.union(on_cycle.select(*NODE, F.lit("in import cycle").alias("message")))


def import_cycles(edges: DataFrame) -> DataFrame:
    """Rows (repo_id, cycle): one cycle a back edge of a depth-first search in the order of names, its least name first.

    Only edges between packages on a cycle are searched, a repository a task: its packages, not its files.
    """
    on = R.cycle_members(edges.select(F.struct("repo_id", F.col("src").alias("p")).alias("src"), F.struct("repo_id", F.col("dst").alias("p")).alias("dst"))).select("node.repo_id", F.col("node.p").alias("p"))
    left = edges.join(on.withColumnRenamed("p", "src"), ["repo_id", "src"], "left_semi").join(on.withColumnRenamed("p", "dst"), ["repo_id", "dst"], "left_semi")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        nexts = {k: sorted(v) for k, v in pdf.groupby("src")["dst"]}
        open_, done, found = {}, set(), {}
        for start in sorted(nexts):
            if start in done:
                continue
            path, turns = [start], [iter(nexts[start])]
            open_[start] = 0
            while path:
                v = next(turns[-1], None)
                if v is None:
                    done.add(path[-1])
                    del open_[path.pop()], turns[-1]
                elif v in open_:
                    c = path[open_[v] :]
                    k = c.index(min(c))
                    found[tuple(c[k:] + c[:k])] = None
                elif v not in done and v in nexts:
                    open_[v] = len(path)
                    path.append(v)
                    turns.append(iter(nexts[v]))
        return pd.DataFrame({"repo_id": pdf["repo_id"].iloc[0], "cycle": [list(c) for c in found]})

    return left.groupBy("repo_id").applyInPandas(search, "repo_id string, cycle array<string>")


def coupling_outliers(nodes: DataFrame, times: float = OUTLIER_TIMES) -> DataFrame:
    """Rows (repo_id, package, ce, median): packages that import over ``times`` the median of their repository."""
    m = R.median(nodes, ["repo_id"], "ce", "median").where("median >= 1")
    return nodes.select(*NODE, "ce").join(m, "repo_id").where(F.col("ce") > F.lit(times) * F.col("median"))


def graph_score(nodes: DataFrame, on_cycle: DataFrame) -> DataFrame:
    """Rows (repo_id, packages, score) from coupled nodes: cycles, distance from the main sequence and outliers; 1 up to one package."""
    typed = F.when(F.col("interfaces") + F.col("structs") > 0, F.col("distance"))
    one = nodes.groupBy("repo_id").agg(F.count("*").alias("packages"), F.coalesce(F.avg(typed), F.lit(0.0)).alias("mean"))
    one = one.join(on_cycle.select("repo_id", F.lit(0.0).alias("whole")).distinct(), "repo_id", "left")
    one = one.join(coupling_outliers(nodes).groupBy("repo_id").agg(F.count("*").alias("out")), "repo_id", "left")
    far = F.when(F.col("mean") > MAX_DISTANCE, F.greatest(F.lit(0.0), 1 - (F.col("mean") - MAX_DISTANCE) / (2 * MAX_DISTANCE))).otherwise(1.0)
    rest = 1 - CYCLE_WEIGHT
    score = F.coalesce("whole", F.lit(1.0)) * CYCLE_WEIGHT + far * (rest * DISTANCE_SHARE) + (1 - F.coalesce("out", F.lit(0)) / F.col("packages")) * (rest * (1 - DISTANCE_SHARE))
    return one.select("repo_id", "packages", F.when(F.col("packages") <= 1, 1.0).otherwise(score).alias("score"))


def graph_report(nodes: DataFrame, roles: DataFrame, violations: DataFrame, top: int | None = None) -> DataFrame:
    """Rows (repo_id, place, package, role, ca, ce, n_violations): packages with violations first, then by ca and name; ``top`` a repository."""
    n = violations.groupBy(*NODE).agg(F.count("*").alias("n_violations"))
    rows = nodes.select(*NODE, "ca", "ce").join(roles.select(*NODE, "role"), NODE).join(n, NODE, "left").na.fill(0, ["n_violations"])
    order = Window.partitionBy("repo_id").orderBy((F.col("n_violations") > 0).desc(), F.desc("ca"), "package")
    out = rows.withColumn("place", F.row_number().over(order))
    return out if top is None else out.where(F.col("place") <= top)
