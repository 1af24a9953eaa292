"""Modules of repositories, detected from paths alone: which layout a repository has, and each file's module and layer.

Everything is a row a file (repo_id, module, layer, path): a module of any size is never one row. The layout is an aggregate
over a repository's distinct folders below ``internal``; its rows, one a repository, are joined back by repo_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import facts as T

# Folders below ``internal`` that are layers, and which layer each is.
TOP_LAYERS = {
    "domain": "domain", "application": "application", "app": "application", "core": "application", "adapters": "adapters",
    "adapter": "adapters", "infrastructure": "adapters", "infra": "adapters", "ports": "domain",
}
# Folders below a module that are layers.
NESTED_LAYERS = {
    "adapters/http": "adapters", "adapters/repository": "adapters", "adapters/grpc": "adapters", "adapters/inbound": "adapters",
    "adapters/outbound": "adapters", "application": "application", "domain": "domain",
}
PER_FEATURE, CROSS_CUTTING = "per-feature", "cross-cutting"
#: Share of layers among the folders below ``internal`` from which a layout is cross-cutting.
SHARE = 0.5


def _below(path: Column) -> Column:
    """Segments of path after the first ``internal``; null if there is none or nothing follows it."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "internal").cast("int")
    return F.when((at > 0) & (at < F.size(parts)), F.slice(parts, at + 1, F.size(parts)))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(key == a, F.lit(b)) for a, b in table.items()])


def layouts(paths: DataFrame) -> DataFrame:
    """Rows (repo_id, layout), one a repository of paths (repo_id, path); only distinct folders are counted."""
    top = paths.select("repo_id", F.get(_below(F.col("path")), F.lit(0)).alias("top")).distinct()
    share = F.try_divide(F.count_if(_lookup(F.col("top"), TOP_LAYERS).isNotNull()), F.count("top"))
    return top.groupBy("repo_id").agg(F.when(share >= SHARE, CROSS_CUTTING).otherwise(PER_FEATURE).alias("layout"))


def _per_feature(below: Column) -> tuple[Column, Column]:
    """(module, layer) of a path below ``internal/{module}``."""
    rest = F.array_join(F.slice(below, 2, F.size(below)), "/")
    hits = [F.when(F.startswith(rest, F.lit(f"{p}/")) | (rest == p), F.lit(layer)) for p, layer in NESTED_LAYERS.items()]
    layer = F.coalesce(*hits)
    return F.when(F.size(below) > 1, below[0]), layer


def _cross_cutting(below: Column) -> tuple[Column, Column]:
    """(module, layer) of a path below ``internal/{layer}``: the folder below the layer, or below its direction; else the layer."""
    n, inner = F.size(below), F.get(below, F.lit(1))
    directed = below[0].isin("adapters", "adapter") & (n > 3) & inner.isin("inbound", "outbound")
    module = F.when(n <= 2, below[0]).when(directed, F.get(below, F.lit(2))).otherwise(inner)
    layer = _lookup(below[0], TOP_LAYERS)
    return F.when(layer.isNotNull(), module), layer


def module_files(paths: DataFrame) -> DataFrame:
    """Rows (repo_id, layout, module, module_path, layer, path): the source files that belong to a module; layer may be null."""
    own = paths.where(F.endswith("path", F.lit(".go"))).select("repo_id", "path").distinct()
    own = own.join(layouts(own), "repo_id").withColumn("_below", _below(F.col("path")))
    a, b = _per_feature(F.col("_below")), _cross_cutting(F.col("_below"))
    pick = lambda i: F.when(F.col("layout") == CROSS_CUTTING, b[i]).otherwise(a[i])
    rows = own.select("repo_id", "layout", pick(0).alias("module"), pick(1).alias("layer"), "path").where("module IS NOT NULL")
    return rows.select("repo_id", "layout", "module", F.concat(F.lit("internal/"), "module").alias("module_path"), "layer", "path")


def modules(members: DataFrame) -> DataFrame:
    """Rows (repo_id, module, module_path, layers, n_files, n_tests), one a module of module_files; layers in order."""
    test = T.is_test(F.col("path"))
    return members.groupBy("repo_id", "module", "module_path").agg(
        F.sort_array(F.collect_set("layer")).alias("layers"), F.count("*").alias("n_files"), F.count_if(test).alias("n_tests")  # at most three layers
    )


def walk_order(path: Column) -> Column:
    """What orders paths as a walk of folders does: segment by segment."""
    return F.split(path, "/")


def architecture(members: DataFrame) -> DataFrame:
    """Rows (repo_id, style): hexagonal with all three layers, layered with domain or application, else flat."""
    has = {x: F.bool_or(F.coalesce(F.col("layer") == x, F.lit(False))) for x in ("domain", "application", "adapters")}
    every = reduce(lambda a, b: a & b, has.values())
    return members.groupBy("repo_id").agg(F.when(every, "hexagonal").when(has["domain"] | has["application"], "layered").otherwise("flat").alias("style"))


def dependency_rules(members: DataFrame) -> DataFrame:
    """Rows (repo_id, source, forbids, reason): for each two layers of a repository, the inner one must not depend on the outer."""
    # The rules and their reasons.
    rules = (
        ("domain", "application", "domain layer must not depend on application layer"),
        ("domain", "adapters", "domain layer must not depend on adapter layer"),
        ("application", "adapters", "application layer must not depend on adapter layer"),
    )
    have = members.groupBy("repo_id").agg(F.collect_set("layer").alias("have"))  # at most three
    each = [F.when(F.array_contains("have", a) & F.array_contains("have", b), F.struct(F.lit(a).alias("source"), F.lit(b).alias("forbids"), F.lit(why).alias("reason"))) for a, b, why in rules]
    return have.select("repo_id", F.explode(F.array_compact(F.array(*each))).alias("r")).select("repo_id", "r.*")
