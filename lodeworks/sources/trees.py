"""Sources and sinks of source trees: pruned scans, root markers, score documents, histories and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that hold no source of a project's own.
SKIPPED = "vendor node_modules .git .worktrees dist bin testdata examples example demos demo benchmarks".split()
# Documents for agents, at the root of a tree.
AGENT_DOCS = {"CLAUDE.md": "claude", "AGENTS.md": "agents", ".cursorrules": "cursor"}
#: Bytes of a document that are kept.
KEPT = 16384


def read_trees(spark: SparkSession, root: str) -> DataFrame:
    """Rows (repo_id, path, content) of root/<repo_id>/...; content is only read if it is used.

    Spark's readers leave out empty files and those whose names begin with a dot or underscore; trees that need them come as a table of
    the same columns.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    under = F.regexp_replace(F.substring(F.regexp_replace("path", "^(file):/+", "$1:/"), len(whole.replace("file:///", "file:/")) + 2, 1 << 20), "^/+", "")
    return raw.select(F.substring_index(under, "/", 1).alias("repo_id"), F.regexp_replace(under, "^[^/]*/", "").alias("path"), "content")


def pruned(tree: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    """tree without files below skipped, excluded, underscore or worktree folders; a predicate on path alone."""
    names = [*SKIPPED, *(x.rstrip("/") for x in excludes)]
    folders = F.expr("slice(split(path, '/'), 1, size(split(path, '/')) - 1)")
    gone = F.exists(folders, lambda d: d.isin(names) | (F.startswith(d, F.lit("_")) & (d != "_internal")))
    return tree.where(~gone & ~F.col("path").rlike(r"^\.claude/(.*/)?worktrees/"))


def module_path(content: Column) -> Column:
    """The first trimmed line's name that begins with ``module ``; empty if there is none."""
    return F.trim(F.regexp_extract(F.decode(content, "UTF-8"), r"(?m)^[ \t]*module ([^\r\n]*)", 1))


def trees(tree: DataFrame) -> DataFrame:
    """A row a repository: markers at the root, sizes and capped contents of its documents. One partial aggregation."""
    path, low = F.col("path"), F.lower("path")
    first = lambda cond, v: F.max(F.when(cond, v))  # noqa: E731  at most one file has the path
    size = F.length("content").cast("long")
    marks = [F.bool_or(path == name).alias(f"has_{kind}") for name, kind in AGENT_DOCS.items()]
    sizes = [F.coalesce(first(path == name, F.least(size, F.lit(KEPT))), F.lit(0)).alias(f"{kind}_size") for name, kind in AGENT_DOCS.items()]
    return tree.groupBy("repo_id").agg(
        F.bool_or(path == "go.mod").alias("has_go_mod"), F.coalesce(first(path == "go.mod", module_path(F.col("content"))), F.lit("")).alias("module_path"),
        F.coalesce(F.min(F.when(low == "readme.md", F.struct("path", F.least(size, F.lit(KEPT)).alias("n"))))["n"], F.lit(0)).alias("readme_size"),
        F.bool_or(F.startswith(path, F.lit(".github/"))).alias("has_ci_config"),
        F.coalesce(first(path == "CLAUDE.md", F.decode(F.substring("content", 1, KEPT), "UTF-8")), F.lit("")).alias("agent_doc"),
        F.coalesce(first(path == "go.mod", F.sha2("content", 256)), F.lit("")).alias("module_hash"), *marks, *sizes,
    )


def score_documents(metrics: DataFrame, categories: DataFrame, overall: DataFrame) -> DataFrame:
    """Rows (repo_id, json): scores nested by category. A repository has some 25 sub-metrics, so its lists are bounded."""
    subs = metrics.groupBy("repo_id", "category").agg(F.sort_array(F.collect_list(F.struct("name", "score", "points"))).alias("sub_metrics"))
    cats = categories.join(subs, ["repo_id", "category"]).groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct(F.col("category").alias("name"), "score", "sub_metrics"))).alias("categories"))
    return overall.join(cats, "repo_id").select("repo_id", F.to_json(F.struct("repo_id", "overall", "grade", "categories")).alias("json"))


def append_history(overall: DataFrame, path: str, commit: Column, at: Column) -> None:
    """Add a row a repository to the history at path (JSON lines)."""
    overall.select("repo_id", at.alias("timestamp"), commit.alias("commit_hash"), "overall", "grade").write.mode("append").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """The history with the change of each row from the one before it in its repository."""
    rows = spark.read.schema("repo_id string, timestamp timestamp, commit_hash string, overall long, grade string").json(path)
    w = Window.partitionBy("repo_id").orderBy("timestamp", "commit_hash")
    return rows.withColumn("delta", F.col("overall") - F.lag("overall").over(w))


def save_snapshot(files: DataFrame, path: str, version: str) -> None:
    """Write files as the snapshot ``version`` (a hash of what it depends on) beside other versions."""
    files.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def load_snapshot(spark: SparkSession, path: str, version: str, schema: str) -> DataFrame:
    """The snapshot of that version; no rows if it was never written, as when a configuration has changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={version}")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(at.toString()) if there else spark.createDataFrame([], schema)


def check_documents(missing: DataFrame, issues: DataFrame, report: DataFrame) -> DataFrame:
    """Rows (repo_id, module, json) of blueprints.check: score, missing things and issues. What a module lacks is bounded by its blueprint."""
    key = ["repo_id", "module"]
    lack = missing.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("kind", "name", "expected", "file"))).alias("missing"))
    told = issues.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("severity", "category", "file", "message", "pattern"))).alias("issues"))
    rows = report.join(lack, key, "left").join(told, key, "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select(*key, F.to_json(F.struct("module", F.col("golden").alias("golden_module"), "score", none("missing"), none("issues"))).alias("json"))


def graph_documents(nodes: DataFrame, report: DataFrame, cycles: DataFrame) -> DataFrame:
    """JSON lines (repo_id, package, json): one a package of packages.graph_report, with its measures, and one a cycle, whose package is null.

    A line a package, and not one document a repository, so that a large repository is no single row.
    """
    key = ["repo_id", "package"]
    rows = report.join(nodes.select(*key, "instability", "abstractness", "distance"), key)
    packages = rows.select(*key, F.to_json(F.struct("package", "role", "ca", "ce", "instability", "abstractness", "distance", "n_violations")).alias("json"))
    rings = cycles.select("repo_id", F.lit(None).cast("string").alias("package"), F.to_json(F.struct("cycle")).alias("json"))
    return packages.unionByName(rings)
