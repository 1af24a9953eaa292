"""Listing of source trees by tasks, level by level: hidden and empty files are seen, skipped folders are never entered.

Spark's own readers list all that lies below a path, and leave out empty files and names that begin with a dot or an
underscore. Here a level's folders are rows; tasks list them, files are kept and folders that are not skipped are the next
level. There are as many rounds as the tree is deep, and a round is as parallel as its folders are many.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import relational as R
from lodeworks.sources.trees import AGENT_DOCS, KEPT, SKIPPED

_ENTRY = "repo_id string, path string, folder boolean, size long"


def skipped(path: Column, excludes: tuple[str, ...] = ()) -> Column:
    """Whether a folder, named by its path in its repository, is not entered."""
    name = F.element_at(F.split(path, "/"), -1)
    own = name.isin(*SKIPPED, *(x.rstrip("/") for x in excludes)) | (F.startswith(name, F.lit("_")) & (name != "_internal"))
    return own | path.rlike(r"^\.claude/(.*/)?worktrees$")


def _list(root: str):
    def run(frames):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for pdf in frames:
            for repo, path in zip(pdf["repo_id"], pdf["path"]):
                at = "/".join(x for x in (base.rstrip("/"), repo, path) if x)
                rows = []
                for x in files.get_file_info(fs.FileSelector(at)):
                    below = f"{path}/{x.base_name}" if path else x.base_name
                    rows.append((repo, below, x.type == fs.FileType.Directory, 0 if x.size is None else x.size))
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["repo_id", "path", "folder", "size"])

    return run


def list_trees(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Rows (repo_id, path, size) of the files in root/<repo_id>/..., without those below skipped folders.

    root is a URI of a file system that pyarrow knows, which every executor can reach (as file:///shared, hdfs:// or s3://).
    """
    from pyarrow import fs

    root = root if "://" in root else f"file://{root}"
    files, base = fs.FileSystem.from_uri(root)
    repos = [(x.base_name, "") for x in files.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory]  # names of repositories
    level = spark.createDataFrame(repos, "repo_id string, path string")
    n, found = len(repos), []
    while n:
        width = min(n, 4 * spark.sparkContext.defaultParallelism)
        here = R.durable(level.repartition(width).mapInPandas(_list(root), _ENTRY))
        found.append(here.where("NOT folder").select("repo_id", "path", "size"))
        level = here.where("folder").where(~skipped(F.col("path"), excludes)).select("repo_id", "path")
        n = level.count()
    out = found[0] if found else spark.createDataFrame([], "repo_id string, path string, size long")
    for x in found[1:]:
        out = out.union(x)
    return out


def with_content(listed: DataFrame, root: str, wanted: Column, most: int | None = None) -> DataFrame:
    """listed with ``content`` of the files that ``wanted`` holds for, at most ``most`` bytes of each, else null; read by tasks."""
    root = root if "://" in root else f"file://{root}"

    def run(frames):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for pdf in frames:
            for i in range(len(pdf)):
                part = pdf.iloc[i : i + 1].copy()
                with files.open_input_stream(f"{base.rstrip('/')}/{part['repo_id'].iloc[0]}/{part['path'].iloc[0]}") as f:
                    part["content"] = [f.read() if most is None else f.read(most)]
                yield part

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema)
    read = listed.where(wanted).mapInPandas(run, f"{kind}, content binary")
    return read.unionByName(listed.where(~F.coalesce(wanted, F.lit(False))).withColumn("content", F.lit(None).cast("binary")))


def root_documents(path: Column) -> Column:
    """Whether a file is one whose content tells something of its tree."""
    return path.isin("go.mod", *AGENT_DOCS) | (F.lower(path) == "readme.md")


def marked_trees(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Of root: the listing, and trees.trees' row a repository, from the contents of a few documents of each."""
    from lodeworks.sources import trees

    listed = list_trees(spark, root, excludes)
    # module files are read whole; documents' sizes and texts are capped anyway
    return listed, trees.trees(with_content(listed, root, root_documents(F.col("path"))))


__all__ = ["KEPT", "list_trees", "marked_trees", "root_documents", "skipped", "with_content"]
