"""Facts about source trees as tables: their schemas, and views of the nested ``files`` table at other grains.

``files`` has a row a source file with its functions nested; ``paths`` a row for every file of a tree; ``trees`` a row a
repository; ``modules`` a row a module. All carry repo_id, so that many repositories are scored by one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTION = (
    "struct<name:string,receiver:string,exported:boolean,line_start:int,line_end:int,params:array<struct<name:string,type:string>>,"
    "returns:array<string>,max_nesting:int,max_cond_ops:int,cognitive_complexity:int,string_literal_ratio:double,max_case_arms:int,avg_case_lines:double>"
)
FILES = (
    "repo_id string, path string, package string, package_doc boolean, init_functions int, total_lines int, is_generated boolean, has_cgo boolean, "
    "structs array<string>, interfaces array<string>, interface_defs array<struct<name:string,methods:array<string>>>, imports array<string>, "
    "global_vars array<string>, error_calls array<struct<has_wrap:boolean,has_context:boolean>>, type_assertions array<struct<safe:boolean>>, "
    f"functions array<{FUNCTION}>"
)
PATHS = "repo_id string, path string"
TREES = "repo_id string, readme_size long, has_ci_config boolean, agent_doc string"
MODULES = "repo_id string, name string, layers array<string>, n_files long"
ISSUES = "repo_id string, severity string, category string, sub_metric string, file string, line int, message string, pattern string"


def is_test(path: Column) -> Column:
    return F.endswith(path, F.lit("_test.go"))


def functions(files: DataFrame) -> DataFrame:
    """A row a function, with what its file adds: columns ``fn``, ``test``, ``lines`` and the file's own flags."""
    fn = files.select("repo_id", "path", "package", "is_generated", "has_cgo", F.explode("functions").alias("fn"))
    return fn.withColumn("test", is_test(F.col("path"))).withColumn("lines", F.expr("fn.line_end - fn.line_start + 1"))


def role_suffix(path: Column) -> Column:
    """The last _part of the file name without its ending; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.go$", ""), "_[^_]*$", 0)
    return F.nullif(found, F.lit(""))
