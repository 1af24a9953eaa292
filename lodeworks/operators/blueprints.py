"""Golden modules, blueprints taken from them, and checks of other modules against these.

A blueprint is two tables: a row a file (its path as a template, its type) and a row a required name (its kind and template).
A check joins the blueprint of a repository with its modules, writes every template out as at most two candidates and joins
these with what there is; "none of the candidates exists" is one left join and one aggregate, for files and names alike.
Modules, files and names are rows throughout, so that neither a large module nor a large repository is one task's work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import scoring as S
from lodeworks.operators import facts as T
from lodeworks.operators.modules import walk_order

# Weights of the golden score's terms, and what a check takes off for each missing thing.
GOLDEN = {"completeness": 0.30, "depth": 0.25, "tests": 0.20, "patterns": 0.15, "documents": 0.10}
MISSING = {"file": 10, "struct": 5, "method": 5, "interface": 5, "pattern": 3}
_MODULE = ["repo_id", "module"]


def elements(files: DataFrame) -> DataFrame:
    """Rows (repo_id, path, kind, name, at): structs, functions, methods and interfaces of files, in their order of writing."""
    fns = F.coalesce("functions", F.array().cast(files.schema["functions"].dataType))
    named = lambda col, kind: F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    written = F.transform(fns, lambda f: F.struct(F.when(f["receiver"] != "", "method").otherwise("function").alias("kind"), f["name"].alias("name")))
    every = F.concat(named("structs", "struct"), written, named("interfaces", "interface"))
    return files.select("repo_id", "path", F.posexplode(every).alias("at", "e")).select("repo_id", "path", "e.kind", "e.name", "at")


def patterns(members: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (repo_id, module, validate, constructor, interface): which patterns some file of a module shows."""
    own = members.join(names, ["repo_id", "path"], "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return own.groupBy(*_MODULE).agg(
        some((F.col("kind") == "method") & (F.col("name") == "Validate")).alias("validate"),
        some((F.col("kind") == "function") & F.startswith(F.col("name"), F.lit("New"))).alias("constructor"),
        some(F.col("kind") == "interface").alias("interface"),
    )


def golden_scores(members: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (repo_id, module, the five terms of GOLDEN, score, golden): the best module of a repository, by name among equals, is golden."""
    path, test = F.lower("path"), T.is_test(F.col("path"))
    wide = members.groupBy(*_MODULE).agg(
        F.count("*").alias("n"), F.count_distinct("layer").alias("layers"), F.count_if(test).alias("t"),
        F.bool_or(F.contains(path, F.lit("error")) & ~test).alias("errors"), F.bool_or(test).alias("tested"),
    ).join(patterns(members, names), _MODULE)
    share = lambda c, x: F.when(c, F.lit(x)).otherwise(0.0)
    most = F.max("n").over(Window.partitionBy("repo_id"))  # a row a module
    wide = wide.select(
        *_MODULE, (F.col("n") / most).alias("completeness"), F.least(F.col("layers") / 4, F.lit(1.0)).alias("depth"),
        F.coalesce(F.least(F.try_divide(F.col("t"), F.col("n") - F.col("t")), F.lit(1.0)), F.lit(0.0)).alias("tests"),
        (share(F.col("validate"), 0.4) + share(F.col("constructor"), 0.3) + share(F.col("interface"), 0.3)).alias("patterns"),
        (share(F.col("errors"), 0.5) + share(F.col("tested"), 0.5)).alias("documents"),
    )
    score = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in GOLDEN.items()])
    wide = wide.withColumn("score", F.round(score, 9))
    best = wide.groupBy("repo_id").agg(F.min_by("module", F.struct(-F.col("score"), F.col("module"))).alias("_best"))
    return wide.join(best, "repo_id").withColumn("golden", F.col("module") == F.col("_best")).drop("_best")


def entities(members: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (repo_id, module, entity): the first struct of the first file of a module's domain folder that has any; null without one.

    Tests, and files with ``error`` in their names, do not count. The first file is a minimum by place, not a sorted list.
    """
    base = F.element_at(F.split("path", "/"), -1)
    inner = F.startswith(F.col("path"), F.concat("module_path", F.lit("/domain/"))) & ~T.is_test(F.col("path")) & ~F.contains(base, F.lit("error"))
    first = files.where(F.size("structs") > 0).select("repo_id", "path", F.col("structs")[0].alias("_first"))
    # aggregates that see every file of a module, so that modules without an entity stay
    own = members.withColumn("_inner", inner).join(first, ["repo_id", "path"], "left")
    return own.groupBy(*_MODULE).agg(F.min_by("_first", F.when(F.col("_inner") & F.col("_first").isNotNull(), walk_order(F.col("path")))).alias("entity"))


def file_type(path: Column) -> Column:
    """What kind of file a path is, by the first rule that holds."""
    base, has = F.element_at(F.split(path, "/"), -1), lambda d: F.contains(path, F.lit(f"/{d}/"))
    says = lambda x: F.contains(base, F.lit(x))
    # The rules in order, and the types they give.
    rules = (
        (has("domain") & F.endswith(base, F.lit("_test.go")), "domain_test"), (has("domain") & says("error"), "domain_errors"), (has("domain"), "domain_entity"),
        (has("application") & says("service"), "service"), (has("application") & says("port"), "ports"), (has("adapters/http") & says("handler"), "handler"),
        (has("adapters/http") & says("route"), "routes"), (has("adapters/repository"), "repository"),
    )
    return F.coalesce(*[F.when(c, F.lit(t)) for c, t in rules], F.lit("unknown"))


def path_template(path: Column, module_path: Column, entity: Column, module: Column) -> Column:
    """path below its module, its file name with {entity} for the entity's snake name and then {module} for the module's."""
    rest = F.when(F.startswith(path, F.concat(module_path, F.lit("/"))), F.substr(path, F.length(module_path) + 2)).otherwise(path)
    folder, base = F.regexp_extract(rest, "^(.*/)?", 0), F.regexp_extract(rest, "[^/]*$", 0)
    ending = F.regexp_extract(base, r"(_test)?(\.go)?$", 0)
    stem = F.substr(base, F.lit(1), F.length(base) - F.length(ending))
    snake, low = S.snake_case(entity), F.lower(module)
    named = F.replace(stem, snake, F.lit("{entity}"))
    named = F.when(low != snake, F.replace(named, low, F.lit("{module}"))).otherwise(named)
    return F.concat(folder, named, F.when(F.startswith(ending, F.lit("_test")), "_test.go").otherwise(".go"))


def name_template(name: Column, entity: Column, module: Column) -> Column:
    """name with {Entity} for the entity's name, or, where that does not occur, for the module's in Pascal case."""
    pascal, mark = S.pascal_case(module), F.lit("{Entity}")
    return F.when(F.contains(name, entity), F.replace(name, entity, mark)).otherwise(F.replace(name, pascal, mark))


def candidate_paths(template: Column, entity: Column, module: Column) -> Column:
    """The paths, one or two, that a template may stand for; the one of both names first."""
    snake, low = S.snake_case(entity), F.lower(module)
    put = lambda m: F.replace(F.replace(template, F.lit("{entity}"), snake), F.lit("{module}"), m)
    return F.array_distinct(F.array(put(low), put(snake)))


def candidate_names(template: Column, entity: Column, module: Column) -> Column:
    """The names, one or two, that a template may stand for; the entity's first."""
    put = lambda x: F.replace(template, F.lit("{Entity}"), x)
    return F.array_distinct(F.array(put(entity), put(S.pascal_case(module))))


def blueprints(members: DataFrame, files: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of golden modules (repo_id, module): rows of files (repo_id, golden, file, template, type, entity, path), of required names
    (repo_id, file, kind, at, template), and of modules without an entity (repo_id, module, error), which have no blueprint.

    ``file`` is the file's path: it names it, and its order is the blueprint's.
    """
    own = members.join(golden.select(*_MODULE), _MODULE)
    known = own.join(entities(own, files), _MODULE)
    bad = known.where("entity IS NULL").select(*_MODULE).distinct()
    # The message.
    errors = bad.select(*_MODULE, F.concat(F.lit("could not detect entity name for module "), "module").alias("error"))
    known = known.where("entity IS NOT NULL").join(files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    out = known.select(
        "repo_id", F.col("module").alias("golden"), F.col("path").alias("file"), path_template(F.col("path"), F.col("module_path"), F.col("entity"), F.col("module")).alias("template"),
        file_type(F.col("path")).alias("type"), "entity",
    )
    names = elements(files).join(known.select("repo_id", "path", "module", "entity"), ["repo_id", "path"])
    names = names.select("repo_id", F.col("path").alias("file"), "kind", "at", name_template(F.col("name"), F.col("entity"), F.col("module")).alias("template"))
    return out, names, errors


def check(members: DataFrame, files: DataFrame, blueprint: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every other module of a repository against its blueprint (files, names).

    Returns rows of missing things (repo_id, module, kind, name, expected, file, matched, at_file, at), kind being file,
    struct, function, method, interface or pattern; rows of issues (repo_id, module, severity, category, file, message,
    pattern); and a row a module: repo_id, module, golden, score, and a count of each kind of thing that is missing.
    """
    wanted, named = blueprint
    known = entities(members, files).withColumn("entity", F.coalesce("entity", F.lit("")))
    golden = wanted.select("repo_id", "golden").distinct()
    known = known.join(golden, "repo_id").where("module <> golden")
    pairs = known.join(wanted.select("repo_id", "file", F.col("template"), "type"), "repo_id")
    tries = pairs.select(*_MODULE, "entity", "file", "type", F.posexplode(candidate_paths(F.col("template"), F.col("entity"), F.col("module"))).alias("turn", "rel"))
    # files under their module, by the path below it
    below = F.when(F.startswith("path", F.concat("module_path", F.lit("/"))), F.substr("path", F.length("module_path") + 2))
    there = members.select(*_MODULE, below.alias("rel"), "path").where("rel IS NOT NULL")
    met = tries.join(there, [*_MODULE, "rel"], "left").groupBy(*_MODULE, "entity", "file", "type").agg(
        F.min_by("rel", "turn").alias("first"), F.min_by("rel", F.when(F.col("path").isNotNull(), F.col("turn"))).alias("rel"),
        F.min_by("path", F.when(F.col("path").isNotNull(), F.col("turn"))).alias("path"),
    )
    met = met.join(files.select("repo_id", "path", F.lit(True).alias("read")).distinct(), ["repo_id", "path"], "left")
    none = F.lit(None).cast("string")
    no_file = met.where("path IS NULL").select(
        *_MODULE, F.lit("file").alias("kind"), F.col("first").alias("name"), F.col("type").alias("expected"), F.col("first").alias("file"), none.alias("matched"), F.col("file").alias("at_file"), F.lit(-1).alias("at"),
    )
    # names wanted of files that are missing, or there and read: found if any candidate of the kind is in the matched file
    asked = met.where("path IS NULL OR read").select(*_MODULE, "entity", "file", F.coalesce("rel", "first").alias("shown"), "path").join(named, ["repo_id", "file"])
    guess = asked.select(*_MODULE, "file", "shown", "path", "kind", "at", "template", F.posexplode(candidate_names(F.col("template"), F.col("entity"), F.col("module"))).alias("turn", "name"))
    have = elements(files).select("repo_id", "path", "kind", "name", F.lit(True).alias("hit")).distinct()
    found = guess.join(have, ["repo_id", "path", "kind", "name"], "left").groupBy(*_MODULE, "file", "shown", "path", "kind", "at", "template").agg(
        F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"), F.min_by("name", "turn").alias("name")
    )
    no_name = found.where("NOT hit").select(*_MODULE, "kind", "name", F.col("template").alias("expected"), F.col("shown").alias("file"), F.col("path").alias("matched"), F.col("file").alias("at_file"), "at")
    shown = members.join(known.select(*_MODULE), _MODULE)
    flags = patterns(shown, elements(files))
    # Pattern, what is expected of it, and its message.
    rules = (("validate", "Validate", "method"), ("constructor", "New{Entity}", "function"), ("interface", "port interfaces", "interface"))
    lacks = [F.when(~F.col(flag), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("expected"), F.lit(i).alias("at"))) for i, (flag, name, kind) in enumerate(rules)]
    no_pattern = flags.select(*_MODULE, F.explode(F.array_compact(F.array(*lacks))).alias("p")).select(
        *_MODULE, F.lit("pattern").alias("kind"), "p.name", "p.expected", none.alias("file"), none.alias("matched"), F.lit("~").alias("at_file"), "p.at"
    )
    missing = no_file.unionByName(no_name).unionByName(no_pattern)
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    by = missing.groupBy(*_MODULE).agg(count("file").alias("files"), count("struct").alias("structs"), count("function", "method").alias("methods"), count("interface").alias("interfaces"), count("pattern").alias("patterns"))
    counts = ["files", "structs", "methods", "interfaces", "patterns"]
    off = reduce(lambda a, b: a + b, [F.col(c) * n for c, n in zip(counts, MISSING.values())])
    report = known.join(by, _MODULE, "left").na.fill(0, counts).select(*_MODULE, "golden", F.greatest(100 - off, F.lit(0)).cast("long").alias("score"), *counts)
    return missing, check_issues(missing), report


def check_issues(missing: DataFrame) -> DataFrame:
    """Issues of missing things: files, names in files that are there, and patterns; what a missing file would hold is no issue of its own."""
    # Messages.
    told = {"Validate": ("missing Validate() method on domain entity", "validate_method"), "New{Entity}": ("missing constructor function (New...)", "constructor"), "port interfaces": ("no interfaces defined (expected port interfaces)", "port_interfaces")}
    said = lambda i: F.coalesce(*[F.when(F.col("name") == k, F.lit(v[i])) for k, v in told.items()])
    kind, is_pattern = F.col("kind"), F.col("kind") == "pattern"
    message = F.when(kind == "file", F.format_string("missing %s file: %s", "expected", "name")).when(is_pattern, said(0)).otherwise(
        F.format_string("missing %s %s (expected from blueprint pattern %s)", "kind", "name", "expected")
    )
    own = missing.where("kind IN ('file', 'pattern') OR matched IS NOT NULL")
    return own.select(
        *_MODULE, F.when(kind == "file", "error").otherwise("warning").alias("severity"), F.when(is_pattern, "pattern").otherwise("completeness").alias("category"),
        F.col("matched").alias("file"), message.alias("message"), F.when(is_pattern, said(1)).alias("pattern"), "at_file", "at",
    )


def examples(blueprint_files: DataFrame, kind: str) -> DataFrame:
    """Rows (repo_id, golden, file): the first file of a golden module whose type is ``kind``."""
    return blueprint_files.where(F.col("type") == kind).groupBy("repo_id", "golden").agg(F.min_by("file", walk_order(F.col("file"))).alias("file"))


def interface_methods(files: DataFrame) -> DataFrame:
    """Rows (repo_id, path, package, at, interface, method) of nested interface definitions."""
    rows = files.select("repo_id", "path", "package", F.posexplode("interface_defs").alias("at", "i"))
    return rows.select("repo_id", "path", "package", "at", F.col("i.name").alias("interface"), F.explode(F.array_distinct("i.methods")).alias("method"))


def receiver_methods(files: DataFrame) -> DataFrame:
    """Rows (repo_id, path, package, receiver, method), distinct, of nested functions with a receiver."""
    fns = files.select("repo_id", "path", "package", F.explode("functions").alias("fn")).where("fn.receiver <> ''")
    return fns.select("repo_id", "path", "package", F.regexp_replace(F.col("fn.receiver"), r"^\*", "").alias("receiver"), F.col("fn.name").alias("method")).distinct()


def implementations(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Rows (repo_id, interface, defined, implementation, file, package): receivers that have, in one file and outside of the
    interface's package, every method of an interface.

    Only receivers that have an interface's rarest method are candidates; their number, and not that of all receivers with
    any of its methods, is what the second join counts. wanted and have as interface_methods and receiver_methods give them.
    """
    key = ["repo_id", "path", "at"]
    have = have.select("repo_id", F.col("path").alias("file"), F.col("package").alias("of"), "receiver", "method")
    rare = have.groupBy("repo_id", "method").agg(F.count("*").alias("k"))
    # methods that no receiver has come with a null count and are the rarest
    first = wanted.join(rare, ["repo_id", "method"], "left").groupBy(*key, "interface", "package").agg(
        F.count("*").alias("n"), F.min_by("method", F.struct(F.coalesce("k", F.lit(0)), F.col("method"))).alias("method")
    )
    near = first.join(have, ["repo_id", "method"]).where("of <> package").select(*key, "interface", "n", "file", "of", "receiver")
    asked = near.join(wanted.select(*key, "method"), key)
    met = asked.join(have.select("repo_id", "file", "receiver", "method"), ["repo_id", "file", "receiver", "method"]).groupBy(*key, "interface", "n", "file", "of", "receiver").agg(F.count("*").alias("c"))
    return met.where("c = n").select("repo_id", "interface", F.col("path").alias("defined"), F.col("receiver").alias("implementation"), "file", F.col("of").alias("package"))
