"""How repositories are laid out: layers, file names, likeness of modules, duplication, expected folders and files.

``members`` has a row a file of a module (repo_id, module, layer, path), as ``modules.module_files`` gives them: a module of any
size is never one row. What is gathered of a module is its layers and known suffixes, both bounded by configuration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import scoring as S
from lodeworks.operators import facts as T
from lodeworks.operators import relational as R

MEMBERS = "repo_id string, module string, layer string, path string"
# Layers, and folder names that stand for them.
LAYERS = {"domain": "domain", "application": "application", "adapters": "adapters"}
#: Tokens of a clone, per cent of a file's lines that may be cloned, and the share of like names from which others are issues.
CLONE_TOKENS, CLONE_PERCENT, CONSISTENT = 75, 15, 0.60


def _base(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.go$", "")


def _score(share: Column, points: int = 25) -> Column:
    return F.least(F.round(share * F.lit(float(points))), F.lit(float(points))).cast("long")


def file_layer(path: Column, aliases: dict[str, str] = LAYERS) -> Column:
    """The layer of the first alias, in order of names, that is a folder of path; null if there is none."""
    hits = [F.when(F.contains(path, F.lit(f"/{a}/")), F.lit(layer)) for a, layer in sorted(aliases.items())]
    return F.coalesce(*hits)


def import_layer(name: Column, aliases: dict[str, str] = LAYERS) -> Column:
    """As file_layer, for an import, whose last segment counts too."""
    hits = [F.when(F.contains(name, F.lit(f"/{a}/")) | F.endswith(name, F.lit(f"/{a}")), F.lit(layer)) for a, layer in sorted(aliases.items())]
    return F.coalesce(*hits)


def layer_violations(files: DataFrame, members: DataFrame, aliases: dict[str, str] = LAYERS) -> tuple[DataFrame, DataFrame]:
    """Issues (repo_id, path, layer, import, pattern) of imports that point outwards, and (repo_id, checked, violations)."""
    listed = members.select("repo_id", "path").where(~T.is_test(F.col("path")))
    own = listed.join(files.select("repo_id", "path", "imports"), ["repo_id", "path"])
    own = own.withColumn("layer", file_layer(F.col("path"), aliases)).where("layer IS NOT NULL")
    each = own.select("repo_id", "path", "layer", F.explode("imports").alias("import")).withColumn("to", import_layer(F.col("import"), aliases))
    bad = each.where("layer = 'domain' AND to IN ('application', 'adapters') OR layer = 'application' AND to = 'adapters'")
    counts = own.groupBy("repo_id").agg(F.count("*").alias("checked")).join(bad.groupBy("repo_id").agg(F.count("*").alias("violations")), "repo_id", "left")
    return bad.select("repo_id", "path", "layer", "import", F.concat("layer", F.lit("→"), "to").alias("pattern")), counts.na.fill(0, ["violations"])


def dependency_direction(repos: DataFrame, checked: DataFrame, graph: DataFrame) -> DataFrame:
    """Rows (repo_id, score) of 25 for repos (repo_id): files without violations, and the score of graph (repo_id, packages, score), half each.

    A graph of one package or none says nothing, nor do no files with a layer: what is left counts alone, full points if nothing is.
    """
    rate = F.greatest(F.lit(0.0), 1 - F.col("violations") / F.col("checked"))
    both = repos.select("repo_id").distinct().join(checked.where("checked > 0").select("repo_id", rate.alias("rate")), "repo_id", "left")
    both = both.join(graph.where("packages > 1").select("repo_id", F.col("score").alias("graph")), "repo_id", "left")
    return both.select("repo_id", _score(F.coalesce((F.col("rate") + F.col("graph")) / 2, "rate", "graph", F.lit(1.0))).alias("score"))


def has_suffix(name: Column, expected: tuple[str, ...]) -> Column:
    return S.suffix_of(name).isin(*expected)


def file_names(files: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Rows (repo_id, path, name, suffixed) of the files whose names count."""
    name = _base(F.col("path"))
    own = files.where("NOT coalesce(is_generated, false)").where(~T.is_test(F.col("path")) & ~name.isin("main", "doc"))
    return own.select("repo_id", "path", name.alias("name")).withColumn("suffixed", has_suffix(F.col("name"), expected))


def naming(names: DataFrame, convention: str = "auto") -> DataFrame:
    """Rows (repo_id, dominant, consistency): whether files of file_names should be suffixed, and the share of those that are as they should.

    ``bare`` and ``suffixed`` say what should be; ``auto`` takes what most files are, bare on a tie.
    """
    a, n = F.count_if("suffixed"), F.count("*")
    dominant = {"bare": F.lit(False), "suffixed": F.lit(True)}.get(convention, 2 * a > n)
    return names.groupBy("repo_id").agg(dominant.alias("dominant"), (F.when(dominant, a).otherwise(n - a) / n).alias("consistency"))


def file_naming(files: DataFrame, expected: tuple[str, ...], convention: str = "auto") -> DataFrame:
    """Rows (repo_id, score) of 25: files named as they should be, and, if that is with suffixes, the reuse of suffixes too; 0 without files."""
    names = file_names(files, expected)
    known = files.where(~T.is_test(F.col("path"))).withColumn("_name", _base(F.col("path"))).where(has_suffix(F.col("_name"), expected))
    reuse = R.reuse_ratio(known.withColumn("_suffix", F.regexp_extract("_name", "_[^_]*$", 0)), ["repo_id"], "_suffix")
    rows = naming(names, convention).join(reuse, "repo_id", "left")
    rows = rows.select("repo_id", _score(F.when(F.col("dominant"), (F.col("consistency") + F.coalesce("reuse", F.lit(1.0))) / 2).otherwise(F.col("consistency"))).alias("score"))
    return files.select("repo_id").distinct().join(rows, "repo_id", "left").na.fill(0, ["score"])


def naming_issues(files: DataFrame, expected: tuple[str, ...], convention: str = "auto", least: float = CONSISTENT) -> DataFrame:
    """Rows (repo_id, file, severity, message) of files not named as they should be, in repositories where a share of ``least`` is."""
    names = file_names(files, expected)
    odd = names.join(naming(names, convention).where(F.col("consistency") >= least), "repo_id").where("suffixed <> dominant")
    file = F.concat("name", F.lit(".go"))
    # Messages.
    message = F.when(F.col("dominant"), F.format_string('file "%s" uses bare naming but project uses suffixed pattern', file)).otherwise(
        F.format_string('file "%s" uses suffixed naming but project uses bare pattern', file)
    )
    return odd.select("repo_id", F.col("path").alias("file"), F.when(F.col("consistency") < 0.40, "warning").otherwise("info").alias("severity"), message.alias("message"))


def _known_suffix(path: Column, expected: tuple[str, ...]) -> Column:
    suffix = F.regexp_extract(_base(path), "_[^_]*$", 0)
    return F.when(~T.is_test(path) & suffix.isin(*expected), suffix)


def predictable_structure(members: DataFrame, files: DataFrame, expected: tuple[str, ...], convention: str = "auto") -> DataFrame:
    """Rows (repo_id, score) of 25: likeness of modules that share a layer, in layers, suffixes and numbers of files."""
    own = members.groupBy("repo_id", "module").agg(
        F.collect_set("layer").alias("l"), F.collect_set(_known_suffix(F.col("path"), expected)).alias("s"), F.count_if(~T.is_test(F.col("path"))).alias("n")
    )
    by_layer = own.select("repo_id", "module", F.explode("l").alias("layer"))
    side = lambda df, p: df.select("repo_id", *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in ("repo_id", "layer")], *(["layer"] if "layer" in df.columns else []))
    pairs = side(by_layer, "a").join(side(by_layer, "b"), ["repo_id", "layer"]).where("amodule < bmodule").select("repo_id", "amodule", "bmodule").distinct()
    pairs = pairs.join(side(own, "a"), ["repo_id", "amodule"]).join(side(own, "b"), ["repo_id", "bmodule"])
    pairs = pairs.join(naming(file_names(files, expected), convention).select("repo_id", "dominant"), "repo_id", "left")
    suffixes = F.when(F.coalesce("dominant", F.lit(True)), S.jaccard(F.col("as"), F.col("bs"))).otherwise(1.0)
    like = pairs.groupBy("repo_id").agg((F.avg(S.jaccard(F.col("al"), F.col("bl"))) * 0.5 + F.avg(suffixes) * 0.3 + F.avg(S.similarity(F.col("an"), F.col("bn"))) * 0.2).alias("like"))
    # no two modules that share a layer: full points
    return files.select("repo_id").distinct().join(like, "repo_id", "left").select("repo_id", _score(F.coalesce("like", F.lit(1.0))).alias("score"))


def missing_layers(members: DataFrame) -> DataFrame:
    """Rows (repo_id, name, layer, severity): layers that over half of a repository's modules have and this one lacks."""
    modules = members.select("repo_id", F.col("module").alias("name")).distinct()
    n = modules.groupBy("repo_id").agg(F.count("*").alias("n")).where("n > 1")
    layers = members.where("layer IS NOT NULL").select("repo_id", F.col("module").alias("name"), "layer").distinct()
    count = layers.groupBy("repo_id", "layer").agg(F.count("*").alias("c"))
    total = count.groupBy("repo_id").agg(F.count("*").alias("layers"))
    # names of layers are a few a repository; each module is joined with those of its own
    peers = count.join(n, "repo_id").where("c > n div 2").select("repo_id", "layer")
    lack = modules.join(peers, "repo_id").join(layers, ["repo_id", "name", "layer"], "left_anti")
    many = lack.groupBy("repo_id", "name").agg(F.count("*").alias("m")).join(total, "repo_id")
    severity = F.when(F.col("m") > 0.75 * F.col("layers"), "warning").otherwise("info")
    return lack.join(many, ["repo_id", "name"]).select("repo_id", "name", "layer", severity.alias("severity"))


def expected_layers(members: DataFrame, paths: DataFrame, folders: tuple[str, ...], layers: tuple[str, ...], aliases: dict[str, str] = LAYERS, cross: bool = False) -> DataFrame:
    """Rows (repo_id, score) of 25, cut: expected folders at the root and expected layers that are there.

    Layers are those of modules, or, in a cross-cutting layout, the folders below ``internal``.
    """
    whole = len(folders) + len(layers)
    named = lambda x: F.coalesce(*[F.when(x == a, F.lit(b)) for a, b in aliases.items()], x)
    hits = [F.bool_or(F.startswith(F.col("path"), F.lit(f"{d}/"))).cast("int") for d in folders]
    dirs = paths.groupBy("repo_id").agg(reduce(lambda a, b: a + b, hits, F.lit(0)).alias("d"))
    inner = paths.where(F.startswith("path", F.lit("internal/"))).select("repo_id", F.get(F.split("path", "/"), 1).alias("layer")) if cross else members.select("repo_id", "layer")
    there = inner.select("repo_id", named(F.col("layer")).alias("layer")).where(F.col("layer").isin(*layers)).groupBy("repo_id").agg(F.count_distinct("layer").alias("l"))
    found = (F.col("d") + F.coalesce("l", F.lit(0))) / F.lit(whole) * 25.0 if whole else F.lit(25.0)
    return dirs.join(there, "repo_id", "left").select("repo_id", F.floor(found).alias("score"))


def expected_files(members: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Rows (repo_id, score) of 25, cut: the mean over modules of the share of files with a known ending."""
    ok = reduce(lambda a, b: a | b, [F.endswith(_base(F.col("path")), F.lit(x)) for x in (*expected, "_test")])
    share = members.groupBy("repo_id", "module").agg(F.avg(ok.cast("double")).alias("share"))
    return share.groupBy("repo_id").agg(F.floor(F.round(F.avg("share"), 9) * 25.0).alias("score"))


def bare_contracts(members: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (repo_id, name): modules with a domain or application layer of which no file has an interface."""
    inner = F.contains(F.col("path"), F.lit("/domain/")) | F.contains(F.col("path"), F.lit("/application/"))
    own = members.select("repo_id", F.col("module").alias("name"), "path").where(inner)
    own = own.join(files.select("repo_id", "path", (F.size("interfaces") > 0).alias("i")), ["repo_id", "path"], "left")
    return own.groupBy("repo_id", "name").agg(F.bool_or(F.coalesce("i", F.lit(False))).alias("i")).where("NOT i").select("repo_id", "name")


def agent_files(present: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (repo_id, score, points) for present (repo_id, name, size) and wanted (name, points, min_size): half for a file, the rest for its size."""
    w = F.broadcast(wanted)  # a configuration list
    repos = present.select("repo_id").distinct().join(w)
    half = F.greatest(F.expr("points div 2"), F.lit(1))
    got = F.when(F.col("size").isNull(), 0).when(F.coalesce("min_size", F.lit(0)) <= 0, F.col("points")).otherwise(half + F.when(F.col("size") >= F.col("min_size"), F.col("points") - half).otherwise(0))
    return repos.join(present, ["repo_id", "name"], "left").groupBy("repo_id").agg(F.sum(got).alias("score"), F.sum("points").alias("points"))


def duplication(files: DataFrame, width: int = CLONE_TOKENS, percent: int = CLONE_PERCENT) -> DataFrame:
    """Rows (repo_id, path, lines, percent, most): files (repo_id, path, is_generated, total_lines, tokens) of ``width`` tokens or more,
    and how much of each is in windows that another file has."""
    own = files.where("NOT coalesce(is_generated, false)").where(F.size("tokens") >= width).select("repo_id", "path", "total_lines", "tokens")
    covered = R.cloned_words(own, ["repo_id"], "path", "tokens", width)
    own = own.select("repo_id", "path", F.greatest("total_lines", F.lit(1)).alias("n"), "total_lines", F.size("tokens").alias("k")).join(covered, ["repo_id", "path"], "left").na.fill(0, ["duplicated"])
    lines = F.least(F.floor(F.col("duplicated") / F.greatest(F.lit(1.0), F.col("k") / F.col("n"))), F.col("total_lines")).cast("long")
    most = F.when(T.is_test(F.col("path")), 2 * percent).otherwise(percent)
    return own.select("repo_id", "path", lines.alias("lines"), F.expr("n")).select("repo_id", "path", "lines", F.expr("lines * 100 div n").alias("percent"), most.alias("most"))


def code_duplication(files: DataFrame, width: int = CLONE_TOKENS, percent: int = CLONE_PERCENT) -> DataFrame:
    """Rows (repo_id, score) of 20: credit for files within the limit; full points with fewer than two files to compare."""
    credit = F.when(F.count("*") < 2, 1.0).otherwise(F.avg(S.decay_credit(F.col("percent"), F.col("most"))))
    found = duplication(files, width, percent).groupBy("repo_id").agg(_score(F.round(credit, 9), 20).alias("score"))
    return files.select("repo_id").distinct().join(found, "repo_id", "left").select("repo_id", F.coalesce("score", F.lit(20)).alias("score"))


def duplication_issues(files: DataFrame, width: int = CLONE_TOKENS, percent: int = CLONE_PERCENT) -> DataFrame:
    """Rows (repo_id, file, severity, lines, percent) of files over the limit."""
    over = duplication(files, width, percent).where("percent > most")
    return over.select("repo_id", F.col("path").alias("file"), S.issue_severity(F.col("percent"), F.col("most")).alias("severity"), "lines", "percent")
