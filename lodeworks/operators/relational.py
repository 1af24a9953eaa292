"""Relational operators as DataFrame compositions: order statistics, division, set joins, votes, windows, graphs."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lower_rank(df: DataFrame, keys: list[str], value: str, name: str, q: float = 0.9) -> DataFrame:
    """Per group the value at place trunc((n - 1) * q) of the sorted values; counts of equal values keep groups small."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value))
    at = ((F.sum("_c").over(w) - 1).cast("double") * F.lit(q)).cast("long")
    c = counts.withColumn("_u", upto).withColumn("_at", at)
    return c.where((F.col("_u") > F.col("_at")) & (F.col("_u") - F.col("_c") <= F.col("_at"))).select(*keys, F.col(value).alias(name))


def median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median per group, the mean of the middle two: from counts of equal values and their running sum, so that a group is
    as large as its distinct values. Without keys, one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("_u", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    # places (n - 1) div 2 and n div 2, from 0; one value may hold both
    holds = lambda at: ((F.col("_u") > F.expr(at)) & (F.col("_u") - F.col("_c") <= F.expr(at))).cast("int")
    share = (holds("(_n - 1) div 2") + holds("_n div 2")) * F.col(value)
    return counts.groupBy(*keys).agg((F.sum(share) / 2).alias(name))


def outliers(df: DataFrame, value: str, times: float) -> DataFrame:
    """Rows whose value is over ``times`` the median; none if the median is under 1. The median is one broadcast row."""
    return df.join(F.broadcast(median(df, [], value, "median")), (F.col("median") >= 1) & (F.col(value) > F.lit(times) * F.col("median")))


def entropy(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Shannon entropy of names per group over log2 of the number of rows; 0 up to one row, 1 at most."""
    c = df.groupBy(*keys, name).agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy(*keys))
    p = F.col("c") / F.col("n")
    h = F.sum(-p * F.log2(p)) / F.log2(F.max("n"))
    return c.withColumn("n", n).groupBy(*keys).agg(F.when(F.max("n") <= 1, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), h), 6)).alias("entropy"))


#: Keys and elements of a block of sets, and elements a task takes at once as columns of a matrix.
BLOCK_KEYS, BLOCK_ELEMENTS, COLUMNS = 4096, 4_000_000, 4096
#: Common elements of pairs, for each row of the sets, up to which they are joined and counted.
JOINED = 64


def jaccard_pairs(sets: DataFrame, key: str, element: str, least: float) -> DataFrame:
    """Pairs a < b of keys whose sets have Jaccard >= least; sets has distinct rows.

    Where few keys share an element, an equi-join on elements, counted. Else the common elements of pairs are far more than
    the sets, and would all be shuffled: blocks of sets meet in tasks instead, and pairs are written out as they are found.
    """
    sets = durable(sets.select(key, element))
    known = sets.where(F.col(element).isNotNull() & F.col(key).isNotNull())
    c = F.col("_c").cast("double")
    rows, joined = known.groupBy(element).agg(F.count("*").alias("_c")).agg(F.sum("_c"), F.sum(c * (c - 1) / 2)).first()
    pairs = _joined_pairs(sets, key, element) if (joined or 0) <= JOINED * (rows or 0) else _block_pairs(sets, key, element, least, rows)
    near = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")
    union = F.col("na") + F.col("nb") - F.col("shared")
    return pairs.where(near & (F.col("shared") >= F.lit(least) * union)).select(
        "a", "b", "shared", F.round(F.col("shared") / union, 6).alias("jaccard"), F.round(F.least("na", "nb") / F.greatest("na", "nb"), 6).alias("size_similarity")
    )


def _joined_pairs(sets: DataFrame, key: str, element: str) -> DataFrame:
    rows = sets.join(sets.groupBy(key).agg(F.count("*").alias("n")), key)
    a = rows.select(F.col(key).alias("a"), element, F.col("n").alias("na"))
    b = rows.select(F.col(key).alias("b"), element, F.col("n").alias("nb"))
    return a.join(b, element).where(F.col("a") < F.col("b")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))


def _block_pairs(sets: DataFrame, key: str, element: str, least: float, rows: int) -> DataFrame:
    """Rows (a, b, na, nb, shared) of all pairs that share an element and may have Jaccard >= least."""
    names = durable(sets.select(element).where(F.col(element).isNotNull()).distinct().withColumn("_id", F.monotonically_increasing_id()))
    each = sets.where(F.col(key).isNotNull()).join(names, element, "left").groupBy(key).agg(F.count("*").alias("_n"), F.collect_list("_id").alias("_ids"))
    each = durable(each)
    g = max(1, -(-each.count() // BLOCK_KEYS), -(-rows // BLOCK_ELEMENTS))
    kind = each.schema[key].dataType.simpleString()
    blocks = each.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(g)).cast("int")).groupBy("_g").applyInPandas(_packed, f"_g int, _keys array<{kind}>, _n array<long>, _len array<long>, _names binary, _ids binary")
    blocks = durable(blocks)
    # every pair of partitions is a task that reads both: no block is copied for another
    side = lambda x: blocks.select(*[F.col(c).alias(f"{c}{x}") for c in blocks.columns]).repartition(min(g, 64))
    met = side(1).join(side(2).hint("shuffle_replicate_nl"), F.col("_g1") <= F.col("_g2"))
    found = met.mapInArrow(lambda batches: _meet(batches, least), f"x {kind}, y {kind}, nx long, ny long, shared long")
    swap = lambda p, q: F.when(F.col("x") < F.col("y"), F.col(p)).otherwise(F.col(q))
    return found.select(swap("x", "y").alias("a"), swap("y", "x").alias("b"), swap("nx", "ny").alias("na"), swap("ny", "nx").alias("nb"), "shared")


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of sets as one row: keys, sizes, ids of elements, and each set's places among these, as a table of bits if that is smaller."""
    ids = [np.asarray(x, np.int64) for x in pdf["_ids"]]
    key = next(c for c in pdf.columns if c not in ("_n", "_ids", "_g"))
    names, place = np.unique(np.concatenate(ids), return_inverse=True)
    lens = [len(x) for x in ids]
    if len(ids) * len(names) < 32 * len(place):
        bits = np.zeros((len(ids), len(names)), bool)
        bits[np.repeat(np.arange(len(ids)), lens), place] = True
        body = np.packbits(bits).tobytes()
    else:
        body = place.astype(np.int32).tobytes()
    return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_keys": [pdf[key].tolist()], "_n": [pdf["_n"].tolist()], "_len": [lens], "_names": [names.tobytes()], "_ids": [body]})


def _unpacked(one: pa.RecordBatch, x: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, sizes, ids of elements, and for each element of each set the set's row and the element's place among the ids."""
    keys, sizes, lens = (one.column(f"{c}{x}").flatten() for c in ("_keys", "_n", "_len"))
    names, lens = np.frombuffer(one.column(f"_names{x}")[0].as_py(), np.int64), lens.to_numpy()
    body, n = one.column(f"_ids{x}")[0].as_py(), int(lens.sum())
    if len(lens) * len(names) < 32 * n:
        row, place = np.nonzero(np.unpackbits(np.frombuffer(body, np.uint8), count=len(lens) * len(names)).reshape(len(lens), len(names)))
    else:
        row, place = np.repeat(np.arange(len(lens)), lens), np.frombuffer(body, np.int32)
    return keys, sizes.to_numpy(), names, row, place


def _meet(batches, least: float):
    """Pairs of the two blocks of each row: sets as rows of 0 and 1, multiplied ``COLUMNS`` elements and 256 sets at a time."""
    for batch in batches:
        for r in range(len(batch)):
            one = batch.slice(r, 1)
            same = one.column("_g1")[0].as_py() == one.column("_g2")[0].as_py()
            keys, sizes, names, rows, places = zip(*(_unpacked(one, x) for x in "12"))
            common = np.intersect1d(*names, assume_unique=True)
            at = []
            for x in (0, 1):  # places among the common elements, in their order, and the rows that have them
                to = np.full(len(names[x]), -1)
                to[np.searchsorted(names[x], common)] = np.arange(len(common))
                has = to[places[x]] >= 0
                row, place = rows[x][has], to[places[x]][has]
                by = np.argsort(place, kind="stable")
                at.append((row[by], place[by]))
            for lo in range(0, len(sizes[0]), 256):
                hi = min(lo + 256, len(sizes[0]))
                shared = np.zeros((hi - lo, len(sizes[1])), np.float32)  # exact up to 2^24 elements
                inside = (at[0][0] >= lo) & (at[0][0] < hi)
                left = (at[0][0][inside] - lo, at[0][1][inside])
                for c in range(0, len(common), COLUMNS):
                    here = []
                    for (row, place), n in ((left, hi - lo), (at[1], len(sizes[1]))):
                        f, t = np.searchsorted(place, [c, c + COLUMNS])
                        m = np.zeros((n, min(COLUMNS, len(common) - c)), np.float32)
                        m[row[f:t], place[f:t] - c] = 1
                        here.append(m)
                    shared += here[0] @ here[1].T
                keep = (shared > 0) & (shared >= least * (sizes[0][lo:hi, None] + sizes[1][None] - shared) - 1)  # Spark has the last word
                if same:
                    keep &= np.arange(lo, hi)[:, None] < np.arange(len(sizes[1]))[None]
                i, j = np.nonzero(keep)
                for s in range(0, len(i), 1 << 17):
                    a, b = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [keys[0].take(pa.array(a + lo)), keys[1].take(pa.array(b)), pa.array(sizes[0][a + lo]), pa.array(sizes[1][b]), pa.array(shared[a, b].astype(np.int64))], names=["x", "y", "nx", "ny", "shared"]
                    )


def divide(df: DataFrame, divisor: DataFrame, keys: list[str], element: str) -> DataFrame:
    """Keys that have every element of divisor: distinct counts compared."""
    all_ = divisor.select(element).distinct()
    n = all_.agg(F.count("*").alias("_n"))
    have = df.select(*keys, element).distinct().join(all_, element, "left_semi").groupBy(*keys).agg(F.count("*").alias("_c"))
    return have.join(F.broadcast(n), F.col("_c") == F.col("_n")).select(*keys)


def covers(sets: DataFrame, wanted: DataFrame, key: str, target: str, element: str) -> DataFrame:
    """Pairs (key, target) where key's set holds all of the target's.

    A target of one element meets the keys in one join, whose rows are the result; no pair is shuffled. Targets of more are
    counted once for all that want the same, under the smallest of them, and written out after that.
    """
    of = wanted.where(F.col(target).isNotNull()).groupBy(target).agg(F.sort_array(F.collect_list(element)).alias("_e"), F.count("*").alias("_n"))
    of = of.where("size(_e) = _n")  # no set holds a null
    one = sets.join(of.where("_n = 1").select(target, F.col("_e")[0].alias(element)), element).select(key, target)
    more = of.where("_n > 1")
    alike = more.groupBy("_e", "_n").agg(F.min(target).alias("_first"))
    hit = sets.join(alike.select("_first", "_n", F.explode("_e").alias(element)), element).groupBy(key, "_first", "_n").agg(F.count("*").alias("_c")).where("_c = _n")
    return one.union(hit.join(more.join(alike, ["_e", "_n"]).select("_first", target), "_first").select(key, target))


def new_rows(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of now that before lacks."""
    return now.select(*keys).distinct().join(before.select(*keys), keys, "left_anti")


def missing_peers(sets: DataFrame, key: str, element: str) -> DataFrame:
    """(key, missing): elements that over half of the keys have and this key lacks.

    The common elements are a short list (fewer than twice the mean set size), carried as one row: joins with one row are no
    pairs.
    """
    n = sets.agg(F.count_distinct(key).alias("_n"))
    common = sets.groupBy(element).agg(F.count("*").alias("_c")).join(F.broadcast(n), F.expr("_c > _n div 2"))
    listed = common.agg(F.collect_set(element).alias("_all"))
    have = sets.groupBy(key).agg(F.collect_set(element).alias("_have"))
    return have.join(F.broadcast(listed)).select(key, F.explode(F.array_except("_all", "_have")).alias("missing"))


def reuse_ratio(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    c = df.groupBy(*keys, name).agg(F.count("*").alias("c"))
    return c.groupBy(*keys).agg(F.round(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("reuse"))


# The order of roles when votes tie.
ROLES = ("entry_point", "adapter", "orchestrator", "ports", "core")


def fuse_votes(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The role with most votes, then most confidence, then in the order of ROLES; two votes add 0.10, up to 0.95."""
    g = votes.groupBy(*keys, "role").agg(F.count("*").alias("votes"), F.max("conf").alias("c"))
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    best = F.max_by(F.struct("role", "votes", "c"), F.struct("votes", "c", -place)).alias("b")
    sure = F.when(F.col("b.votes") >= 2, F.col("b.c") + F.lit(0.10)).otherwise(F.col("b.c"))
    return g.groupBy(*keys).agg(best).select(*keys, "b.role", "b.votes", F.least(F.lit(0.95), sure).alias("confidence"))


def covered_length(df: DataFrame, keys: list[str], start: str, width: int, name: str) -> DataFrame:
    """Length of the union of intervals [start, start + width) per group; starts are distinct."""
    w = Window.partitionBy(*keys).orderBy(start)
    step = F.least(F.lit(width), F.coalesce(F.col(start) - F.lag(start).over(w), F.lit(width)))
    return df.withColumn("_s", step.cast("long")).groupBy(*keys).agg(F.sum("_s").alias(name))


def durable(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read again: lineage is cut, and lost executors do not lose it. The session's folder is taken.

    It is Parquet, compressed and read by column, and Spark deletes the shuffle files as the write ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/durable-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def cloned_words(df: DataFrame, keys: list[str], file: str, words: str, width: int) -> DataFrame:
    """Words of each file inside ``width``-word windows that another file of the same keys has too: (keys, file, duplicated).

    Words are hashed once, and windows from their words' hashes, so the join is on 64 bits; hashes are counted with a
    map-side combine before the join.
    """
    hashed = df.select(*keys, file, F.transform(words, lambda x: F.xxhash64(x)).alias("_w")).where(F.size("_w") >= width)
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - (width - 1)), lambda i: F.xxhash64(F.slice("_w", i, width)))
    grams = hashed.select(*keys, file, F.posexplode(windows).alias("at", "h"))
    shared = grams.groupBy(*keys, "h").agg(F.min(file).alias("_a"), F.max(file).alias("_b")).where("_a < _b").select(*keys, "h")
    places = grams.join(shared, [*keys, "h"], "left_semi").select(*keys, file, "at").distinct()
    return covered_length(places, [*keys, file], "at", width, "duplicated")


def degrees(edges: DataFrame) -> DataFrame:
    """Nodes of edges (src, dst) with ca (edges in) and ce (edges out): one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("ca"), F.sum("e.o").alias("ce"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle of edges (src, dst), in work that grows with the edges and the longest path, not with pairs of nodes.

    Nodes without an edge in or out are peeled off. In what remains each node takes the greatest name that reaches it; a
    node that keeps its own is the root of a component, which is what reaches it back inside its name. Whole components go,
    and the rest is searched again.
    """
    found = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    rest = durable(edges.where("src <> dst").select("src", "dst").distinct())
    while True:
        n = rest.count()
        if n == 0:
            return found.distinct()
        peeled = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        peeled = durable(peeled.select("src", "dst"))
        if peeled.count() < n:
            rest = peeled
            continue
        names = durable(rest.select(F.col("src").alias("node"), F.col("src").alias("name")).distinct())
        while True:
            come = rest.join(names.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("name").alias("_in"))
            now = durable(names.join(come, "node").select("node", F.greatest("name", "_in").alias("name"), (F.col("_in") > F.col("name")).alias("moved")))
            names = now.drop("moved")
            if now.where("moved").isEmpty():
                break
        a, b = names.select(F.col("node").alias("src"), F.col("name").alias("_a")), names.select(F.col("node").alias("dst"), F.col("name").alias("_b"))
        inner = durable(rest.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst"))
        roots = names.where("node = name").select("node")
        back, edge = durable(roots), roots
        while True:  # backwards from the roots
            edge = durable(inner.join(edge.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(back, "node", "left_anti"))
            if edge.isEmpty():
                break
            back = durable(back.union(edge))
        # a root alone in its component is on no cycle
        found = found.union(back.join(inner.select(F.col("src").alias("node")), "node", "left_semi").join(roots, "node", "left_anti"))
        found = durable(found.union(inner.join(back.select(F.col("node").alias("src")), "src", "left_semi").join(roots.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"))).distinct())
        gone = back.withColumnRenamed("node", "src")
        rest = durable(rest.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))


def edge_violations(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges that break the direction of roles, with both roles."""
    a = roles.select(F.col("node").alias("src"), F.col("role").alias("src_role"))
    b = roles.select(F.col("node").alias("dst"), F.col("role").alias("dst_role"))
    s, t = F.col("src_role"), F.col("dst_role")
    bad = (s.isin("core", "ports") & t.isin("adapter", "orchestrator")) | ((s == "orchestrator") & (t == "adapter")) | ((s == "adapter") & (t == "adapter"))
    return edges.join(a, "src").join(b, "dst").where(bad).select("src", "dst", "src_role", "dst_role")


def rescored(metrics: DataFrame, skipped: DataFrame) -> DataFrame:
    """Category scores out of 100 from the sub-metrics that are not skipped."""
    left = metrics.join(F.broadcast(skipped), ["cat", "sub"], "left_anti")  # a configuration list
    return left.groupBy("cat").agg(F.round(100 * F.sum("score") / F.sum("points"), 6).alias("rescored"))


def placed(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with its place, from 0, in the order of ``order`` within keys, nulls first; a group of any size is sorted by many tasks.

    A range shuffle sorts all rows; a row's number is its place in its partition and the rows of the partitions before,
    and its group's first number is taken off. Equal rows may change places.
    """
    rows = df.withColumn("_u", F.monotonically_increasing_id())  # splits ranges of equal rows
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *keys, *order, "_u").sortWithinPartitions(*keys, *order, "_u").withColumn("_m", F.monotonically_increasing_id())
    rows = durable(rows.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_u"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = rows.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.col("_at")).drop("_part", "_start")
    first = rows.groupBy(*keys).agg(F.min("_at").alias("_first"))
    first = first.select(*[F.col(k).alias(f"_k{k}") for k in keys], "_first")
    joined = rows.join(first, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys])
    return joined.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first", *[f"_k{k}" for k in keys])
