"""N-gram Jaccard join with a prefix tree: documents whose sets of word shingles are similar, and their classes.

1. Every text's set of 5-word shingles is hashed; equal sets are one set from here on.
2. In the order of hashes, two sets with Jaccard >= 0.8 share at least l shingles among their first
   n - ceil(0.8 n) + l. Only those prefixes are shuffled. Shingles in two or more prefixes are kept with their
   frequency; a set with too few of them is alone. Of the others only the rarest, in a global order by frequency, are
   needed. Similar sets are of similar size: a set lies in two windows of sizes, any two similar ones in one in common,
   and sets of a window that share such a shingle lie in one block (connected components). Short and long sets that share
   passages do not make a block that way. A block whose sets all lie in the next window's as well is left to that.
3. Blocks get their sets in full. Each is joined in a task by a radix trie of the sets, ordered by frequency: a probe
   walks the trie, adds up the overlap once for all sets that share a path, and leaves a subtree when what remains of
   the probe or of the subtree cannot reach the overlap needed, or when all of it is already in the probe's class.
   A block of more than ``CHUNK_SETS`` sets is cut into chunks, a task each. Every chunk also gets a few pivots of the
   block, which tie the classes of its chunks together. What then lies outside the block's largest class, mostly little,
   meets all chunks; pairs inside a class are left out, as they change nothing. Where much is left, the block's sets share
   passages without being similar; such a block is cut anew into as few chunks as fit a task (``COARSE`` shingles), since
   the trie's bounds leave most of their pairs. Chunks meet ``TURNS`` chunks of the rest at a time, so that the copies on
   disk at once grow with the sets, and not with their square.
4. Links make classes; a class is named by its smallest document.

No pair is left out: the prefix lengths, the frequency order and the trie bounds are exact filters, up to collisions of
64-bit hashes.

Defined cases: a null, empty or blank text has an empty set and is alone; fewer than five words make one shingle; rows
of equal doc_id take part each with its own text; columns beside doc_id and text are ignored, and may have any name; a
null doc_id takes part, and is the smallest only of a class that has no other; a very long text is hashed in pieces, and
its set is one row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, keep, scratch, stage
from .shingles import mix, shingle_rows, word_blocks

#: Sets and shingles of a block, over which it is joined in chunks of about as many.
CHUNK_SETS, CHUNK_SHINGLES = 64, 400_000
#: Shingles of a chunk where much of a block is outside its largest class.
COARSE = 2_000_000
#: Sets of a large block that all its chunks get in a round, and rounds before all that is left meets all chunks.
PIVOTS, ROUNDS = 4, 2
#: Chunks of what is left of a large block that all its chunks meet at a time.
TURNS = 2
#: Bands of sizes are powers of it: more than 1.25, the most that the sizes of similar sets differ by, so that rounding does not matter.
BAND = 1.26


def least(n):
    """ceil(0.8 n): the overlap that a set of n shingles needs with any partner."""
    return (4 * n + 4) // 5


def shared(n):
    """l: shingles that two similar sets share at least in their prefixes, by the size of the smaller."""
    return 1 + n // 20


def prefix_length(n):
    return n - least(n) + shared(n)


def _sets(column: pa.Array):
    """Sorted distinct shingles of each row, and the set's hash."""
    for _, counts, words, _, _ in word_blocks(column):
        for s in shingle_rows(counts, words):
            u = np.sort(s)
            if len(u) > 1:
                u = u[np.append(True, u[1:] != u[:-1])]
            yield u, int(mix(np.add.reduce(mix(u), keepdims=True) + np.uint64(len(u))).view(np.int64)[0])


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def summaries(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n, fp (hash of the set) and prefix (its first shingles in hash order)."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 512):
                s = b.slice(i, 512)
                n, fp, prefix = [], [], []
                for u, h in _sets(s.column(1)):
                    n.append(len(u))
                    fp.append(h)
                    prefix.append(u[: prefix_length(len(u))].copy() if len(u) else u)  # a view would hold the whole set
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), _long_lists(prefix)], names=["doc_id", "n", "fp", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp long, prefix array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """Rows fp, block and all (every shingle of the set) of docs (want, block, text) whose set has the hash ``want``."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 512):
                s = b.slice(i, 512)
                got = list(_sets(s.column(2)))
                fp = pa.array([h for _, h in got], pa.int64())
                # a document id may have other texts
                yield pa.RecordBatch.from_arrays([fp, s.column(1), _long_lists([u for u, _ in got])], names=["fp", "block", "all"]).filter(pc.equal(fp, s.column(0)))

    return docs.select("want", "block", "text").mapInArrow(run, "fp long, block long, all array<long>")


class Node:
    """A path of the trie: its shingles, what lies below, and the class that all of it is in, if known."""

    __slots__ = ("seg", "kids", "ends", "low", "high", "rest", "rep", "same", "depth")

    def __init__(self, seg, depth):
        self.seg, self.depth, self.kids, self.ends, self.low, self.high, self.rest, self.rep, self.same = seg, depth, [], [], 0, 0, 0, -1, False


def build(seqs: list[np.ndarray], sizes: list[int]) -> list[Node]:
    """Nodes of the radix trie of the sequences, the root first and children after their parents.

    A node's low and high bound the sizes of the sets below it, rest the shingles to come.
    """
    keys = [s.astype(">u4").tobytes() for s in seqs]
    order = sorted(range(len(seqs)), key=keys.__getitem__)
    root = Node(np.empty(0, np.int64), 0)
    todo, made = [(root, order)], []
    while todo:
        node, rows = todo.pop()
        made.append(node)
        at = 0
        while at < len(rows) and len(seqs[rows[at]]) == node.depth:
            node.ends.append(rows[at])
            at += 1
        while at < len(rows):
            first = seqs[rows[at]]
            head, to = first[node.depth], at + 1
            while to < len(rows) and seqs[rows[to]][node.depth] == head:
                to += 1
            last = seqs[rows[to - 1]]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[node.depth : n] != last[node.depth : n])
            end = node.depth + int(differ[0]) if len(differ) else n
            kid = Node(first[node.depth : end], end)
            node.kids.append(kid)
            todo.append((kid, rows[at:to]))
            at = to
    for node in reversed(made):
        n = [sizes[i] for i in node.ends] + [k.low for k in node.kids]
        node.low, node.high = min(n), max([sizes[i] for i in node.ends] + [k.high for k in node.kids])
        node.rest = max([0] + [k.rest + len(k.seg) for k in node.kids])
    return made


def trie_join(sets: list[np.ndarray], known: list | None = None) -> list[int]:
    """For each set the index of its class's first member, by links of Jaccard >= 0.8.

    known: a label of each set; sets of equal labels are of one class already.
    """
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i, j):
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)

    first: dict = {}
    for i, x in enumerate(known or ()):
        union(i, first.setdefault(x, i))
    live = list(range(len(sets)))
    while live:
        names, place, count = np.unique(np.concatenate([sets[i] for i in live]), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(sets[i]) for i in live])[:-1]
        often = [np.count_nonzero(c) for c in np.split(count[place] > 1, cuts)]
        kept = [i for i, c in zip(live, often) if c >= least(len(sets[i]))]
        if len(kept) == len(live):
            break
        live = kept
    if len(live) < 2:
        return [find(i) for i in range(len(sets))]
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -count))] = np.arange(len(names))  # frequent first: similar sets share their paths
    seqs, sizes = [], [len(sets[i]) for i in live]
    for p in np.split(place, cuts):
        seqs.append(np.sort(rank[p[count[p] > 1]]))
    nodes = build(seqs, sizes)
    root = nodes[0]

    def settle(node: Node) -> None:
        if not node.same and all(k.same for k in node.kids):
            tops = {find(live[i]) for i in node.ends} | {find(k.rep) for k in node.kids}
            if len(tops) == 1:
                node.same, node.rep = True, tops.pop()

    if known:
        for node in reversed(nodes):
            settle(node)
    # which of the root's subtrees hold a shingle at all
    owners, shingles = [], []
    for k, kid in enumerate(root.kids):
        stack, below = [kid], []
        while stack:
            x = stack.pop()
            below.append(x.seg)
            stack.extend(x.kids)
        below = np.unique(np.concatenate(below))
        shingles.append(below)
        owners.append(np.full(len(below), k))
    shingles, owners = np.concatenate(shingles), np.concatenate(owners)
    by = np.argsort(shingles, kind="stable")
    owners = owners[by]
    edges = np.searchsorted(shingles[by], np.arange(len(names) + 1))
    low = np.array([k.low for k in root.kids])
    mark = np.zeros(len(names), bool)
    for r, seq in enumerate(seqs):
        own, n = live[r], sizes[r]
        mark[seq] = True
        held = np.bincount(np.concatenate([owners[edges[t] : edges[t + 1]] for t in seq.tolist()]), minlength=len(root.kids))
        stack = [(root.kids[k], 0) for k in np.flatnonzero(9 * held >= 4 * (n + low)).tolist()]
        seen = []
        while stack:
            node, overlap = stack.pop()
            if node.same and find(node.rep) == find(own):
                continue
            if node.high < least(n) or least(node.low) > n:
                continue
            overlap += int(np.count_nonzero(mark[node.seg]))
            left = len(seq) - int(np.searchsorted(seq, node.seg[-1], "right"))
            if 9 * (overlap + min(left, node.rest)) < 4 * (n + node.low):
                continue
            seen.append(node)
            for i in node.ends:
                if i != r and 9 * overlap >= 4 * (n + sizes[i]):
                    union(own, live[i])
            stack.extend((k, overlap) for k in node.kids)
        for node in reversed(seen):
            settle(node)
        mark[seq] = False
    return [find(i) for i in range(len(sets))]


def _join_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (fp, root) of a group's sets (fp, root, all) to the first of their class; root in the input: the class so far."""
    pdf = pdf.drop_duplicates("fp").sort_values("fp")
    fp = pdf["fp"].to_numpy()
    top = np.asarray(trie_join([np.asarray(x, np.int64).view(np.uint64) for x in pdf["all"]], pdf["root"].tolist()), np.int64)
    return pd.DataFrame({"fp": fp, "root": fp[top]})[top != np.arange(len(fp))]


def _linked(sets: DataFrame, keys: list[str], known: DataFrame | None) -> DataFrame:
    """Links inside the groups of sets (fp, all, keys), staged; known: classes (fp, root) of earlier links."""
    sets = sets.withColumn("root", F.col("fp")) if known is None else sets.join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stage(sets.groupBy(*keys).applyInPandas(_join_group, "fp long, root long"), "links")


def _parts(sets: Column, shingles: Column, chunk: int) -> Column:
    return F.greatest(F.ceil(sets / F.lit(chunk)), F.ceil(shingles / F.lit(CHUNK_SHINGLES))).cast("int")


def _numbers(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _large_blocks(rows: DataFrame, n_blocks: int, chunk: int, coarse: int) -> DataFrame:
    """Links (fp, root) of blocks in chunks: rows (fp, block, all, g, c), with c the set's chunk of g."""
    links, known, pool = None, None, rows.select("fp", "block")
    for turn in range(ROUNDS):
        order = F.xxhash64("fp", F.lit(turn))
        pivots = pool.groupBy("block", F.pmod(order, F.lit(PIVOTS)).alias("_k")).agg(F.min_by("fp", order).alias("fp")).select("block", "fp")
        some = rows if turn == 0 else rows.join(broadcast_if_small(pool.select("block").distinct(), n_blocks, 8), "block", "left_semi")
        sent = rows.join(broadcast_if_small(pivots, n_blocks * PIVOTS, 16), ["block", "fp"]).select("fp", "block", "all", _numbers("g").alias("c"))
        found = _linked(some.select("fp", "block", "all", "c").union(sent), ["block", "c"], known)
        links = found if links is None else links.union(found)
        known = stage(components(links.select(F.col("fp").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("fp"), "root"), "known")
        named = stage(rows.select("fp", "block", F.size("all").alias("n")).join(known, "fp", "left").select("fp", "block", "n", F.coalesce("root", "fp").alias("root")), "named")
        counts = named.groupBy("block", "root").agg(F.count("*").alias("k"))
        top = counts.groupBy("block").agg(F.max_by("root", F.struct("k", "root")).alias("top"))
        out = stage(named.join(broadcast_if_small(top, n_blocks, 16), "block").where("root <> top").select("fp", "block", "n"), "out")
        whole = named.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(coarse)).cast("int").alias("wide"))
        left = out.groupBy("block").agg(_parts(F.count("*"), F.sum("n"), chunk).alias("h"), F.ceil(F.sum("n") / F.lit(coarse)).cast("int").alias("h_wide"))
        left = stage(left.join(broadcast_if_small(whole, n_blocks, 16), "block"), "left")
        # blocks whose rest is more than a chunk try other pivots, from the rest
        pool = out.join(broadcast_if_small(left.where("h > 1").select("block"), n_blocks, 8), "block", "left_semi").select("fp", "block")
        if pool.isEmpty():
            break
    left = left.select("block", F.when(F.col("h") > 1, F.col("wide")).alias("w"), F.when(F.col("h") > 1, F.col("h_wide")).otherwise(1).alias("h"))
    turns = left.agg(F.max("h")).first()[0] or 0
    cut = rows.join(broadcast_if_small(left, n_blocks, 24), "block")
    cut = cut.withColumn("c", F.when(F.col("w").isNull(), F.col("c")).otherwise(F.pmod(F.xxhash64("fp"), "w").cast("int"))).withColumn("g", F.coalesce("w", "g"))
    rest = cut.join(out.select("fp", "block"), ["fp", "block"], "left_semi").withColumn("o", F.pmod(F.xxhash64("fp", F.lit(-1)), "h").cast("int"))
    for at in range(0, turns, TURNS):
        now = F.sequence(F.lit(at), F.least(F.col("h"), F.lit(at + TURNS)) - 1)
        every = cut.where(F.col("h") > at).select("fp", "block", "all", "c", F.explode(now).alias("o"))
        some = rest.where(F.col("o").between(at, at + TURNS - 1)).select("fp", "block", "all", _numbers("g").alias("c"), "o")
        links = links.union(_linked(every.union(some), ["block", "c", "o"], known))
    return links


def links(docs: DataFrame, sets: DataFrame, rare: DataFrame, chunk: int = CHUNK_SETS, coarse: int = COARSE) -> DataFrame:
    """Rows (fp, root) for the sets (fp, doc_id, n) that are linked to another: one root a class of sets. Keeps them in the caller's scope.

    rare has rows (fp, t): what a set's partners share at least one of.
    """
    with scratch(docs.sparkSession):
        return keep(_links(docs, sets, rare, chunk, coarse), "links")


def distinct_sets(sums: DataFrame) -> DataFrame:
    """Rows fp, doc_id, n, prefix: each set of sums that is not empty, once. Only sets that several rows have are shuffled."""
    some = sums.where("n > 0").select("fp", "doc_id", "n", "prefix")
    again = stage(some.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "again")
    again = broadcast_if_small(again, again.count(), 8)
    once = some.join(again, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("s"))
    return some.join(again, "fp", "left_anti").union(once.select("fp", "s.doc_id", "s.n", "s.prefix"))


def rare_shingles(sets: DataFrame) -> DataFrame:
    """Rows (fp, t) of sets (fp, n, prefix): of the shingles of a prefix that others have, the rarest, one of which any similar set has."""
    rows = sets.select("fp", "n", F.explode("prefix").alias("t"))
    often = rows.withColumn("df", F.count("*").over(Window.partitionBy("t"))).where("df > 1")
    lists = often.groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    low = (1 + F.expr("((4 * n + 4) div 5) div 20")).cast("int")  # shared(least(n))
    lists = lists.where(F.size("ts") >= low).select("fp", F.expr("slice(ts, 1, size(ts) - (1 + CAST(((4 * n + 4) div 5) div 20 AS INT)) + 1)").alias("ts"))
    return lists.select("fp", F.explode("ts.t").alias("t"))


def _windows(sets: DataFrame) -> DataFrame:
    """sets (fp, n, ...) twice, with its band of sizes, each window that the band is in, and node, a hash of set and window."""
    sets = sets.withColumn("band", F.floor(F.log("n") / F.lit(math.log(BAND))).cast("int"))
    return sets.withColumn("window", F.explode(F.array(F.col("band") - 1, F.col("band")))).withColumn("node", F.xxhash64("fp", "window"))


def _links(docs: DataFrame, sets: DataFrame, rare: DataFrame, chunk: int, coarse: int) -> DataFrame:
    sized = stage(rare.join(sets.select("fp", "n"), "fp"), "sized")
    active = _windows(sized).select("node", "window", "t")
    hubs = stage(active.groupBy("window", "t").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub < far").select("window", "t", "hub"), "hubs")
    stars = active.join(hubs, ["window", "t"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    found = _windows(sets).join(components(stars), "node").withColumnRenamed("root", "block")
    found = stage(found.select("fp", "doc_id", "n", "block", (F.col("band") - F.col("window")).alias("up")), "found")
    # a block without a set of its window's lower band is in one of the next window
    chosen = stage(found.join(found.where("up = 0").select("block").distinct(), "block", "left_semi").select("fp", "doc_id", "n", "block"), "chosen")
    n = chosen.count()
    if n == 0:
        return chosen.select("fp", F.col("fp").alias("root"))
    wanted = chosen.select(F.col("doc_id").alias("_d"), F.col("fp").alias("want"), "block")
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted, n, 24), F.col("doc_id").eqNullSafe(F.col("_d")))
    full = stage(full_sets(texts), "full")
    if full.count() > n:  # rows of equal doc_id and set
        full = stage(full.groupBy("fp", "block").agg(F.first("all").alias("all")), "full")
    large = chosen.groupBy("block").agg(_parts(F.count("*"), F.sum("n"), chunk).alias("g")).where("g > 1")
    large = stage(large, "large")
    n_blocks = large.count()
    found = _linked(full.join(broadcast_if_small(large, n_blocks, 16), "block", "left_anti").select("fp", "block", "all"), ["block"], None)
    if n_blocks:
        cut = full.join(broadcast_if_small(large, n_blocks, 16), "block").withColumn("c", F.pmod(F.xxhash64("fp"), "g").cast("int"))
        found = found.union(_large_blocks(stage(cut.select("fp", "block", "all", "g", "c"), "cut"), n_blocks, chunk, coarse))
    return components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("fp"), "root")


def classes(docs: DataFrame, chunk: int = CHUNK_SETS, coarse: int = COARSE) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, fp, root for docs (doc_id, text); root is one hash a class."""
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):  # prefixes go once they are read
            with scratch(docs.sparkSession):
                sums = stage(summaries(docs), "sums")
                rows, sets = keep(sums.select("doc_id", "n", "fp"), "rows"), keep(distinct_sets(sums), "sets")
            rare, sets, rows = keep(rare_shingles(sets), "rare"), keep(sets.drop("prefix"), "sets"), keep(rows, "rows")
        found = links(docs, sets, rare, chunk, coarse)
        named = rows.where("n > 0").join(found, "fp", "left").select("doc_id", "n", "fp", F.coalesce("root", "fp").alias("root"))
        named = stage(named, "named")
        first = stage(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")
        out = named.join(first, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "fp", "root")
        alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "fp", F.col("fp").alias("root"))
        return keep(out.union(alone), "classes")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("fp", "root")


def near_duplicate_filter(docs: DataFrame) -> DataFrame:
    """One row of each class of docs stays, that of the smallest doc_id and then of the smallest set's hash; columns unchanged.

    Of rows with one doc_id and set, that of the smallest text stays. Rows with a null doc_id, and those without words, all
    stay.
    """

    @F.pandas_udf("n long, fp long")
    def summary(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(u), h) for u, h in _sets(pa.array(text, pa.string(), from_pandas=True))], columns=["n", "fp"])

    columns = [F.col(f"`{c}`") for c in docs.columns]
    with scratch(docs.sparkSession):
        found = stage(classes(docs).where("doc_id IS NOT NULL"), "classes")
        sets = found.where("n_shingles > 0")
        again = keep(found.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("n_shingles").alias("n")).where("c > 1 AND n > 0").select("doc_id"), "again")
        # of the other documents the id tells the text
        apart = keep(sets.where("doc_id <> component_id").select("doc_id").union(again).distinct(), "apart")
        stay = docs.join(broadcast_if_small(apart, apart.count(), 8), "doc_id", "left_anti").select(*columns)
        n = again.count()
        if n == 0:
            return stay
        few = broadcast_if_small(again, n, 8)
        first = sets.where("doc_id = component_id").join(few, "doc_id", "left_semi").groupBy("root", "doc_id").agg(F.min("fp").alias("_fp"))
        mixed = docs.join(few, "doc_id", "left_semi").select(F.struct(*columns).alias("_row"), "doc_id", "text", summary("text").alias("_s"))
        mixed = stage(mixed.select("_row", "doc_id", "text", F.col("_s.n").alias("_n"), F.col("_s.fp").alias("_fp")), "mixed")
        once = mixed.where("_n > 0").join(first.select("doc_id", "_fp"), ["doc_id", "_fp"], "left_semi")
        once = once.groupBy("doc_id", "_fp").agg(F.min_by("_row", "text").alias("_row"))
        more = keep(mixed.where("_n = 0").select("_row").union(once.select("_row")), "more")
    return stay.union(more.select("_row.*"))
