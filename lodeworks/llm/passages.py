"""Substring dedup by compact windows: passages that are repeated, exactly or nearly, in other documents.

1. For each of ``HASHES`` hash functions, the shingles of a text get a min-hash key. A Cartesian tree over the keys gives
   the compact windows (l, c, r): all runs of shingles between l and r that hold c have their least key at c. Only
   windows that hold a run of the least passage length count, about 2 n / length of them. All runs of a window share the
   signature of the shingle at c.
2. Signatures that two or more documents have mark windows. Runs that lie in marked windows of enough hash functions
   (an interval join inside the document) are candidates.
3. The shingles of candidates are counted over all documents. A run of the least length of which four fifths or more are
   in other documents' candidates may be part of a passage, and runs that meet are one.
4. Verification by partner. Where one document comes first for four fifths of a passage, it is the representative. Else the
   first and the last documents of its shingles are asked how much of the passage they hold, and then the first of the
   documents that the same one has answered for. A passage that no document holds so far falls into the parts that single
   ones do; parts under the least length are none.

Every step is a join or an aggregation by signature or shingle; a passage is held against the few documents that come
first for some of its shingles, never against all that share it, so one that thousands share costs as many rows.

Defined cases: null, empty and short texts hold no passage; a passage repeated inside one document only is not reported;
rows of equal doc_id and text count as one document; rows with a null doc_id are never reported nor changed; columns
beside doc_id and text are ignored, and may have any name; very long texts are hashed in pieces, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep, partitions, ranked, scratch, stage
from .shingles import WIDTH, mix, shingle_rows, word_blocks

#: Least words of a passage, hash functions, and how many of them must agree.
WORDS, HASHES, AGREE = 50, 4, 2
SHARE, GAP = 0.8, WIDTH + 1
_LOW = 26


def seeds(k: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, k, dtype=np.uint64)


def sliding_least(keys: np.ndarray, t: int) -> np.ndarray:
    """Least key of each run of t keys: prefix and suffix minima of blocks of t."""
    n = len(keys)
    full = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    grid = full.reshape(-1, t)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - t + 1], before[t - 1 : n])


def cartesian(keys: list[int], places: list[int], lo: int, hi: int) -> tuple[list[int], list[int]]:
    """For each place the first and last of the stretch in [lo, hi) where its key is least, from a stack."""
    left, right, stack = [lo] * len(keys), [hi - 1] * len(keys), []
    for i, k in enumerate(keys):
        while stack and keys[stack[-1]] > k:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1 if stack else lo
        stack.append(i)
    return left, right


def compact_windows(sh: np.ndarray, ends: np.ndarray, t: int, seed: np.uint64) -> tuple[np.ndarray, ...]:
    """(c, l, r) of the compact windows of t shingles or more, for rows of shingles that end at ``ends``.

    A key is the high bits of the hash, then the place, so that of equal hashes the first is less. The places next to a
    window of t or more are themselves least in some run of t, so the tree is built from such places alone.
    """
    none = np.empty(0, np.int64)
    if len(sh) < t:
        return none, none, none
    low = np.uint64((1 << _LOW) - 1)
    keys = (mix(sh ^ seed) & ~low) | np.arange(len(sh), dtype=np.uint64)
    least = sliding_least(keys, t)
    starts = np.append(0, ends[:-1])
    row = np.repeat(np.arange(len(ends)), ends - starts)
    inside = row[: len(least)] == row[t - 1 :]
    least = least[inside]
    if not len(least):
        return none, none, none
    least = np.unique(least & low)  # places in order
    c = least.astype(np.int64)
    at = np.searchsorted(c, ends, "left")
    left, right, k = [], [], keys[c]
    a = 0
    for i, b in enumerate(at.tolist()):
        if b > a:
            x, y = cartesian(k[a:b].tolist(), c[a:b].tolist(), int(starts[i]), int(ends[i]))
            left += x
            right += y
        a = b
    left, right = np.array(left), np.array(right)
    wide = right - left + 1 >= t
    return c[wide], left[wide], right[wide]


def _rows_with_shingles(column: pa.Array):
    """For runs of rows: (first row, shingles of the rows in one array, ends of the rows in it)."""
    for row, counts, words, _, _ in word_blocks(column):
        parts = [s if c >= WIDTH else s[:0] for c, s in zip(counts.tolist(), shingle_rows(counts, words))]
        yield row, np.concatenate(parts) if parts else words[:0], np.cumsum([len(p) for p in parts])


def windows(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """Rows doc_id, th, j, sig, lo, hi: a marked run of t shingles may start from lo to hi."""
    t = words - WIDTH + 1

    def run(batches):
        s = seeds(hashes)
        for b in batches:
            for row, sh, ends in _rows_with_shingles(b.column(2)):
                starts = np.append(0, ends[:-1]) if len(ends) else ends
                for j in range(hashes):
                    c, left, right = compact_windows(sh, ends, t, s[j])
                    if not len(c):
                        continue
                    doc = np.searchsorted(ends, c, "right")
                    base = starts[doc]
                    take = pa.array(doc + row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(c), j, np.int32)),
                            pa.array(mix(sh[c] + np.uint64(j + 1)).view(np.int64)),
                            pa.array((np.maximum(left, c - t + 1) - base).astype(np.int32)), pa.array((np.minimum(right - t + 1, c) - base).astype(np.int32)),
                        ],
                        names=["doc_id", "th", "j", "sig", "lo", "hi"],
                    )

    return docs.mapInArrow(run, "doc_id long, th long, j int, sig long, lo int, hi int")


def candidates(found: DataFrame, words: int, agree: int) -> DataFrame:
    """Rows th, doc_id, runs (array of (a, b) in shingles): where marked windows of ``agree`` hash functions overlap.

    A sweep over each text's window ends counts the hash functions that cover a start. The windows of one function do
    not overlap, so the count is of functions.
    """
    t = words - WIDTH + 1
    ends = F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("x"), F.lit(-1).alias("d")))
    step = found.select("th", "doc_id", F.explode(ends).alias("e")).groupBy("th", "e.x").agg(F.sum("e.d").alias("d"), F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("th").orderBy("x")
    step = step.withColumn("in", F.sum("d").over(order) >= agree).withColumn("next", F.lead("x").over(order))
    fresh = F.when(F.coalesce(F.lag("in").over(order), F.lit(False)), 0).otherwise(1)
    step = step.withColumn("k", F.sum(F.when(F.col("in"), fresh).otherwise(0)).over(order)).where("in")
    step = step.groupBy("th", "k").agg(F.min("doc_id").alias("doc_id"), F.struct(F.min("x").alias("a"), (F.max("next") + (t - 1)).alias("b")).alias("run"))
    return step.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list("run")).alias("runs"))  # runs of one text


def _covered(docs: DataFrame) -> DataFrame:
    """Rows rid, s, pos: the shingles of docs (rid, text, runs) inside the runs."""

    def run(batches):
        for b in batches:
            runs = b.column(2)
            at = np.asarray(runs.offsets)
            lows, highs = (np.asarray(runs.values.field(k)) for k in (0, 1))
            for row, sh, ends in _rows_with_shingles(b.column(1)):
                if not len(sh):
                    continue
                starts = np.append(0, ends[:-1])
                change = np.zeros(len(sh) + 1, np.int64)
                for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                    for k in range(at[row + i], at[row + i + 1]):
                        change[min(s + lows[k], e)] += 1
                        change[min(s + highs[k], e)] -= 1
                hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                doc = np.searchsorted(ends, hit, "right")
                take = pa.array(doc + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array(sh[hit].view(np.int64)), pa.array((hit - starts[doc]).astype(np.int32))], names=["rid", "s", "pos"]
                )

    return docs.mapInArrow(run, "rid long, s long, pos int")


def _islands(rows: DataFrame, keys: list[str], gap: int, name: str) -> DataFrame:
    """rows with a number that grows where pos jumps by more than gap inside a group of keys."""
    order = Window.partitionBy(*keys).orderBy("pos")
    jump = F.when(F.col("pos") - F.lag("pos").over(order) <= gap, 0).otherwise(1)
    return rows.withColumn("_jump", jump).withColumn(name, F.sum("_jump").over(order)).drop("_jump")


def _small(df: DataFrame, *arrays: tuple[str, int]) -> DataFrame:
    """df with a hint for its join by its measured size; arrays: columns of arrays, and the bytes of an element."""
    cells = sum((F.size(c) for c, _ in arrays), F.lit(0))
    rows, cells = df.agg(F.count("*"), F.coalesce(F.sum(cells), F.lit(0))).first()
    fixed = 8 * len(df.columns) + 24 * len(arrays)
    return broadcast_if_small(df, rows, fixed + -(-cells * max([n for _, n in arrays], default=0) // max(rows, 1)))


def _held(rest: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (rid, island, partner, pos, n): places of rest that the documents asked hold, n of them in the island.

    rows: (rid, s), whose shingles are in rest. The holders are staged, so that Spark can split a join on a frequent shingle.
    """
    names = _small(stage(asked.select("partner").distinct(), "names"))
    holders = stage(rows.join(names, rows["rid"] == F.col("partner")).select("partner", "s").distinct(), "holders").hint("merge")
    held = rest.select("rid", "island", "pos", "s").join(_small(asked), ["rid", "island"]).join(holders, ["partner", "s"]).select("rid", "island", "partner", "pos")
    return stage(held.withColumn("n", F.count("*").over(Window.partitionBy("rid", "island", "partner"))), "held")


def _by_partner(rows: DataFrame, rest: DataFrame, spans: DataFrame, t: int, gap: int) -> DataFrame:
    """Rows (rid, island, partner, pos, sub) of the islands in rest (rid, island, pos, s, first, last), spans (rid, island, a, b)."""
    ask = lambda rest, c: rest.where(F.col(c) != F.col("rid")).select("rid", "island", F.col(c).alias("partner")).distinct()
    enough = F.col("n") >= F.lit(SHARE) * (F.col("b") - F.col("a") + 1)
    good = lambda held: held.select("rid", "island", "partner", "n").distinct().join(spans, ["rid", "island"]).where(enough)
    first = _held(rest, rows, stage(ask(rest, "first"), "asked"))
    found = stage(good(first), "good")
    left = stage(rest.join(found.select("rid", "island").distinct(), ["rid", "island"], "left_anti"), "left")
    last = _held(left, rows, stage(ask(left, "last").join(ask(left, "first"), ["rid", "island", "partner"], "left_anti"), "asked"))
    more = stage(good(last), "good")
    stars = found.union(more).groupBy("partner").agg(F.min("rid").alias("low"))
    again = more.select("rid", "island", "partner").union(left.select("rid", "island", F.col("rid").alias("partner")).distinct())
    again = again.join(stars, "partner").where("low < rid").select("rid", "island", F.col("low").alias("partner")).distinct()
    second = _held(left, rows, stage(again.join(more, ["rid", "island", "partner"], "left_anti"), "again"))
    found = found.unionByName(more).unionByName(good(second))
    # the document before that holds most; if only later ones hold it, the passage is first here
    before = F.when(F.col("partner") < F.col("rid"), F.struct("n", -F.col("partner")))
    chosen = found.groupBy("rid", "island").agg((-F.max(before)["col2"]).alias("p")).select("rid", "island", F.coalesce("p", "rid").alias("p"))
    chosen = stage(chosen, "chosen")
    whole = rest.join(chosen, ["rid", "island"]).select("rid", "island", F.col("p").alias("partner"), "pos", F.lit(0).cast("long").alias("sub"))
    parts = first.union(last).drop("n").union(rest.where("first = rid").select("rid", "island", F.col("rid").alias("partner"), "pos"))
    parts = _islands(parts.join(chosen, ["rid", "island"], "left_anti").where("partner <= rid"), ["rid", "island", "partner"], gap, "sub")
    one = Window.partitionBy("rid", "island", "partner", "sub")
    n, span = F.count("*").over(one), F.max("pos").over(one) - F.min("pos").over(one) + 1
    parts = parts.withColumn("_ok", (n >= F.lit(SHARE) * t) & (n >= F.lit(SHARE) * span)).where("_ok")
    return whole.union(parts.select("rid", "island", "partner", "pos", "sub"))


def repeated(docs: DataFrame, words: int = WORDS, hashes: int = HASHES, agree: int = AGREE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Places of repeated passages; all results are staged in the caller's scope.

    Copies of a text are one here, under their smallest doc_id. The results: places (rid, pos, first, island), with first the
    rid of the document that holds the shingle first; passages of one clear representative (rid, island, partner, a, b); places
    of the others (rid, island, partner, pos, sub), a passage for each sub; and documents (rid, doc_id, th), with rid a number
    in the order of doc_id.
    """
    t = words - WIDTH + 1
    gap = int((1 - SHARE) * t) + 1
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), "text")
    with scratch(docs.sparkSession):  # windows are the largest table, and go once runs are known
        all_ = stage(windows(texts, words, hashes), "windows")
        sigs = all_.groupBy("sig").agg(F.min("th").alias("a"), F.max("th").alias("b"))
        sigs = stage(sigs.where("a < b").select("sig"), "sigs")
        # copies of a text have the same windows
        marked = all_.join(_small(sigs), "sig", "left_semi").groupBy("th", "j", "lo", "hi").agg(F.min("doc_id").alias("doc_id"))
        runs = keep(ranked(candidates(marked, words, agree), ["doc_id", "th"], "rid"), "runs")
    rows = stage(_covered(texts.join(_small(runs, ("runs", 32)), ["doc_id", "th"]).select("rid", "text", "runs")), "rows")
    hubs = stage(rows.groupBy("s").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last"), "hubs")
    # shingles do not travel on with their places: the few that are asked for again come from rows
    at = rows.join(hubs.select("s", "first").hint("merge"), "s").select("rid", "pos", "first").repartition(partitions(docs.sparkSession), "rid").dropDuplicates(["rid", "pos"])
    order = Window.partitionBy("rid").orderBy("pos")
    dense = F.count("*").over(order.rangeBetween(-(t - 1), 0)) >= F.lit(SHARE) * t
    at = at.withColumn("_dense", dense).withColumn("_in", F.max("_dense").over(order.rangeBetween(0, t - 1))).where("_in").drop("_dense", "_in")
    found = stage(_islands(at, ["rid"], gap, "island"), "found")

    by_first = found.groupBy("rid", "island", "first").agg(F.count("*").alias("c"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    best = F.max_by("first", F.struct("c", -F.col("first"))).alias("partner")
    spans = by_first.groupBy("rid", "island").agg(best, F.max("c").alias("c"), F.min("a").alias("a"), F.max("b").alias("b"))
    spans = stage(spans.withColumn("sure", F.col("c") >= F.lit(SHARE) * (F.col("b") - F.col("a") + 1)), "spans")
    other = stage(spans.where("NOT sure").select("rid", "island", "a", "b"), "other")
    rest = found.join(_small(other.select("rid", "island")), ["rid", "island"]).select("rid", "island", "pos", "first")
    of = rows.join(_small(stage(other.select("rid").distinct(), "of")), "rid", "left_semi")
    rest = stage(rest.join(of.hint("merge"), ["rid", "pos"]).select("rid", "island", "pos", "s", "first").dropDuplicates(["rid", "pos"]), "rest")
    wanted = stage(rest.select("s").distinct(), "wanted").hint("merge")  # all sides grow with the corpus
    rest = stage(rest.join(stage(hubs.join(wanted, "s").select("s", "last"), "ends").hint("merge"), "s"), "rest")
    held = stage(rows.join(wanted, "s", "left_semi").select("rid", "s"), "held")
    places = stage(_by_partner(held, rest, other, t, gap), "places")
    return found, spans.where("sure").select("rid", "island", "partner", "a", "b"), places, runs.select("rid", "doc_id", "th")


def copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows doc_id, th, n_words, first_doc of texts of ``words`` words or more that two or more doc_ids have."""
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), "text")
    groups = texts.groupBy("th").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("far")).where("first_doc < far").select("th", "first_doc")
    groups = stage(groups, "copies")
    # words are counted in one text of each group
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words")
    once = texts.join(_small(groups), "th").where("doc_id = first_doc").select("th", "first_doc", n).distinct().where(F.col("n_words") >= words)
    return texts.select("doc_id", "th").join(_small(stage(once, "once")), "th").distinct()


def passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows doc_id, start_word, end_word, first_doc, is_first: the repeated passages of each document.

    first_doc is the representative: a document that holds four fifths or more of the passage's shingles, the passage's own
    document where it is_first. A text that several documents have whole is one passage of each; passages that its parts
    share with other texts are given for the smallest of these documents.
    """
    with scratch(docs.sparkSession):
        whole = copies(docs, words).select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), "first_doc", (F.col("doc_id") == F.col("first_doc")).alias("is_first"))
        _, clear, places, names = repeated(docs, words)
        places = places.groupBy("rid", "island", "partner", "sub").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
        found = clear.drop("island").union(places.select("rid", "partner", "a", "b")).select("rid", "partner", F.col("a").alias("start_word"), (F.col("b") + WIDTH).alias("end_word"))
        firsts = names.select(F.col("rid").alias("partner"), F.col("doc_id").alias("first_doc"))
        found = found.join(names.select("rid", "doc_id"), "rid").join(firsts, "partner")
        return keep(found.select("doc_id", "start_word", "end_word", "first_doc", (F.col("rid") == F.col("partner")).alias("is_first")).union(whole), "passages")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def remove_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with every repeat of a passage cut out but its first occurrence; documents left without a word go.

    Words of a shingle whose first occurrence is here stay, so that each passage survives once. Other columns are
    unchanged, but for n_chars, which is counted anew where text was cut.
    """
    names = [f"_k{i}" for i in range(len(docs.columns))]
    at, columns, kinds = docs.columns.index("text"), docs.columns, docs.schema
    # inside, columns have names of their own, and those of docs cannot clash with any
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(columns, names)], F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_th"))

    with scratch(docs.sparkSession):
        later = copies(docs, words).where("doc_id <> first_doc").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"))
        later = stage(later, "later")
        if not later.isEmpty():
            plain = keep(plain.join(_small(later), ["_doc", "_th"], "left_anti"), "docs")
        found, clear, places, runs = repeated(plain.select(F.col("_doc").alias("doc_id"), F.col(names[at]).alias("text")), words)
        # a clear passage of another document is cut but for shingles that come first here
        later = stage(clear.where("partner <> rid").select("rid", "island"))
        gone = found.join(_small(later), ["rid", "island"], "left_semi").where("first <> rid").select("rid", "pos")
        gone = stage(gone.union(places.where("partner <> rid").select("rid", "pos")), "gone")
        here = found.join(_small(stage(gone.select("rid").distinct())), "rid", "left_semi").where("first = rid")
        cut = gone.select("rid", F.col("pos").alias("_c"), F.lit(None).cast("int").alias("_k")).union(here.select("rid", F.lit(None).cast("int"), "pos"))
        cut = cut.groupBy("rid").agg(F.collect_set("_c").alias("_cut"), F.collect_set("_k").alias("_keep"))  # places of one document
        cut = keep(cut.join(runs, "rid").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "_cut", "_keep"), "cut")
        joined = plain.join(_small(cut, ("_cut", 4), ("_keep", 4)), ["_doc", "_th"], "left")
    back = [F.col(a).alias(c) for c, a in zip(columns, names)]
    same = joined.where("_cut IS NULL").select(*back)

    def run(batches):
        for b in batches:
            cuts, keeps = b.column(len(names)), b.column(len(names) + 1)
            texts = b.column(at).to_pylist()
            for row, counts, _, first, last in word_blocks(b.column(at)):
                w = 0
                for i, c in enumerate(counts.tolist(), row):
                    gone = np.zeros(c + WIDTH + GAP, bool)
                    p = np.sort(np.asarray(cuts[i].as_py(), np.int64))
                    for k in range(WIDTH):
                        gone[p + k] = True
                    for x in np.flatnonzero((np.diff(p) > WIDTH) & (np.diff(p) <= GAP)).tolist():
                        gone[p[x] : p[x + 1]] = True  # a changed word between
                    q = np.asarray(keeps[i].as_py(), np.int64)
                    for k in range(WIDTH):
                        gone[q + k] = False
                    raw, parts, last_end = texts[i].encode(), [], 0
                    a, gone = first[w : w + c].tolist(), gone[:c]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        parts.append(raw[last_end : a[x]])
                        last_end = a[y] if y < c else len(raw)
                    parts.append(raw[last_end:])
                    texts[i] = b"".join(parts).decode()
                    w += c
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    touched = joined.where("_cut IS NOT NULL").select(*names, "_cut", "_keep")
    out = ", ".join(f"{a} {f.dataType.simpleString()}" for a, f in zip(names, kinds))
    new = touched.mapInArrow(run, out).where(F.col(names[at]).rlike(r"[^\x20\x09-\x0D]")).select(*back)
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.length("text").cast(kinds["n_chars"].dataType))
    return same.union(new)
