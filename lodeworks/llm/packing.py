"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are ranked by length and dealt in turn into blocks of about ``block`` pieces, so that each block has the mix of the
whole, whatever the order of the input. Each block is worked on by several islands, one task row each: an island breeds
packings in which a gene is a whole sequence. Crossover injects well-filled sequences of one parent into the other, drops
sequences that hold the same pieces twice, and best-fits the pieces set free. After an epoch every island's elite moves to
the next island of the ring, and a second epoch follows; the best packing of a block's islands counts. Sequences that are
under ``FULL`` go back to a common pool, which is packed again, until the sequences are as few as the tokens allow, one
block holds the pool, or ``STUCK`` rounds in turn have hardly shortened it. There are so few blocks that they hold
``LEAST_FULL`` sequences on average: where pieces are short, blocks have more of them.

Defined cases: a null or empty text has the end id alone; a document is cut only where it is longer than a sequence;
equal rows are packed separately; an empty table gives no rows; columns beside doc_id and text are ignored,
and may have any name; a very long text is read whole by one call of the tokenizer, and then cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ranked, scratch, stage
from .tokens import END, default_tokenizer, word_encoder

LENGTH, BLOCK, ISLANDS = 4096, 2048, 3
PARENTS, OFFSPRING, WELL_FILLED = 4, 6, 0.99
#: Sequences that a block's tokens fill on average at least, if there are several blocks; over 1, or packing may not end.
LEAST_FULL = 4
#: From this share a sequence stays as it is; rounds that may leave over ``SHRINK`` of the pool's tokens before packing ends.
FULL, SHRINK, STUCK = 0.995, 0.9, 2
#: Bytes of texts that are made Python strings at once.
SLICE = 1 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut every ``length`` ids."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches):
        encoder, end = word_encoder(tokenizer), np.array([END], "<u4").tobytes()
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            names = b.column(0).to_pylist()
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                for name, raw in zip(names[i:j], encoder.ids(b.column(1)[i:j].to_pylist())):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * length)):
                        part = raw[at : at + 4 * length]
                        for c, v in zip(out, (name, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in out.items()], names=list(out))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def best_fit(sizes: np.ndarray, items, bins: list[list[int]], length: int) -> list[list[int]]:
    """bins with items added in the order given, each where it leaves least room."""
    size, wide = sizes.tolist(), 1 << 20
    room = sorted((length - sum(size[i] for i in b)) * wide + k for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, size[i] * wide)
        if at == len(room):
            bins.append([i])
            insort(room, (length - size[i]) * wide + len(bins) - 1)
        else:
            free, k = divmod(room.pop(at), wide)
            bins[k].append(i)
            insort(room, (free - size[i]) * wide + k)
    return bins


def fitness(sizes: np.ndarray, bins: list[list[int]], length: int) -> tuple[int, float]:
    """Fewer bins are fitter, then bins filled unevenly."""
    size = sizes.tolist()
    return -len(bins), sum((sum(size[i] for i in b) / length) ** 2 for b in bins)


def crossover(sizes: np.ndarray, a: list[list[int]], b: list[list[int]], rng: np.random.Generator, length: int) -> list[list[int]]:
    """a with about half of b's well-filled bins injected whole; what that displaces is best-fitted, largest first."""
    size = sizes.tolist()
    good = [g for g in b if sum(size[i] for i in g) >= WELL_FILLED * length]
    take = [g for g in good if rng.random() < 0.5]
    held = {i for g in take for i in g}
    kept = [g for g in a if held.isdisjoint(g)]
    free = sorted((i for g in a if not held.isdisjoint(g) for i in g if i not in held), key=lambda i: -size[i])
    return best_fit(sizes, free, [list(g) for g in take + kept], length)


def evolve(sizes: np.ndarray, seed: int, start: list[list[list[int]]], length: int) -> list[list[int]]:
    """The fittest packing after one epoch from the packings ``start`` and random ones; stops at the lower bound."""
    least, rng = -(-int(sizes.sum()) // length), np.random.default_rng(seed)
    order = np.argsort(-sizes, kind="stable").tolist()
    pool = start or [best_fit(sizes, order, [], length)]
    best = max(pool, key=lambda p: fitness(sizes, p, length))
    if len(best) <= least:
        return best
    while len(pool) < PARENTS:
        near = np.argsort(-sizes * rng.uniform(0.8, 1.0, len(sizes)), kind="stable").tolist()
        pool.append(best_fit(sizes, near, [], length))
    for _ in range(OFFSPRING):
        i, j = rng.choice(len(pool), 2, replace=False)
        pool.append(crossover(sizes, pool[i], pool[j], rng, length))
        pool.sort(key=lambda p: fitness(sizes, p, length), reverse=True)
        pool.pop()
        if len(pool[0]) <= least:
            break
    return pool[0]


def _bins(assigned) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(assigned):
        out.setdefault(int(b), []).append(i)
    return list(out.values())


def _assigned(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def block_count(n: int, total: int, block: int, length: int) -> int:
    """Blocks for n pieces of ``total`` tokens: of ``block`` pieces at most, or of more if those are too few tokens."""
    return max(1, min(-(-n // block), total // (LEAST_FULL * length)))


def _round(pool: DataFrame, blocks: int, islands: int, length: int, seed: int) -> DataFrame:
    """pool with columns b, bin, offset and fill, the tokens of the row's bin."""
    item = F.struct(F.col("length"), "uid", "doc_id", "piece", "start", "ids_crc32")
    dealt = ranked(pool, ["length", "uid"], "_rank").withColumn("b", F.pmod("_rank", F.lit(blocks)))
    held = stage(dealt.groupBy("b").agg(F.sort_array(F.collect_list(item), asc=False).alias("items")), "blocks")  # a block's pieces
    kind = "b long, island int, sizes array<long>, elite array<int>"

    def epoch(k: int):
        def run(frames):
            for f in frames:
                rows = []
                for b, island, sizes, own, guest in zip(f["b"], f["island"], f["sizes"], f["elite"], f["guest"]):
                    sizes = np.asarray(sizes)
                    start = [_bins(x) for x in (own, guest) if x is not None]
                    rows.append((b, island, sizes, _assigned(evolve(sizes, seed + 1009 * int(b) + 17 * int(island) + k, start, length), len(sizes))))
                yield pd.DataFrame(rows, columns=["b", "island", "sizes", "elite"])

        return run

    none = F.lit(None).cast("array<int>")
    tasks = held.select("b", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").alias("sizes"), none.alias("elite"), none.alias("guest"))
    first = tasks.repartition("b", "island").mapInPandas(epoch(0), kind)
    ring = Window.partitionBy("b").orderBy("island")  # a row for each island
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = first.withColumn("guest", F.coalesce(F.lag("elite").over(ring), F.last("elite").over(whole)))
    second = moved.repartition("b", "island").mapInPandas(epoch(1), kind)
    used = F.size(F.array_distinct("elite"))
    best = second.groupBy("b").agg(F.min_by("elite", F.struct(used, "island")).alias("elite"))
    rows = held.join(best, "b").select("b", F.posexplode(F.arrays_zip("items", "elite")).alias("at", "x"))
    rows = rows.select("b", F.col("x.elite").alias("bin"), "at", "x.items.*")
    rows = rows.withColumn("offset", F.sum("length").over(Window.partitionBy("b", "bin").orderBy("at")) - F.col("length"))
    return rows.withColumn("fill", F.sum("length").over(Window.partitionBy("b", "bin")))


def pack(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, islands: int = ISLANDS, seed: int = 11, tokenizer: str | None = None) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset for docs (doc_id, text)."""
    with scratch(docs.sparkSession):
        return keep(_packed(docs, length, block, islands, seed, tokenizer), "packed")


def _packed(docs: DataFrame, length: int, block: int, islands: int, seed: int, tokenizer: str | None) -> DataFrame:
    cut = stage(pieces(docs, length, tokenizer), "pieces")
    cut = stage(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") == length).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool, done, turn, stuck, before = cut.where(F.col("length") < length), [full], 0, 0, None
    while True:
        pool = stage(pool.select(*columns, F.monotonically_increasing_id().alias("uid")), "pool")
        n, total = pool.agg(F.count("*"), F.sum("length")).first()
        if n == 0:
            break
        stuck = stuck + 1 if before and total > SHRINK * before else 0
        blocks, before = block_count(n, total, block << stuck, length), total
        solved = stage(_round(pool, blocks, islands, length, seed + turn), "solved")
        used = solved.select("b", "bin").distinct().count()
        number = (F.lit(turn) * (1 << 50) + F.col("b") * (1 << 22) + F.col("bin")).cast("long")
        last = blocks == 1 or used <= -(-total // length) or stuck >= STUCK
        done.append((solved if last else solved.where(F.col("fill") >= FULL * length)).select(*columns, number.alias("sequence_id"), "offset"))
        if last:
            break
        pool, turn = solved.where(F.col("fill") < FULL * length), turn + 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
