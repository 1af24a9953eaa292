"""Sharding: proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their source and ranked; a row's fractional rank is (2 * rank + 1) / (2 * rows
of the source). Sorting all rows by it interleaves the sources in proportion, and equal cuts of that order give shards
whose counts differ by one at most (law ``rows``) and whose mixtures match the whole. Both orders are range shuffles of
narrow rows (no texts), so a source with a third of the rows is cut into ranges like any other.

Defined cases: a null source is a source of its own; a null text has size 16 and the checksum of nothing; equal rows
keep separate places; fewer rows than shards leave some shards empty; an empty table gives no rows; columns beside those
named are ignored, and may have any name; of a very long text only its size and checksums travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import partitions, ranked, scratch, stage


def shard(docs: DataFrame, n_shards: int, seed: int = 17, source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, size, text_crc32, source, shard, slot) of docs (doc_id, text, source), and docs' columns ``keep``."""
    with scratch(docs.sparkSession):
        return common.keep(_shard(docs, n_shards, seed, source, keep), "shards")


def _shard(docs: DataFrame, n_shards: int, seed: int, source: str, keep: tuple[str, ...]) -> DataFrame:
    text, held = F.coalesce(F.col("text"), F.lit("")), [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("_s"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("_h"),
        *[F.col(f"`{c}`").alias(a) for c, a in zip(keep, held)],
    )
    rows = ranked(rows, ["_s", "_h", "doc_id"], "_place")
    sources = stage(rows.groupBy("_s").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")), "sources")
    total = sources.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = rows.join(sources, "_s").withColumn("_f", (2 * (F.col("_place") - F.col("_first")) + 1) / (2 * F.col("_n")))
    rows = ranked(rows.drop("_place", "_first", "_n"), ["_f", "_s", "_h", "doc_id"], "_place")
    rows = rows.withColumn("shard", F.expr(f"(_place * {n_shards}L) div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return rows.select(
        "doc_id", "size", "text_crc32", F.expr("IF(_s = 'n', NULL, substring(_s, 2))").alias("source"), "shard", (F.col("_place") - first).alias("slot"),
        *[F.col(a).alias(c) for c, a in zip(keep, held)],
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 17, file_bytes: int = 128 << 20) -> tuple[str, str]:
    """Write docs as Parquet in folders shard=k, in slot order; returns the names of the columns of shard and slot.

    Rows are numbered, and joined to places by number. A task writes a range of slots of about ``file_bytes``, so a shard is
    many files, which follow one another by name. Where docs has a column ``shard`` or ``slot``, the new one gets a ``_``.
    """

    def free(name: str) -> str:
        return free(f"{name}_") if name in {c.lower() for c in docs.columns} else name

    names = free("shard"), free("slot")
    with scratch(docs.sparkSession):
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
        docs = stage(docs.select("doc_id", "text", "source", row, F.monotonically_increasing_id().alias("row")), "numbered")
        places = stage(_shard(docs, n_shards, seed, "source", ("row",)).select("row", "shard", "slot", "size"), "places")
        size = places.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        places = places.select("row", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
        joined = docs.select("row", "d").join(places, "row").repartitionByRange(max(partitions(docs.sparkSession), -(-size // file_bytes)), *names)
        out = joined.sortWithinPartitions(*names).select("d.*", *names)
        out.write.partitionBy(names[0]).parquet(path)
    return names


def op7_sharding(spark, sf_dir: str, n_shards: int = 40) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return shard(docs, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
