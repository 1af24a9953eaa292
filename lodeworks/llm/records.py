"""Token output as length-delimited binary records with a separate offset index.

A record is

    u64 length of the payload | u32 masked checksum of the length | payload | u32 masked checksum of the payload

all little-endian; the payload is i64 doc_id, u32 width of an id in bytes (2 or 4), then the ids. A checksum is CRC-32
(zlib), masked by rotating it right by 15 bits and adding a constant, so that a checksum of data that holds checksums
stays sound. Files hold the documents in ascending doc_id order: a range shuffle gives each task a range, and the task
writes files of about ``file_bytes``, each under a name of its own attempt. The index (Parquet: file, doc_id, offset,
first token, number of tokens) is written by Spark and names the files that count; files of lost attempts are not in it.

Files are opened with pyarrow's file systems, so the folder may be local, HDFS or an object store.

Defined cases: a null text gives the end id alone; rows of equal doc_id are ordered by text, equal rows are all kept; a
null doc_id sorts first and is stored as the smallest long; an empty table gives an empty index; columns beside doc_id and
text are ignored, and may have any name; a very long text is one record.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch_path
from .tokens import END, default_tokenizer, word_encoder

# The mask of the checksum.
MASK_SHIFT, MASK_ADD = 15, 0xA282EAD8
NO_ID = -(1 << 63)
# Layouts of a record's head, checksum and payload.
HEAD, TAIL, FIRST = "<QI", "<I", "<qI"
HEAD_BYTES, TAIL_BYTES, FIRST_BYTES = (struct.calcsize(x) for x in (HEAD, TAIL, FIRST))


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> MASK_SHIFT) | (c << (32 - MASK_SHIFT))) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(TAIL, masked(size)) + payload + struct.pack(TAIL, masked(payload))


def read_record(f) -> tuple[int, np.ndarray]:
    """(doc_id, ids) of the record at the file's place; raises ValueError if it is damaged."""
    head = f.read(HEAD_BYTES)
    if len(head) < HEAD_BYTES:
        raise ValueError("record cut short")
    size, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("length does not match its checksum")
    payload, tail = f.read(size), f.read(TAIL_BYTES)
    if len(payload) < size or len(tail) < TAIL_BYTES or struct.unpack(TAIL, tail)[0] != masked(payload):
        raise ValueError("payload does not match its checksum")
    doc_id, width = struct.unpack_from(FIRST, payload)
    return doc_id, np.frombuffer(payload, {2: "<u2", 4: "<u4"}[width], offset=FIRST_BYTES).astype("<u4")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode docs (doc_id, text) into records below folder; returns the index, read from ``folder/index``.

    Index rows: part, row (place in the part), file, doc_id, offset, first (tokens before it in the part), n_tokens.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()

    def write(batches):
        encoder, store = word_encoder(tokenizer), None
        sink = name = None
        at = row = first = 0
        for b in batches:
            if store is None:
                store, root = _open(folder)
                store.create_dir(f"{root}/data", recursive=True)
            ids, texts = b.column(1).fill_null(NO_ID).to_pylist(), b.column(2).to_pylist()
            part = b.column(0)
            out = {k: [] for k in ("part", "row", "file", "doc_id", "offset", "first", "n_tokens")}
            for i in range(0, len(ids), 256):
                for doc_id, where, raw in zip(ids[i : i + 256], part[i : i + 256].to_pylist(), encoder.ids(texts[i : i + 256])):
                    if sink is None or at >= file_bytes:
                        if sink is not None:
                            sink.close()
                        name, at = f"data/{where:06d}-{uuid.uuid4().hex}.rec", 0
                        sink = store.open_output_stream(f"{root}/{name}")
                    tokens = np.append(np.frombuffer(raw, "<u4"), np.uint32(END))
                    width = 2 if int(tokens.max()) < 1 << 16 else 4
                    data = frame(struct.pack(FIRST, doc_id, width) + tokens.astype(f"<u{width}").tobytes())
                    sink.write(data)
                    for k, v in zip(out, (where, row, name, doc_id, at, first, len(tokens))):
                        out[k].append(v)
                    at, row, first = at + len(data), row + 1, first + len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "file" else pa.int32() if k == "part" else pa.int64()) for k, v in out.items()], names=list(out))
        if sink is not None:
            sink.close()

    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h"))
    placed = placed.repartitionByRange(partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "text")
    placed = placed.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kinds = "part int, row long, file string, doc_id long, offset long, first long, n_tokens long"
    placed.mapInArrow(write, kinds).write.parquet(f"{folder}/index")
    return spark.read.schema(kinds).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: tokens of all documents before the row. Parts are few: one row each is summed in order."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return index.join(F.broadcast(parts), "part").withColumn("start", F.col("_base") + F.col("first")).drop("_base")


def read_records(index: DataFrame, folder: str, as_given: bool = False, held: int = 32) -> DataFrame:
    """Read the records that index rows (file, offset, start) name; verifies both checksums.

    Rows are dealt by file and read in file order, or, if ``as_given``, as they lie in the index's partitions: a shuffled
    index gives a shuffled read. A task holds up to ``held`` files open. Returns doc_id, start, n_tokens, ids_crc32 (of the
    ids as unsigned 32-bit) and ids (binary, unsigned 32-bit).
    """

    def read(batches):
        files, store = OrderedDict(), None
        for b in batches:
            if store is None:
                store, root = _open(folder)
            out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
            for name, offset, start in zip(*(c.to_pylist() for c in b.columns)):
                if name not in files:
                    if len(files) >= held:
                        files.popitem(last=False)[1].close()
                    files[name] = store.open_input_file(f"{root}/{name}")
                files.move_to_end(name)
                f = files[name]
                f.seek(offset)
                doc_id, ids = read_record(f)
                raw = ids.tobytes()
                for k, v in zip(out, (None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(raw), raw)):
                    out[k].append(v)
                if len(out["ids"]) >= 256:
                    yield _batch(out)
                    out = {k: [] for k in out}
            yield _batch(out)
        for f in files.values():
            f.close()

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    # a file's records go to one task in file order; a file is bounded in size, unlike a part of the index
    rows = index.select("file", "offset", "start")
    if not as_given:
        rows = rows.repartition(partitions(index.sparkSession), "file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3_binary_records(spark, sf_dir: str) -> DataFrame:
    """Write all documents as records, then read them back through the index. The files stay: they are the output."""
    folder = scratch_path(spark, "records")
    index = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_records(with_starts(index), folder).drop("ids")
