"""Cross-tokenizer alignment with an identity-map fast path.

Texts are encoded by two tokenizers, A (byte-level BPE) and B (SentencePiece); byte offsets at which tokens of both end cut
them into groups, and two tokens are linked where their byte ranges overlap. Tables of the two vocabularies are precomputed:
each id's bytes, and for each A id the B id of the same bytes. A group of one token each, of the same bytes by that map, is
counted in a vector as long as A's vocabulary; only links of other groups become rows and are shuffled by pair.

A task works on blocks of about ``BLOCK`` bytes of texts, with numpy over a block's offsets, and writes a row a block: what
is known of its documents, its distinct pairs, and by document how often each of them occurs. Pairs of ``PART`` blocks are
counted together, summed over the corpus in one shuffle by pair, and what a part needs comes back to it by a join, so the
pairs of a document never travel one by one. The best count of each B id has a row an id, as the vectors have: both are
bounded by the vocabularies, and broadcast.

Defined cases: texts that are null, empty, or not the tokens' bytes joined (as with U+2581, which B takes for a space) have
no tokens, zeros and an empty digest; equal rows count each; an empty table gives no rows; columns beside doc_id and text are
ignored, and may have any name; special tokens' strings are plain text; very long texts are read whole and are a block each.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import scratch, stage

#: Bytes of text in a block, and blocks whose pairs are counted together. Neither changes a result.
BLOCK, PART = 2 << 20, 8
# How byte-level BPE splits a text.
RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with longer runs go to the library, whose search does not slow down on them.
_RUNS = re.compile(r"\S{400}|\s{400}")
_PIECE_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Tokens:
    """The two tokenizers and tables of their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spec = json.load(open(a_path, encoding="utf-8"))
        # byte-level vocabularies write a byte as a character: printable ones as themselves, others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain]
        back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
        assert set(back) == set(pre_tokenizers.ByteLevel.alphabet())
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [b""] * (max(vocab) + 1)
        for i, t in vocab.items():
            self.a_bytes[i] = t.encode() if i in special else bytes(back[c] for c in t)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        known = {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if not self.b.is_byte(i)} | {}
        for i in range(len(self.b_bytes)):
            known.setdefault(self.b_bytes[i], i)
        #: For each A id the B id of the same bytes, -1 without one.
        self.same = np.array([known.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"]["".join(m)] for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        self.fast = None
        # where ids grow with the rank of merges, a faster encoder of the same vocabulary gives the same ids
        if (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
            and not spec["model"].get("ignore_merges") and made == sorted(set(made)) and len(made) + 256 == len(spec["model"]["vocab"]) - len(special & set(spec["model"]["vocab"].values()))
        ):
            ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
            self.fast = tiktoken.Encoding("a", pat_str=RULE, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        byte = _PIECE_BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.fast and _latin(t) and not _RUNS.search(t):
                out[i] = self.fast.encode_ordinary(t)
            else:
                slow.append(i)
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        for i, e in zip(slow, encode([texts[i] for i in slow], add_special_tokens=False) if slow else ()):
            out[i] = e.ids
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def tokens(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


@lru_cache(maxsize=2)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, right-aligned after zeros, and their numbers."""
    width = len(str(n))
    table = np.zeros((n, width), np.uint8)
    for i in range(n):
        s = str(i).encode()
        table[i, width - len(s) :] = list(s)
    return table, (table > 0).sum(1)


def align_block(texts: list[str | None], t: Tokens) -> dict[str, np.ndarray | list]:
    """What is known of a block's documents: counts and digests, links of irregular groups by document as places among the
    block's distinct pairs, and identity groups by document as A ids."""
    docs = [i for i, x in enumerate(texts) if x]
    ids_a = t.encode_a([" " + texts[i] for i in docs])
    ids_b = t.b.encode([texts[i] for i in docs], num_threads=1) if docs else []
    good = []
    for k, i in enumerate(docs):
        raw = b" " + texts[i].encode()
        if raw == b"".join(map(t.a_bytes.__getitem__, ids_a[k])) and raw == b"".join(map(t.b_bytes.__getitem__, ids_b[k])):
            good.append(k)
    out = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    none = np.empty(0, np.int64)
    empty = {"sha": [""] * len(texts), "pairs": none, "pair_n": none, "d_row": none, "d_at": none, "d_n": none, "i_row": none, "i_id": none, "i_n": none}
    if not good:
        return out | empty
    at = np.array([docs[k] for k in good])
    na, nb = (np.array([len(ids[k]) for k in good]) for ids in (ids_a, ids_b))
    a, b = (np.fromiter((x for k in good for x in ids[k]), np.int64, n.sum()) for ids, n in ((ids_a, na), (ids_b, nb)))
    end_a, end_b = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])
    is_a, is_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
    is_a[end_a], is_b[end_b] = True, True
    both = is_a & is_b
    # a link for each stretch between ends; counts of ends before it name its tokens and its group
    u = np.flatnonzero(is_a | is_b)
    before = lambda mark, where: np.cumsum(mark, dtype=np.int32)[where] - mark[where]
    la, lb, lg = before(is_a, u), before(is_b, u), before(both, u)
    ga, gb = lg[is_a[u]], lg[is_b[u]]
    size_a, size_b = np.bincount(ga), np.bincount(gb)
    first = np.cumsum(na) - na
    doc_end = end_a[np.cumsum(na) - 1]
    doc = np.searchsorted(doc_end, u)
    out["n_a"][at], out["n_b"][at] = na, nb
    out["n_links"][at] = np.bincount(doc, minlength=len(at))
    out["n_groups"][at] = np.bincount(doc[both[u]], minlength=len(at))
    pa_, pb = a[la], b[lb]
    plain = (size_a[lg] == 1) & (size_b[lg] == 1) & (t.same[pa_] == pb)
    odd = ~plain
    pairs, place = np.unique(pa_[odd] << 32 | pb[odd], return_inverse=True)
    d, d_n = np.unique(doc[odd] << 32 | place, return_counts=True)
    i, i_n = np.unique(doc[plain] << 32 | pa_[plain], return_counts=True)
    # the text of the groups: A ids, then B ids of each
    order = np.empty(len(a) + len(b), np.int64)
    sign = np.full(len(order), 44, np.uint8)
    where_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[ga]
    where_b = np.arange(len(b)) + np.cumsum(size_a)[gb]
    order[where_a], order[where_b] = a, b
    sign[where_a[both[end_a]]], sign[where_b[both[end_b]]] = 124, 59
    table, width = _digits(max(len(t.a_len), len(t.b_len)))
    cells = np.c_[table[order], sign]
    text = cells[cells > 0]
    stops = np.cumsum(width[order] + 1)[np.cumsum(na + nb) - 1].tolist()
    view, sha = memoryview(text), [""] * len(texts)
    for k, lo, hi in zip(at.tolist(), [0, *stops[:-1]], stops):
        sha[k] = hashlib.sha256(view[lo : hi - 1]).hexdigest()
    low = (1 << 32) - 1
    return out | {
        "sha": sha, "pairs": pairs, "pair_n": np.bincount(place, minlength=len(pairs)), "d_row": at[d >> 32], "d_at": d & low, "d_n": d_n, "i_row": at[i >> 32], "i_id": i & low, "i_n": i_n,
    }


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_PACKED = {"pairs": "<i8", "pair_n": "<i4", "d_row": "<i4", "d_at": "<i4", "d_n": "<i4", "i_row": "<i4", "i_id": "<i4", "i_n": "<i4"}


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a block: part, doc_ids, counts and digests by document, and packed arrays of its pairs."""

    def run(batches):
        t, made = tokens(a_path, b_path), 0
        for b in batches:
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            group = (np.cumsum(size) - size) // BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)] if len(size) else []
            for lo, hi in zip(cuts, cuts[1:]):
                part = b.slice(lo, hi - lo)
                x = align_block(part.column(1).to_pylist(), t)
                row = {"part": [(TaskContext.get().partitionId() << 32) + made // PART], "doc_ids": [part.column(0).to_pylist()], "sha": [x["sha"]]}
                row |= {c: [x[c]] for c in _COUNTS} | {c: [x[c].astype(k).tobytes()] for c, k in _PACKED.items()}
                made += 1
                yield pa.RecordBatch.from_pydict(row, schema=kind)

    longs = pa.list_(pa.int64())
    kind = pa.schema([("part", pa.int64()), ("doc_ids", longs), ("sha", pa.list_(pa.string())), *[(c, longs) for c in _COUNTS], *[(c, pa.binary()) for c in _PACKED]])
    ddl = ", ".join(["part long, doc_ids array<long>, sha array<string>", *[f"{c} array<long>" for c in _COUNTS], *[f"{c} binary" for c in _PACKED]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def _pair_rows(blocks: DataFrame, same: np.ndarray) -> DataFrame:
    """Rows (part, key, n): pairs of each part, and, with part -1, the identity pairs of each task."""
    held = blocks.sparkSession.sparkContext.broadcast(same)  # as long as A's vocabulary

    def run(batches):
        total, now, have = np.zeros(len(held.value), np.int64), None, []

        def send():
            keys = np.concatenate([k for k, _ in have])
            keys, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in have]), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now)), pa.array(keys), pa.array(n)], names=["part", "key", "n"])

        for b in batches:
            for part, keys, n, i, i_n in zip(*[b.column(c).to_pylist() for c in range(5)]):
                if part != now and have:
                    yield send()
                    have = []
                now = part
                have.append((np.frombuffer(keys, "<i8"), np.frombuffer(n, "<i4")))
                total += np.bincount(np.frombuffer(i, "<i4"), np.frombuffer(i_n, "<i4"), len(total)).astype(np.int64)
        if have:
            yield send()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1)), pa.array(at << 32 | held.value[at]), pa.array(total[at])], names=["part", "key", "n"])

    return blocks.select("part", "pairs", "pair_n", "i_id", "i_n").mapInArrow(run, "part long, key long, n long")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and pairs (a, b, n, best)."""
    with scratch(docs.sparkSession):
        return _align(docs, a_path or _path("byte_bpe_50k.json"), b_path or _path("piece_bpe_32k.model"))


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _align(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    same = tokens(a_path, b_path).same
    blocks = stage(_blocks(docs, a_path, b_path), "blocks")
    total = F.sum("n").over(Window.partitionBy("key"))  # a row a part that has the key
    counted = stage(_pair_rows(blocks, same).select("part", "key", total.alias("total")), "counted")
    b_of = F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = counted.groupBy(b_of).agg(F.max("total").alias("most"))
    counted = counted.withColumn("b", b_of).join(F.broadcast(most), "b")  # a row a B id: bounded by the vocabulary
    counted = counted.select("part", "key", "total", (F.col("total") == F.col("most")).alias("best"))
    ident = counted.where("part = -1").select("key", "total", "best").distinct().collect()  # at most a row an A id
    vector, top = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
    for r in ident:
        vector[r["key"] >> 32], top[r["key"] >> 32] = r["total"], r["best"]
    held = docs.sparkSession.sparkContext.broadcast((vector, top))
    need = counted.where("part >= 0").groupBy("part").agg(F.collect_list(F.struct("key", "total", "best")).alias("need"))  # bounded by PART blocks
    columns = ["doc_ids", "sha", *_COUNTS, "pairs", "d_row", "d_at", "d_n", "i_row", "i_id", "i_n"]

    def finish(batches):
        vector, top = held.value
        for b in batches:
            for r in range(b.num_rows):
                get = {c: b.column(k)[r] for k, c in enumerate([*columns, "need"])}
                raw = {c: np.frombuffer(get[c].as_buffer(), _PACKED[c]) for c in columns if c in _PACKED}
                n = len(get["doc_ids"])
                sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(sums, raw["i_row"], vector[raw["i_id"]] * raw["i_n"])
                np.add.at(bests, raw["i_row"], top[raw["i_id"]] * raw["i_n"])
                if len(raw["pairs"]):
                    key, total, best = (x.to_numpy(zero_copy_only=False) for x in get["need"].values.flatten())
                    order = np.argsort(key)
                    at = order[np.searchsorted(key, raw["pairs"], sorter=order)][raw["d_at"]]
                    np.add.at(sums, raw["d_row"], total[at] * raw["d_n"])
                    np.add.at(bests, raw["d_row"], best[at] * raw["d_n"])
                lists = [get[c].values for c in ("doc_ids", *_COUNTS)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(bests), pa.array(sums), get["sha"].values], names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    kind = ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    out = blocks.join(need, "part", "left").select(*columns, "need").mapInArrow(finish, kind)
    pairs = counted.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), F.col("total").alias("n"), "best")
    return common.keep(out, "aligned"), common.keep(pairs.distinct(), "pairs")


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
