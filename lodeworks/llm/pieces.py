"""SentencePiece encoding and decoding by a streaming Viterbi search.

A model file's pieces and scores are read as a unigram model: the segmentation with the highest sum of scores wins, as
the library does for such models. The search keeps sums for a window alone, which the longest piece bounds, and walks a
trie of the pieces. Behind the window it keeps a back pointer a character, until all paths that can still win go through
one boundary: the ids before it are committed and their pointers dropped. Open paths are walked back only after as many
new characters as the last walk passed, so the time is in proportion to the text, also where paths run side by side for
long, as in a run of one character; the pointers of such a run take eight bytes a character.

Where no piece reaches over a boundary at all (before a space mark that follows another character, around line ends, and
between a letter and a mark that no piece joins to one), every path converges; a worker keeps the ids of such stretches,
which changes no result.

Defined cases: a null or empty text has no ids and decodes to an empty text; characters without a piece fall back to
bytes, and so does the space mark itself where a text holds it, which the library would read as a space; of paths of
equal score the one whose last piece starts first wins, as in the library; any text comes back from its ids unchanged, if
the model has byte pieces; columns beside doc_id and text are ignored, and may have any name.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Stands for a space mark of the text itself. No text holds a lone surrogate, nor does any piece.
MARK = "\ud800"
#: Stretches kept by a worker before it starts afresh, and characters of a text over which stretches are not listed.
KEPT, LISTED = 300_000, 1 << 20
#: Marks that often follow a word; a stretch ends between a LETTER and one of them if no piece holds a letter and then it.
MARKS = ".,;:!?*%$&#|"
LETTER = r"[^\W\d_]"


class StreamingViterbi:
    """Encoder over (piece, score, id) rows, with ids of the 256 byte pieces or an unknown id."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_at: int | None, unknown: int):
        self.score = {p: (s, i) for p, s, i in pieces}
        self.trie: dict = {}
        for p, found in self.score.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = found
        self.longest = max(map(len, self.score), default=1)
        self.low = min((s for _, s, _ in pieces), default=0.0) - 10.0
        self.bytes_at, self.unknown = bytes_at, unknown
        inside = {p for p in self.score if re.search(f"[^{SPACE}]{SPACE}", p)}
        joined = {c for p in self.score if len(p) > 1 for c in p}
        #: Stretches that no piece joins to their neighbours.
        after = {b for p in self.score for a, b in zip(p, p[1:]) if re.match(LETTER, a)}
        marks = "".join(re.escape(c) for c in MARKS if c not in after)
        # after anything but a letter a mark stays in the stretch: there are pieces such as '",' and ').'
        body = f"(?:[^{SPACE}\n{marks}]+|(?<!{LETTER})[{marks}])+|[{marks}][^{SPACE}\n]*" if marks else f"[^{SPACE}\n]+"
        # a stretch that begins with marks goes on to the next space: a piece may join a mark to what follows it
        self.stretch = re.compile(f"{SPACE}*(?:{body})|\n|{SPACE}+") if not inside and "\n" not in joined else None
        self.kept: dict[str, bytes] = {}
        self.widest = 0

    def _fallback(self, char: str) -> list[int]:
        return [self.unknown] if self.bytes_at is None else [self.bytes_at + b for b in char.replace(MARK, SPACE).encode("utf-8", "replace")]

    def commits(self, text: str):
        """Lists of ids, each as soon as it is certain.

        ``sums`` has the best sum to each boundary from the current one to the furthest that a piece has reached. ``size``
        and ``piece`` have the last piece of the best path to each boundary from ``base`` on. If only one boundary is open,
        all paths go through it.
        """
        trie, low, n, longest = self.trie, self.low, len(text), self.longest
        sums, size, piece = [0.0], array("i", [0]), array("i", [-1])
        base, due = 0, 2 * longest
        for at in range(n):
            here = sums.pop(0)
            node, k = trie.get(text[at]), 0
            if node is None or "" not in node:  # sums[k] belongs to the boundary at + 1 + k
                s = here + low
                if not sums:
                    sums.append(None)
                    size.append(0)
                    piece.append(-1)
                if sums[0] is None or s > sums[0]:
                    sums[0], size[at + 1 - base], piece[at + 1 - base] = s, 1, -1
            while node is not None:
                found = node.get("")
                if found is not None:
                    while len(sums) <= k:
                        sums.append(None)
                        size.append(0)
                        piece.append(-1)
                    s = here + found[0]
                    if sums[k] is None or s > sums[k]:
                        sums[k], size[at + 1 + k - base], piece[at + 1 + k - base] = s, k + 1, found[1]
                k += 1
                if at + k == n:
                    break
                node = node.get(text[at + k])
            if len(sums) == 1:
                meet = at + 1
            elif at + 1 >= due:
                # step back from the open ends until their paths meet
                live = {at + 1 + k for k, s in enumerate(sums) if s is not None}
                while len(live) > 1:
                    top = max(live)
                    live.discard(top)
                    live.add(top - size[top - base])
                meet = live.pop()
            else:
                continue
            self.widest = max(self.widest, at + 1 - base)
            if meet > base:
                ids, e = [], meet
                while e > base:
                    k = e - base
                    ids.append([piece[k]] if piece[k] >= 0 else self._fallback(text[e - size[k] : e]))
                    e -= size[k]
                yield [i for x in reversed(ids) for i in x]
                del size[: meet - base], piece[: meet - base]
                base = meet
            due = at + 1 + max(2 * longest, at + 1 - base)

    def encode(self, text: str) -> bytes:
        """Ids of text as unsigned 32-bit little-endian bytes."""
        if not text:
            return b""
        text = SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)
        if self.stretch is None:
            return np.array([i for c in self.commits(text) for i in c], "<u4").tobytes()
        kept, out = self.kept, []
        if len(kept) > KEPT:
            kept.clear()
        for part in self.stretch.findall(text) if len(text) <= LISTED else (m[0] for m in self.stretch.finditer(text)):
            got = kept.get(part)
            if got is None:
                got = np.array([i for c in self.commits(part) for i in c], "<u4").tobytes()
                if len(part) <= 64:
                    kept[part] = got
            out.append(got)
        return b"".join(out)


class PieceModel:
    """Pieces of a SentencePiece model file; encode and decode."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        bytes_at = next((i for i in range(n) if sp.is_byte(i)), None)
        rows = [(p, sp.get_score(i), i) for i, p in enumerate(self.names) if not special[i]]
        self.byte = {i: i - bytes_at for i in range(n) if sp.is_byte(i)} if bytes_at is not None else {}
        self.viterbi = StreamingViterbi(rows, bytes_at, sp.unk_id())
        self.raw = [bytes([self.byte[i]]) if i in self.byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]

    def encode(self, text: str | None) -> bytes:
        return self.viterbi.encode(text or "")

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _apply(df: DataFrame, column: str, make, name: str, kind: str, keep: list[str]) -> DataFrame:
    """df's columns ``keep`` and ``name``: make() gives a function of the column's values."""
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches):
        f = make()
        for b in batches:
            for i in range(0, len(b), 256):
                s = b.slice(i, 256)
                values = pa.array([f(x) for x in s.column(len(names)).to_pylist()], pa.string() if kind == "string" else pa.binary())
                yield pa.RecordBatch.from_arrays([*s.columns[: len(names)], values], names=[*names, name])

    slim = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, names)], F.col(f"`{column}`"))
    kinds = "".join(f"{a} {df.schema[c].dataType.simpleString()}, " for a, c in zip(names, keep))
    out = slim.mapInArrow(run, f"{kinds}{name} {kind}")
    return out.select(*[F.col(a).alias(c) for c, a in zip(keep, names)], name)


def encode(docs: DataFrame, keep: list[str], model: str | None = None) -> DataFrame:
    """Columns ``keep`` and ids (binary, unsigned 32-bit little-endian) of docs' text."""
    model = model or default_model()
    return _apply(docs, "text", lambda: piece_model(model).encode, "ids", "binary", keep)


def decode(encoded: DataFrame, keep: list[str], model: str | None = None) -> DataFrame:
    """Columns ``keep`` and decoded, the text of the ids."""
    model = model or default_model()
    return _apply(encoded, "ids", lambda: lambda x: piece_model(model).decode(x or b""), "decoded", "string", keep)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 of every whole text, and whether the ids decode to it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = default_model()

    def run(batches):
        m = piece_model(model)
        for b in batches:
            for i in range(0, len(b), 256):
                s = b.slice(i, 256)
                texts = [x or "" for x in s.column(1).to_pylist()]
                ids = [m.encode(x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([len(x) // 4 for x in ids]), pa.array([zlib.crc32(x) for x in ids]), pa.array([m.decode(x) == t for x, t in zip(ids, texts)])],
                    names=["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
