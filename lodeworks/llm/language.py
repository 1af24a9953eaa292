"""Language ID by error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a binary naive-Bayes classifier over hashed byte n-grams tells
the languages with +1 from those with -1. A text's bit scores are compared with all codewords: the nearest one, by
logistic loss weighted by each bit's separation in training, names the language. A small gap to the second marks
ambiguity.

The classifiers are fitted on a bounded sample: about ``per_language`` rows of every language, chosen by a hash of id
and text. The model grows with the number of languages alone. Prediction reads whole texts, in blocks of fixed size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled rows every text is
``und``; with one language every text with a letter is that language; a text of under three bytes has no n-gram, and is
the first language, flagged as ambiguous; equal texts get equal results; columns beside those named are ignored, and may
have any name; very long texts are read whole, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 19


@dataclass(frozen=True)
class Settings:
    per_language: int = 2000
    buckets_log2: int = 14
    smoothing: float = 0.5
    ambiguous_gap: float = 0.02


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code up to 7 languages, else dense random columns, best of several draws by least distance."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        bits = 2 ** (k - 1) - 1
        m = np.array([[1 - 2 * ((c >> r) & 1) for c in range(1, bits + 1)] for r in range(k - 1)] + [[1] * bits])
        return m.astype(float)
    rng, best = np.random.default_rng(seed), None
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (k, n))
        m[:, np.abs(m.sum(0)) == k] *= np.where(np.arange(k) % 2, 1, -1)[:, None]
        least = ((n - m @ m.T) / 2 + np.eye(k) * n).min()
        if best is None or least > best[0]:
            best = least, m
    return best[1]


def _classes() -> np.ndarray:
    """Byte map: A-Z to a-z, a-z and bytes over 127 as they are, all else to a space."""
    m = np.full(256, 32, np.uint8)
    m[97:123] = np.arange(97, 123)
    m[65:91] = np.arange(97, 123)
    m[128:] = np.arange(128, 256)
    return m


_MAP = _classes()


def grams(data: np.ndarray, log2: int) -> np.ndarray:
    """Hash of the three mapped bytes that start at each place but the last two."""
    x = _MAP[data].astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - log2)


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the column's bytes: (bytes, row of each part, start of each part in the piece).

    A piece has at most BLOCK bytes; a longer text goes on in the next piece, with the last two bytes again.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row, at, end = 0, int(offsets[0]) if len(column) else 0, int(offsets[-1]) if len(column) else 0
    while at + 2 < end:
        stop = min(end, at + BLOCK)
        last = int(np.searchsorted(offsets, stop, "left"))
        row = int(np.searchsorted(offsets, at, "right")) - 1
        rows = np.arange(row, min(last, len(column)))
        yield data[at:stop], rows, np.maximum(offsets[rows] - at, 0)
        at = stop if stop == end else stop - 2


def _each(column: pa.Array, log2: int):
    """For each piece: n-gram buckets, and (row, from, to) arrays of the parts that have any."""
    for data, rows, starts in blocks(column):
        if len(data) < 3:
            continue
        ends = np.minimum(np.append(starts[1:], len(data)) - 2, len(data) - 2)
        ok = ends > starts
        yield grams(data, log2), rows[ok], starts[ok], ends[ok]


def train(docs: DataFrame, s: Settings = Settings()) -> dict | None:
    """Fit on docs (doc_id, text, lang); None without labelled rows. The counts of the sample are summed by Spark."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r["lang"] for r in counts.select("lang").collect())  # a row a language: the classes of the model
    if not langs:
        return None
    rates = counts.select("lang", F.least(F.lit(1 << 20), F.ceil(F.lit(s.per_language << 20) / F.col("n"))).alias("_rate"))
    sample = docs.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("_rate"))
    log2 = s.buckets_log2

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(1).to_pylist()
            for g, rows, starts, ends in _each(b.column(0), log2):
                for r, x, y in zip(rows, starts, ends):
                    t = total.setdefault(names[r], np.zeros(1 << log2, np.int64))
                    t += np.bincount(g[x:y], minlength=1 << log2)
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], names=["lang", "g", "n"])

    table = sample.select("text", "lang").mapInArrow(count, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    hist = np.zeros((len(langs), 1 << log2))
    pdf, row = table.toPandas(), {x: i for i, x in enumerate(langs)}  # at most languages * 2^buckets_log2 rows, whatever the corpus
    hist[[row[x] for x in pdf["lang"]], pdf["g"].to_numpy(dtype=int)] = pdf["n"].to_numpy(dtype=float)
    code = codewords(len(langs))
    p = (hist + s.smoothing) / (hist + s.smoothing).sum(1, keepdims=True)
    if len(langs) == 1:
        return {"langs": langs, "code": code, "weights": np.zeros((1 << log2, 1), np.float32), "scale": np.ones(1), "trust": np.ones(1)}
    plus, minus = (code > 0).astype(float), (code < 0).astype(float)
    w = np.log((plus.T @ p) / plus.sum(0)[:, None]) - np.log((minus.T @ p) / minus.sum(0)[:, None])
    margin = code * ((hist / np.maximum(hist.sum(1, keepdims=True), 1)) @ w.T)  # of each language's own text, by bit
    scale, trust = np.abs(margin).mean(0) + 1e-9, np.clip(margin.min(0), 0.0, None) + 1e-3
    return {"langs": langs, "code": code, "weights": np.ascontiguousarray(w.T, np.float32), "scale": scale, "trust": trust / trust.sum()}


def decode(sums: np.ndarray, n: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index, score and gap to the second, from summed bit scores of texts with n n-grams."""
    z = 2.0 * sums / np.maximum(n, 1)[:, None] / model["scale"]
    loss = (np.logaddexp(0.0, -z[:, None, :] * model["code"][None]) * model["trust"]).sum(2)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    low = loss[np.arange(len(loss)), best]
    gap = loss[np.arange(len(loss)), order[:, 1]] - low if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, 1.0 / np.exp(-4 * (loss - low[:, None])).sum(1), gap


def identify(docs: DataFrame, model: dict | None, keep: list[str], s: Settings = Settings(), only_clear: bool = False) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred, score and ambiguous, from text alone; or the columns alone of the clear rows."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages * buckets
    names, log2, wide = [f"_k{i}" for i in range(len(keep))], s.buckets_log2, s.ambiguous_gap

    def predict(batches):
        m = held.value
        w, langs = m["weights"], np.array(m["langs"], object)
        for b in batches:
            text, has = b.column(len(names)), b.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            sums, n = np.zeros((len(text), w.shape[1])), np.zeros(len(text))
            for g, rows, starts, ends in _each(text, log2):
                cuts = np.stack([starts, np.minimum(ends, len(g) - 1)], 1).ravel()
                for k in range(w.shape[1]):
                    part = np.add.reduceat(w[:, k][g], cuts)[::2]
                    tail = ends == len(g)
                    if tail.any():
                        part[tail] += w[g[-1], k]
                    np.add.at(sums[:, k], rows, part)
                np.add.at(n, rows, ends - starts)
            best, score, gap = decode(sums, n, m)
            pred = np.where(has, langs[best], "und")
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(names))], pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(~has | (gap < wide))],
                names=[*names, "lang_pred", "score", "ambiguous"],
            )

    slim = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, names)], F.coalesce(F.col("text"), F.lit("")).alias("text"), letter.alias("has"))
    kinds = ", ".join(f"{a} {f.dataType.simpleString()}" for a, f in zip(names, (docs.schema[c] for c in keep)))
    out = slim.mapInArrow(predict, f"{kinds + ', ' if kinds else ''}lang_pred string, score double, ambiguous boolean")
    if only_clear:
        return out.where("NOT ambiguous").select(*[F.col(a).alias(c) for c, a in zip(keep, names)])
    return out.select(*[F.col(a).alias(c) for c, a in zip(keep, names)], "lang_pred", "score", "ambiguous")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Predictions for every document by a model fitted on the documents outside the fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def language_filter(docs: DataFrame) -> DataFrame:
    """Rows of docs whose language is clear, columns unchanged; the model is fitted on docs outside the fold.

    Only texts without letters and ambiguous ones go. Without any labelled row nothing is known, and all stay.
    """
    model = train(docs.where(~held_out()))
    if model is None:
        return docs
    return identify(docs, model, docs.columns, only_clear=True)
