"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram is a run of 4 or 6 bytes of the text, A-Z as a-z and all but letters as a space, with a space at both ends; its
code holds the bytes themselves, so different n-grams never meet. Spark counts, over all labelled rows, how many texts of
either class have each n-gram. The ``features`` n-grams of most evidence (log-likelihood ratio of those counts) are kept;
n-gram j has the value r_j * log(1 + times in the text), r_j its naive Bayes log-count ratio. A logistic regression over
these is fitted by Newton steps on a bounded sample: ``per_class`` rows of each class, chosen by a hash of id and text. The
driver holds features x rows of the sample and nothing that grows with the corpus.

Defined cases: a null or empty text has no n-gram but the spaces', and scores what the intercept says; a label that is null
does not count, and of several labels of one id the highest does; without labelled rows, or with one class alone, every
score is that class's (0 without rows); equal texts have equal scores; an empty table gives no rows; columns beside those
named are ignored, and may have any name; very long texts are read whole, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch, stage
from .language import _MAP, held_out

SIZES = (4, 6)
#: Bytes of a text handled at once, and codes that a task holds before it sends their counts on. Neither changes a result.
BLOCK, HELD = 1 << 20, 1 << 21
_SPACE = np.full(1, 32, np.uint8)


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000
    features: int = 1024
    penalty: float = 1.0
    steps: int = 30


def codes(data: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of mapped bytes: the bytes, and above them which of SIZES."""
    x, out = data.astype(np.int64), []
    for k, n in enumerate(SIZES):
        if len(x) >= n:
            c = x[: len(x) - n + 1].copy()
            for j in range(1, n):
                c <<= 8
                c |= x[j : len(x) - n + 1 + j]
            out.append(c | k << 56)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def text_blocks(text: pa.Scalar) -> Iterator[np.ndarray]:
    """Codes of a text, block by block; each n-gram is in one block."""
    raw = text.as_buffer()
    data = _MAP[np.frombuffer(raw, np.uint8)] if raw is not None else np.empty(0, np.uint8)
    data = np.concatenate([_SPACE, data, _SPACE])
    if len(data) <= BLOCK:
        yield codes(data)
        return
    for at in range(0, len(data), BLOCK):
        part = codes(data[at : at + BLOCK + max(SIZES) - 1])
        # an n-gram belongs to the block it begins in
        ends, keep, lo = len(data), [], 0
        for n in SIZES:
            here = max(0, min(BLOCK + max(SIZES) - 1, ends - at) - n + 1)
            keep.append(part[lo : lo + min(here, BLOCK)])
            lo += here
        yield np.concatenate(keep)


def counted(text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a text and how often each occurs."""
    parts = [np.unique(c, return_counts=True) for c in text_blocks(text)]
    if len(parts) == 1:
        return parts[0]
    names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return names, np.bincount(at, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, text, toxic) of the documents that have a label."""
    marks = stage(labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "labels")
    return docs.select("doc_id", "text").join(broadcast_if_small(marks, marks.count(), 12), "doc_id")


def evidence(rows: DataFrame) -> DataFrame:
    """Rows (code, p, q): labelled texts of class 1 and of class 0 that have each n-gram."""

    def count(batches):
        held: list[tuple[np.ndarray, int]] = []

        def merged():
            out = []
            for cls in (0, 1):
                have = [c for c, t in held if t == cls]
                out.append(np.unique(np.concatenate(have), return_counts=True) if have else (np.empty(0, np.int64),) * 2)
            for cls, (names, n) in enumerate(out):
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n if cls else zero), pa.array(zero if cls else n)], names=["code", "p", "q"])

        size = 0
        for b in batches:
            texts = b.column(0).cast(pa.large_binary())
            for text, toxic in zip(texts, b.column(1).to_pylist()):
                names = counted(text)[0]
                held.append((names, toxic))
                size += len(names)
                if size > HELD:
                    yield from merged()
                    held, size = [], 0
        yield from merged()

    return rows.select("text", "toxic").mapInArrow(count, "code long, p long, q long").groupBy("code").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression with squared penalty; class 1 weighs as the root of how rare it is."""
    x = np.c_[x, np.ones(len(x))]
    rare = np.sqrt(max((y == 0).sum(), 1) / max((y == 1).sum(), 1))
    scale, w = np.where(y == 1, rare, 1.0), np.zeros(x.shape[1])
    least = np.full(len(w), s.penalty)
    least[-1] = 1e-6
    cost = lambda v: (scale * (np.logaddexp(0, x @ v) - y * (x @ v))).sum() + (least * v * v).sum() / 2
    for _ in range(s.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (scale * (p - y)) + least * w
        d = np.linalg.solve((x * (scale * p * (1 - p))[:, None]).T @ x + np.diag(least), g)
        step, now = 1.0, cost(w)
        while step > 1e-6 and cost(w - step * d) > now - 1e-4 * step * (g @ d):
            step /= 2
        w = w - step * d
        if g @ d < 1e-8:
            break
    return w


def values(text: pa.Scalar, names: np.ndarray, ratio: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that the text has, and their values; ``near`` marks hashes of names, so that few codes are looked up."""
    found = []
    for c in text_blocks(text):
        c = c[near[_slot(c)]]
        at = np.searchsorted(names, c)
        at[at == len(names)] = 0
        found.append(at[names[at] == c])
    j, n = np.unique(np.concatenate(found), return_counts=True)
    return j, ratio[j] * np.log1p(n)


def _slot(c: np.ndarray) -> np.ndarray:
    return ((c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _near(names: np.ndarray) -> np.ndarray:
    near = np.zeros(1 << 20, bool)
    near[_slot(names)] = True
    return near


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict:
    """A model of docs (doc_id, text) by labels (doc_id, toxic)."""
    with scratch(docs.sparkSession):
        rows = labelled(docs, labels)
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
        if len(sizes) < 2:
            return {"always": float(max(sizes, default=0))}
        n1, n0 = sizes[1], sizes[0]
        seen = stage(evidence(rows), "evidence")
        k, p, q = seen.agg(F.count("*"), F.sum("p"), F.sum("q")).first()
        term = lambda a, n: F.when(a > 0, a * F.log(a / F.lit(float(n)))).otherwise(0.0) + F.when(a < n, (n - a) * F.log((n - a) / F.lit(float(n)))).otherwise(0.0)
        gain = term(F.col("p"), n1) + term(F.col("q"), n0) - term(F.col("p") + F.col("q"), n1 + n0)
        ratio = F.log((F.col("p") + 1) / F.lit(float(p + k))) - F.log((F.col("q") + 1) / F.lit(float(q + k)))
        best = seen.select("code", ratio.alias("r"), F.round(gain, 6).alias("g")).orderBy(F.desc("g"), "code").limit(s.features).collect()
        best.sort(key=lambda r: r["code"])
        names, r = np.array([x["code"] for x in best]), np.array([x["r"] for x in best])
        near = _near(names)
        rates = [min(1 << 20, -(-(s.per_class << 20) // n)) for n in (n0, n1)]
        chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])

        def rows_of(batches):
            for b in batches:
                out = [values(t, names, r, near) for t in b.column(0).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([j.astype(np.int32) for j, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float64()))], names=["toxic", "j", "v"])

        sample = rows.where(chosen).select("text", "toxic").mapInArrow(rows_of, "toxic int, j array<int>, v array<double>").toPandas()
        # in an order of its own, so that the weights do not depend on partitions
        sample = sample.iloc[sorted(range(len(sample)), key=lambda i: (sample["toxic"][i], list(sample["j"][i]), list(sample["v"][i])))]
        x = np.zeros((len(sample), len(names)))
        for i, (j, v) in enumerate(zip(sample["j"], sample["v"])):
            x[i, np.asarray(j, int)] = v
        y = sample["toxic"].to_numpy()
        if len(set(y.tolist())) < 2:
            return {"always": float(n1 >= n0)}
        w = fit(x, y, s)
        return {"names": names, "ratio": r * w[:-1], "bias": float(w[-1])}


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with score (0 to 1) and predicted (1 from 0.5), from text alone."""
    if "always" in model:
        out = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(model["always"]).alias("score"))
        return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features
    alias = [f"_k{i}" for i in range(len(keep))]

    def predict(batches):
        m = held.value
        near = _near(m["names"])
        for b in batches:
            z = np.array([values(t, m["names"], m["ratio"], near)[1].sum() for t in b.column(len(alias)).cast(pa.large_binary())]) + m["bias"]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(alias)], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*alias, "score"])

    slim = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, alias)], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = "".join(f"{a} {docs.schema[c].dataType.simpleString()}, " for a, c in zip(alias, keep))
    out = slim.mapInArrow(predict, f"{kinds}score double")
    return out.select(*[F.col(a).alias(c) for c, a in zip(keep, alias)], "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by a model fitted on the labelled documents outside the fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(~held_out()))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
