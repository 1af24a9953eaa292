"""Copies of sets that the near-duplicate operator has on disk at once, and when its scratch tables go."""

import os
import random

from lodeworks.llm import common, jaccard
from tests.llm.test_operators import brute_classes


def _passages():
    """Texts that share a passage without being similar, a few near copies among them, and long texts with the same passage."""
    rng = random.Random(21)
    prose = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]
    tail, rows = prose(40), []
    for k in range(24):
        own = prose(rng.choice([9, 25, 30]))
        rows += [(100 + 2 * k, " ".join(own + tail)), (101 + 2 * k, " ".join(own + tail[:-1] + ["end"]))]
    return rows + [(10 + k, " ".join(prose(150) + tail)) for k in range(8)]


def test_chunks_of_a_large_block_meet_a_few_at_a_time(spark, monkeypatch):
    rows, sent, real = _passages(), [], jaccard._linked

    def linked(sets, keys, known):
        sent.append((len(keys), sets.count()))
        return real(sets, keys, known)

    monkeypatch.setattr(jaccard, "_linked", linked)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 150).collect())
    assert got == brute_classes(rows) and len({c for _, _, c in got}) < len(rows)
    assert any(k == 3 for k, _ in sent)
    assert max(n for k, n in sent if k == 3) <= 4 * 2 * len(rows)  # two windows a set, two chunks at a time, either way


def test_texts_of_unlike_length_share_no_block(spark, monkeypatch):
    blocks, real = [], jaccard.full_sets

    def full_sets(docs):
        blocks.extend(docs.selectExpr("block", "size(split(text, ' ')) AS n").collect())
        return real(docs)

    monkeypatch.setattr(jaccard, "full_sets", full_sets)
    jaccard.classes(spark.createDataFrame(_passages(), "doc_id long, text string")).collect()
    by: dict = {}
    for block, n in blocks:
        by.setdefault(block, []).append(n - 4)
    assert blocks and all(max(x) <= jaccard.BAND**2 * min(x) for x in by.values())


def test_prefixes_go_once_they_are_read(spark, monkeypatch):
    seen = {}

    def stage(df, what="stage", kept=False):
        out = common.stage(df, what, kept)
        seen[what] = {name.partition("-")[0] for _, names, _ in os.walk(common.shared_dir(spark).removeprefix("file:")) for name in names}
        return out

    monkeypatch.setattr(jaccard, "stage", stage)
    jaccard.classes(spark.createDataFrame(_passages(), "doc_id long, text string")).collect()
    assert "sums" in seen["sums"] and not {"sums", "again"} & seen["full"]
