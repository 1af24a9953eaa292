"""Memory of the near-duplicate operator, scratch tables of the substring operator."""

import os
import random
import tracemalloc

import pyarrow as pa

from lodeworks.llm import common, jaccard, passages, shingles


def test_hashing_takes_little_memory():
    column = pa.array([" ".join(str(i * k) for i in range(400)) for k in range(1500)])
    assert column.nbytes > 3 << 20
    shingles._powers.clear()
    tracemalloc.start()
    words = sum(int(counts.sum()) for _, counts, *_ in shingles.word_blocks(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == 400 * 1500
    assert peak < 20 << 20


def test_sets_of_one_row_are_not_shuffled_with_their_prefixes(spark):
    rows = [(1, 3, 10, [1, 2]), (2, 2, 11, [3]), (3, 2, 11, [3]), (None, 2, 11, [3]), (3, 2, 11, [3]), (4, 0, 12, []), (None, 1, 13, [4])]
    sums = spark.createDataFrame(rows, "doc_id long, n long, fp long, prefix array<long>")
    assert sorted(map(tuple, jaccard.distinct_sets(sums).collect())) == [(10, 1, 3, [1, 2]), (11, None, 2, [3]), (13, None, 1, [4])]


def test_windows_go_once_runs_are_known(spark, monkeypatch):
    rng = random.Random(6)
    prose = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]
    shared = prose(60)
    rows = [(i, " ".join(prose(20 + i) + shared + prose(30))) for i in range(6)]
    seen = {}

    def stage(df, what="stage", kept=False):
        out = common.stage(df, what, kept)
        there = {name.partition("-")[0] for _, names, _ in os.walk(common.shared_dir(spark).removeprefix("file:")) for name in names}
        seen[what] = (there & {"windows", "sigs", "ranked"}, df.columns)
        return out

    monkeypatch.setattr(passages, "stage", stage)
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["first_doc"]) for r in found) == [(i, 20 + i, 80 + i, 0) for i in range(6)]
    assert seen["windows"][0] and not seen["rows"][0] and not seen["found"][0]
    assert "s" not in seen["found"][1]
