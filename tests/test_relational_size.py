"""Operators over pairs: results against plain Python, and what they shuffle."""

import random
import re

from lodeworks.operators import relational as R


def test_division_pairs_are_not_shuffled(spark):
    rng = random.Random(3)
    sets = {(k, f"e{rng.randrange(12)}") for k in [*range(40), None] for _ in range(9)} | {(1, None)}
    wanted = {(t, f"e{rng.randrange(12)}") for t in [*range(30), None] for _ in range(t % 4 + 1 if t is not None else 1)} | {(30, None), (31, "e1"), (31, None), (32, "none")}
    have, want = {}, {}
    for k, e in sets:
        have.setdefault(k, set()).add(e)
    for t, e in wanted:
        want.setdefault(t, set()).add(e)
    df = R.covers(spark.createDataFrame(list(sets), "k long, e string"), spark.createDataFrame(list(wanted), "t long, e string"), "k", "t", "e")
    got = [tuple(r) for r in df.collect()]
    brute = [(k, t) for k, a in have.items() for t, b in want.items() if t is not None and None not in b and b <= a]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute, key=key) and {len(want[t]) for _, t in brute} > {1}
    assert not re.search(r"hashpartitioning\(k#\w+, t#", df._jdf.queryExecution().executedPlan().toString())


def test_jaccard_pairs_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    sets = {(f"k{k}", rng.randrange(20 if k % 2 else 60)) for k in range(37) for _ in range(rng.randint(1, 14))}
    sets |= {("k1", None), ("alone", None), (None, 3), ("same", 1), ("same2", 1)}
    have = {}
    for k, e in sets:
        have.setdefault(k, set()).add(e)
    brute = []
    for a, x in have.items():
        for b, y in have.items():
            if a is not None and b is not None and a < b and (n := len((x & y) - {None})) and 4 * n >= len(x) + len(y) - n:
                brute.append((a, b, n, round(n / (len(x) + len(y) - n), 6), round(min(len(x), len(y)) / max(len(x), len(y)), 6)))
    df = spark.createDataFrame(list(sets), "k string, e long")
    assert sorted(map(tuple, R.jaccard_pairs(df, "k", "e", 0.25).collect())) == sorted(brute)
    for name, value in (("JOINED", 0), ("BLOCK_KEYS", 5), ("COLUMNS", 7)):
        monkeypatch.setattr(R, name, value)
    blocks = R.jaccard_pairs(df, "k", "e", 0.25)
    assert sorted(map(tuple, blocks.collect())) == sorted(brute) and len(brute) > 50
    assert not re.search(r"hashpartitioning\(a#\w+, b#", blocks._jdf.queryExecution().executedPlan().toString())
