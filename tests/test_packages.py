"""Cycles and adapter folders of package graphs against plain Python."""

import random

from pyspark.sql import functions as F

from lodeworks.operators import packages as P
from lodeworks.operators import relational as R


def members(edges):
    reach = {(a, b) for a, b in edges}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            return {a for a, b in reach if a == b}
        reach = more


def test_cycle_members(spark):
    rng = random.Random(2)
    for n, m in ((12, 14), (12, 24), (9, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = R.cycle_members(spark.createDataFrame(edges, "src long, dst long"))
        assert sorted(r["node"] for r in got.collect()) == sorted(members(edges))


def test_import_cycles(spark):
    edges = [("r", a, b) for a, b in ("ab", "bc", "ca", "bd", "db", "xa", "cy")] + [("s", "p", "q")]
    got = {(r["repo_id"], tuple(r["cycle"])) for r in P.import_cycles(spark.createDataFrame(edges, "repo_id string, src string, dst string")).collect()}
    assert got == {("r", ("a", "b", "c")), ("r", ("b", "d"))}


def test_adapter_folders(spark):
    rows = ["internal/adapters/inbound/http/x", "adapters/db", "infra", "pkg/a", "adapters/outbound/db/schema"]
    df = spark.createDataFrame([(x,) for x in rows], "f string")
    got = df.select(P.adapter_direction(F.col("f")), P.adapter_subtree(F.col("f")), P.below_root(F.col("f"), ("adapters",))).collect()
    assert [tuple(r) for r in got] == [
        ("inbound", "internal/adapters/inbound/http", False), ("", "adapters/db", True), ("", "infra", False), ("", "pkg/a", False), ("outbound", "adapters/outbound/db", True),
    ]
