"""Every catalogue query against its SQL in DuckDB."""

import hashlib

import duckdb
import pytest

from lodeworks.plans import catalogue, graphs, layouts, modules, repositories  # noqa: F401  they add their queries to the catalogue

SF = "/root/testdata/sf0.01"
TABLES = "documents pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    return float(v) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, SF), db.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=str)
    at = [names.index(c) for c in sorted(names)]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b and a


def test_content_hash_covers_the_whole_text(spark, tmp_path):
    texts = ["x" * 20000 + "a", "x" * 20000 + "b", "é", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["sha"], r["size"]) for r in catalogue.QUERIES["q42_content_hash"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[0] == (sha(texts[0]), 16384) and got[1] == (sha(texts[1]), 16384) and got[2] == (sha("é"), 2) and got[3][0] is None
