"""How often, and with what, the facts of files are written."""

from lodeworks.operators import relational as R
from lodeworks.operators import reports as P
from lodeworks.plans import repositories

SF = "/root/testdata/sf0.001"


def test_facts_are_written_once_and_without_functions_where_none_is_read(spark, monkeypatch):
    wrote, real = [], R.durable

    def durable(df):
        wrote.append((df.columns, any("lineitem" in f for f in df.inputFiles())))
        return real(df)

    monkeypatch.setattr(R, "durable", durable)
    repositories._scored_graph(spark, SF)
    assert wrote and not any(functions for _, functions in wrote)
    wrote.clear()
    monkeypatch.setattr(P, "score_repositories", lambda *given: given)
    files = repositories._scored(spark, SF)[0]
    assert sum("functions" in columns for columns, _ in wrote) == 1
    assert files.where("size(functions) > 0").count() > 0


def test_written_tables_are_parquet(spark):
    df = R.durable(spark.range(10).selectExpr("id", "struct(id AS a) AS s", "id % 3 AS k").repartition(3, "k"))
    assert df.inputFiles() and all(f.endswith(".parquet") for f in df.inputFiles())
    assert sorted(r["s"]["a"] for r in df.collect()) == list(range(10))
