"""Listing of trees with hidden and empty files, and the state of a stream: restart, compaction and invalidation."""

import os

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import facts as T
from lodeworks.sources import listing as L
from lodeworks.streaming import incremental as I
from tests.test_scorers import file, fn


def write(root, files):
    for path, text in files.items():
        at = root / path
        os.makedirs(at.parent, exist_ok=True)
        at.write_text(text)


def test_listing_sees_hidden_and_empty_files(spark, tmp_path):
    write(tmp_path, {
        "r1/go.mod": "module example.org/m\n", "r1/.github/workflows/ci.yml": "on: push", "r1/.cursorrules": "be kind", "r1/empty.go": "", "r1/_x/y.go": "x", "r1/_internal/k.go": "x", "r1/a/b/c/d.go": "package d",
        "r1/vendor/v.go": "x", "r1/a/testdata/t.go": "x", "r1/out/z.go": "x", "r1/.claude/worktrees/w.go": "x", "r1/.claude/a/worktrees/w.go": "x", "r1/a/worktrees/w.go": "x", "r1/README.md": "r" * 20000, "r2/sp ace/é.go": "package e", "r3/_only/a.go": "x", "loose.txt": "not a repository",
    })
    listed, marks = L.marked_trees(spark, str(tmp_path), ("out/",))
    got = {(r["repo_id"], r["path"]): r["size"] for r in listed.collect()}
    assert set(got) == {("r1", p) for p in ("go.mod", ".github/workflows/ci.yml", ".cursorrules", "empty.go", "_internal/k.go", "a/b/c/d.go", "a/worktrees/w.go", "README.md")} | {("r2", "sp ace/é.go")}
    assert got["r1", "empty.go"] == 0 and got["r1", "README.md"] == 20000
    one = {r["repo_id"]: r for r in marks.collect()}
    assert one["r1"]["has_ci_config"] and one["r1"]["has_cursor"] and one["r1"]["cursor_size"] == 7 and one["r1"]["module_path"] == "example.org/m" and one["r1"]["readme_size"] == 16384
    assert not one["r2"]["has_ci_config"] and not one["r2"]["has_go_mod"]
    whole = L.with_content(listed, str(tmp_path), F.endswith("path", F.lit(".go")), 4).collect()
    assert {r["path"]: bytes(r["content"]) for r in whole if r["content"] is not None}["a/b/c/d.go"] == b"pack"
    os.makedirs(tmp_path / "nothing")
    assert L.list_trees(spark, str(tmp_path / "nothing")).collect() == []


def change(path, version, lines=None):
    return file("a", path, [fn("BuildAll", lines)] if lines else []) | {"deleted": lines is None, "version": version}


def told(spark, out, k):
    return sorted(r.message for r in spark.read.schema(T.ISSUES).parquet(f"{out}/batch={k}").collect())


def test_state_is_compacted_and_survives_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT", 2)
    src, state, out, mark = (str(tmp_path / x) for x in ("src", "state", "out", "mark"))

    def put(*rows):
        spark.createDataFrame(list(rows), I.CHANGES).write.mode("append").parquet(src)

    def run(key="k", mark=mark):
        I.follow(spark.readStream.schema(I.CHANGES).parquet(src), state, out, mark, key=key).awaitTermination(120)

    for k in range(7):
        put(change(f"f{k % 3}.go", k + 1, 100 + k))
        run()
        assert told(spark, out, k) == [f"function BuildAll is {100 + k} lines (>50)"]
    store = I.State(spark, state)
    now = store.load("k")
    assert now["batch"] == 6 and all(len(x) <= 3 for x in now["buckets"].values()) and store._numbers() == [5, 6]
    held = {r["path"]: r["functions"][0]["line_end"] - r["functions"][0]["line_start"] + 1 for r in I.latest(store.rows(now, now["buckets"])).collect()}
    assert held == {"f0.go": 106, "f1.go": 104, "f2.go": 105}
    # folders that no kept manifest names are gone
    named = {f for n in store._numbers() for x in store.load("k", n)["buckets"].values() for f in x}
    there = {f"{a}/{b}/{c}" for a in ("added", "base") for b in os.listdir(f"{state}/{a}") for c in os.listdir(f"{state}/{a}/{b}") if c.startswith("bucket=")}
    assert named == there
    # a lost checkpoint brings batch 0 again: it is known to be done, and nothing changes
    run(mark=str(tmp_path / "mark2"))
    assert store.load("k")["number"] == now["number"] and told(spark, out, 0) == ["function BuildAll is 100 lines (>50)"]
    # a deletion, then an older version that comes late, after the bucket was written anew
    put(change("f0.go", 20))
    run()
    for k in range(3):
        put(change("f1.go", 30 + k, 200 + k))
        run()
    put(change("f0.go", 10, 999))
    run()
    assert told(spark, out, 11) == []
    # another key, or an invalidated state, begins from nothing: what was known is new again
    put(change("f2.go", 40, 105))
    run(key="other")
    assert told(spark, out, 12) == ["function BuildAll is 105 lines (>50)"]
    store.invalidate("other")
    put(change("f2.go", 41, 105))
    run(key="other")
    assert told(spark, out, 13) == ["function BuildAll is 105 lines (>50)"]


def test_two_writers_do_not_mix(spark, tmp_path):
    store = I.State(spark, str(tmp_path / "s"))
    store.save({"number": 0, "batch": 0, "key": "", "buckets": {}})
    with pytest.raises(Exception):
        store.save({"number": 0, "batch": 0, "key": "", "buckets": {}})
