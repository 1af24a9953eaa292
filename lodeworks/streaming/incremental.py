"""Scores kept up with a stream of file changes.

The state is the latest row of each file, in buckets of repositories. A manifest names the folders that hold each bucket: a
base of latest rows, and what batches have added since. A batch reads only the buckets that it touches, writes the issues
that are new and then its own rows, and last puts a new manifest in place, whole, by a rename. So a batch that is run
again after a loss either finds its manifest, and does nothing, or repeats everything, over the same folders. After
``COMPACT`` additions a bucket is written anew as a base, so that a batch never reads more than that many versions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeworks.operators import facts as T
from lodeworks.operators import scorers
from lodeworks.plans import validation

#: Buckets of repositories; a batch names the ones it touches, at most this many.
BUCKETS = 256
#: Folders of a bucket from which the next batch writes it as one.
COMPACT = 8
#: Manifests that are kept, with the folders that they name, for readers of an older one.
KEPT = 2
CHANGES = f"{T.FILES}, deleted boolean, version long"
_ROWS = f"{CHANGES}, batch long"


class State:
    """The manifests of a state folder, read and written through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._of(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]  # KEPT of them, and what a loss left
        return sorted(int(x) for x in names if x.isdigit())

    def load(self, key: str = "", at: int | None = None) -> dict:
        """The newest manifest (or that of number ``at``): its number, the last batch, and the folders of each bucket; empty if it was written under another key."""
        found = self._numbers() if at is None else [at]
        if not found:
            return {"number": -1, "batch": -1, "key": key, "buckets": {}}
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{found[-1]}").collect())  # a line
        got = json.loads(text) | {"number": found[-1]}
        return got if got["key"] == key else got | {"key": key, "buckets": {}}

    def save(self, manifest: dict) -> None:
        """Put manifest in place as the newest, and delete manifests and folders that none of the last KEPT names."""
        n = manifest["number"]
        hidden, final = self._of(f"{self.path}/manifests/.new-{n}"), self._of(f"{self.path}/manifests/{n}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(hidden, final):
            raise RuntimeError(f"manifest {n} is there already: another query writes to {self.path}")
        numbers = self._numbers()
        last = [self.load(manifest["key"], x) for x in numbers[-KEPT:]]
        named = {f for m in last for folders in m["buckets"].values() for f in folders}
        for x in numbers[:-KEPT]:
            for f in {f for folders in self.load(manifest["key"], x)["buckets"].values() for f in folders} - named:
                self.delete(f)
            self._fs.delete(self._of(f"{self.path}/manifests/{x}"), False)

    def delete(self, folder: str) -> None:
        self._fs.delete(self._of(f"{self.path}/{folder}"), True)

    def invalidate(self, key: str = "") -> None:
        """Forget every bucket: the next batch finds no earlier rows."""
        now = self.load(key)
        self.save({"number": now["number"] + 1, "batch": now["batch"], "key": key, "buckets": {}})

    def rows(self, manifest: dict, buckets) -> DataFrame:
        """The rows of buckets, all versions, as the manifest has them."""
        folders = [f"{self.path}/{f}" for b in buckets for f in manifest["buckets"].get(str(b), [])]
        return self.spark.read.schema(_ROWS).parquet(*folders) if folders else self.spark.createDataFrame([], _ROWS)


def _last(rows: DataFrame) -> DataFrame:
    """The last version of each file, deleted or not. A window over one file's versions."""
    w = Window.partitionBy("repo_id", "path").orderBy(F.col("version").desc(), F.col("batch").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest(rows: DataFrame) -> DataFrame:
    """The last version of each file that is not deleted, as a row of facts."""
    return _last(rows).where("NOT coalesce(deleted, false)").drop("deleted", "version", "batch", "bucket")


def follow(changes: DataFrame, state: str, out: str, checkpoint: str, profile: scorers.Profile = scorers.Profile(), key: str = "") -> StreamingQuery:
    """Start the query over changes (CHANGES); new issues go to out/batch=<n> as Parquet.

    ``key`` is a hash of what the state depends on, as the configuration; under another key the state counts as empty.
    """
    out = out.rstrip("/")

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        store = State(spark, state)
        manifest = store.load(key)
        if manifest["batch"] >= n:
            return  # done before a restart
        rows = batch.withColumn("batch", F.lit(n).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(BUCKETS)).cast("int"))
        added = f"added/{manifest['number'] + 1}-{n}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store.path}/{added}")
        mine = spark.read.schema(f"{_ROWS}, bucket int").parquet(f"{store.path}/{added}")
        touched = sorted(r[0] for r in mine.select("bucket").distinct().collect())  # BUCKETS at most
        held = store.rows(manifest, touched)
        # repositories of a touched bucket that have no change here bring no new issues
        old = held.join(mine.select("repo_id").distinct(), "repo_id", "left_semi")
        before, after = (scorers.issues(latest(x), profile) for x in (old, old.unionByName(mine.drop("bucket"))))
        validation.new_issues(before, after).write.mode("overwrite").parquet(f"{out}/batch={n}")
        folders = {b: list(x) for b, x in manifest["buckets"].items()}
        full = [b for b in touched if len(folders.get(str(b), [])) >= COMPACT]
        for b in touched:
            folders[str(b)] = [*folders.get(str(b), []), f"{added}/bucket={b}"]
        if full:
            base = f"base/{manifest['number'] + 1}-{n}"
            whole = _last(store.rows({"buckets": folders}, full))  # deletions too, so that an older version that comes late stays out
            whole = whole.withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(BUCKETS)).cast("int"))
            whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{store.path}/{base}")
            folders |= {str(b): [f"{base}/bucket={b}"] for b in full}
        store.save({"number": manifest["number"] + 1, "batch": n, "key": key, "buckets": folders})
        for b in full:  # these rows are in the base, and no manifest names them
            store.delete(f"{added}/bucket={b}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
