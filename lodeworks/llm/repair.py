"""Conversation structure repair by iterative-deepening A*.

The rows of a conversation, in order of turn, are edited until the initials of their roles read ``(s?(ua)+)?``. Edits and
costs: Delete 3, Insert an empty turn of user or assistant 2, Keep 0, Rerole to user or assistant 2; a row whose first fault
is truncation adds 1 unless it is deleted, one that is blank or a duplicate must be deleted. The answer is the cheapest
list of edits, of several the one whose initials are least in ASCII order.

``search`` looks for it depth first, edits in ASCII order, under a bound of cost that grows by one; a table holds for each
state (row, state of the pattern) the largest budget that failed there, and the first accepting path is the answer. It is
run on segments of ``SEGMENT`` rows with the cost of what follows at their end, from the last segment to the first, so that
work is linear in the rows. A segment's end is where its last row is used up; inserts belong to the row after them. So no
answer of a segment is a prefix of another, and least segments make a least whole.

Long conversations are split: rows are placed by a range sort, and every ``CHUNK`` rows are one task row, a letter a turn.
Chunks of one conversation meet twice as 16 costs a chunk, to learn the cost of what follows and the state before each.

Defined cases: null roles and texts count as one space, null turns come first, null conversations are one conversation;
rows of one turn stand in order of role, then of a digest of role and text, equal rows side by side; roles other than those
that begin with s, u or a, the empty one too, can be deleted or reroled, not kept; without rows nothing is repaired; empty
tables give empty ones; columns beside those named are ignored, and may have any name; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import partitions, ranked, scratch, stage

SEGMENT, CHUNK = 16, 4096
INF = 1 << 40
# Costs of edits, and what an undeleted truncated row adds.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
# The pattern (s?(ua)+)? as states: begin, after s, after u, after a; where each role leads, and where it may end.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = ("u", "u", "a", "u")
END = (0, INF, INF, 0)
NAMES = {"u": "user", "a": "assistant"}
#: A letter a turn: role (s, u, a or x) in lower case; A-D, by fault: none, truncated, duplicate, blank.
ROLES, FAULTS = "suax", "ctdb"
SPACES = r"\x20\x09-\x0D"


def letter(role: str, fault: str) -> str:
    return chr(65 + 4 * ROLES.index(role) + FAULTS.index(fault))


def _read(x: str) -> tuple[str, str]:
    r, f = divmod(ord(x) - 65, 4)
    return ROLES[r], FAULTS[f]


@lru_cache(maxsize=1 << 16)
def search(rows: str, begin: int, after: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    """(cost, edits, state at the end) of the least path over rows from state ``begin``; ``after`` is the cost from each state on.

    Only the last rows of a conversation may be followed by inserts. A cost of INF: there is no path.
    """
    turns, n = [_read(x) for x in rows], len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + {"c": 0, "t": TRUNCATED, "d": DELETE, "b": DELETE}[turns[i][1]]
    # inserts and deletes lead to 2, 3 and where it began; only a system turn that may be kept leads to 1
    near = {2, 3, begin} | ({1} if begin == 0 and any(role == "s" and fault in "ct" for role, fault in turns) else set())
    least = min(after[q] for q in near)
    if least >= INF:
        return INF, "", begin
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def go(i: int, q: int, budget: int) -> int:
        """The state at the end of the first accepting path of at most this cost from (i, q), or -1; the path is in ``path``."""
        if budget < rest[i] + least or failed.get((i, q), -1) >= budget:
            return -1
        if i == n and after[q] <= budget:
            return q
        moves = []
        if i < n:
            role, fault = turns[i]
            moves.append(("D", DELETE, i + 1, q))
        if i < n or last:
            moves.append(("I", INSERT, i, STEP[q][NEXT[q]]))
        if i < n and fault in "ct":
            more = TRUNCATED if fault == "t" else 0
            if role in STEP[q]:
                moves.append(("K", KEEP + more, i + 1, STEP[q][role]))
            moves.append(("R", REROLE + more, i + 1, STEP[q][NEXT[q]]))
        for name, cost, j, t in moves:
            path.append(name)
            end = go(j, t, budget - cost)
            if end >= 0:
                return end
            path.pop()
        failed[i, q] = budget
        return -1

    bound = rest[0] + least
    while (end := go(0, begin, bound)) < 0:
        bound += 1
    return bound, "".join(path), end


def solve(rows: str, after: tuple[int, ...], last: bool, begins: tuple[int, ...] = (0, 1, 2, 3)) -> dict[int, tuple[int, str, int]]:
    """For each state to begin in: (cost, edits, state at the end) over a chunk of rows, by segments from the last."""
    cuts, found = list(range(0, len(rows), SEGMENT)) or [0], []
    for at in reversed(cuts):
        low = min(after)
        if low >= INF:
            return {q: (INF, "", q) for q in begins}
        shifted = tuple(x - low if x < INF else INF for x in after)
        part = {q: search(rows[at : at + SEGMENT], q, shifted, last and at == cuts[-1]) for q in (begins if at == 0 else range(4))}
        part = {q: (c + low if c < INF else INF, s, t) for q, (c, s, t) in part.items()}
        found.append(part)
        after = tuple(part[q][0] if q in part else INF for q in range(4))
    out = {}
    for q in begins:
        edits, at = [], q
        for part in reversed(found):
            _, s, at = part[at]
            edits.append(s)
        out[q] = (after[q], "".join(edits), at)
    return out


def matrix(rows: str) -> list[int]:
    """The 16 costs from each state before a chunk to each state after it."""
    ends = [solve(rows, tuple(0 if q == t else INF for q in range(4)), False) for t in range(4)]
    return [ends[t][q][0] for q in range(4) for t in range(4)]


def steps(rows: str, edits: str, begin: int) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, place among what stands before it, edit, new role) of each row that edits leave."""
    i, k, q = 0, 0, begin
    for e in edits:
        if e == "D":
            i, k = i + 1, 0
            continue
        role = _read(rows[i])[0] if e == "K" else NEXT[q]
        yield i, k, e, None if e == "K" else NAMES[role]
        q = STEP[q][role]
        i, k = (i, k + 1) if e == "I" else (i + 1, 0)


def plain(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) without null roles and texts, and with ``key``, equal for equal rows."""
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return rows.withColumn("said", F.unhex(F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8")))).withColumn(
        "key", F.unhex(F.md5(F.concat(F.encode(F.concat(known("conv_id"), F.lit(":"), known("turn"), F.lit(":")), "utf-8"), F.col("said"))))
    )


def _faults(text: Column) -> Column:
    solid = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(solid == "", "b").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "t").otherwise("c")


def _letters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, c, place, key, letter, n), and (conv_id, c, n, gaps); c is the place of a conversation's first row."""
    narrow = rows.select("conv_id", "turn", "role", "said", "key", _faults(F.col("text")).alias("fault"), F.monotonically_increasing_id().alias("_u"))
    placed = stage(ranked(narrow, ["conv_id", "turn", "role", "said", "_u"], "place").drop("_u"), "placed")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    convs = stage(placed.groupBy("conv_id").agg(F.min("place").alias("c"), F.count("*").alias("n"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps")), "convs")
    own = convs.select(F.col("conv_id").alias("_id"), "c", "n")
    placed = stage(placed.join(own, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id", "turn"), "own")
    again = placed.where("fault <> 'b'").groupBy("c", "said", "role").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    placed = placed.join(again.select("c", "said", "role", "first"), ["c", "said", "role"], "left")
    fault = F.when((F.col("fault") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("fault"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    code = 65 + 4 * (F.instr(F.lit(ROLES), initial) - 1) + F.instr(F.lit(FAULTS), fault) - 1
    return placed.select("conv_id", "c", "n", "place", "key", F.char(code).alias("letter")), convs


def _summed(s: str) -> list[int]:
    """blank, duplicate, truncated and illegal of a chunk."""
    x = np.frombuffer(s.encode(), np.uint8) - 65
    r, f = x // 4, x % 4
    pair = r[:-1] * 4 + r[1:]
    legal = np.isin(pair, [ROLES.index(a) * 4 + ROLES.index(b) for a, b in ("su", "ua", "au")])
    return [int((f == FAULTS.index(k)).sum()) for k in "bdt"] + [int((~legal).sum())]


def _mapped(df: DataFrame, kind: str, f) -> DataFrame:
    """df through f, a row at a time; a row may give many."""
    names = [x.split()[0] for x in kind.split(", ")]

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 1024):
                rows = [x for r in pdf.iloc[at : at + 1024].itertuples(index=False) for x in f(r)]
                yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, kind)


def _following(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's chunks (chunk, costs): the cost of what follows each, from each state."""
    # the costs of a last chunk leave out inserts behind it: two from state 1, one from state 2
    after, out = [0, 2 * INSERT, INSERT, 0], []
    pdf = pdf.sort_values("chunk")
    for costs in pdf["costs"][::-1]:
        out.append(after if out else list(END))
        after = [min(costs[4 * q + t] + after[t] for t in range(4)) for q in range(4)]
        after = [min(x, INF) for x in after]
    return pd.DataFrame({"c": pdf["c"], "chunk": pdf["chunk"], "after": out[::-1]})


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's chunks (chunk, ends): the state before each."""
    pdf, at, out = pdf.sort_values("chunk"), 0, []
    for ends in pdf["ends"]:
        out.append(at)
        at = ends[at]
    return pd.DataFrame({"c": pdf["c"], "chunk": pdf["chunk"], "entry": pd.array(out, "int32")})


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (conv_id, c, place, at, edit, role, text), in order of (c, place, at), of rows (conv_id, turn, role, text), and
    one row a conversation: conv_id, c, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    with scratch(rows.sparkSession):
        return _repair(plain(rows))


def _repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    letters, convs = _letters(rows)
    letters = stage(letters.withColumn("chunk", F.expr(f"(place - c) div {CHUNK}L")), "letters")
    chunks = letters.groupBy("c", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "letter"))).alias("x"), F.max("n").alias("n"))  # CHUNK rows at most
    chunks = stage(chunks.select("c", "chunk", F.array_join(F.col("x.letter"), "").alias("rows"), F.expr(f"(n - 1) div {CHUNK}L").alias("final")), "chunks")
    sums = _mapped(chunks.select("c", "rows"), "c long, blank long, duplicate long, truncated long, illegal long", lambda r: [(r.c, *_summed(r.rows))])
    # pairs of rows where one chunk ends and the next begins
    edge = chunks.where("final > 0").select("c", "chunk", F.left("rows", F.lit(1)).alias("a"), F.right("rows", F.lit(1)).alias("b"))
    role = lambda x: F.substring(F.lit(ROLES), (F.expr(f"(ascii({x}) - 65) div 4") + 1).cast("int"), F.lit(1))
    joints = edge.select("c", "chunk", role("b").alias("p")).join(edge.select("c", (F.col("chunk") - 1).alias("chunk"), role("a").alias("q")), ["c", "chunk"])
    joints = joints.where(~F.concat("p", "q").isin("su", "ua", "au")).groupBy("c").agg(F.count("*").alias("joints"))
    # what follows: nothing for most chunks, else by the costs of the conversation's other chunks
    many = chunks.where("final > 0")
    costs = _mapped(many.select("c", "chunk", "rows"), "c long, chunk long, costs array<long>", lambda r: [(r.c, r.chunk, matrix(r.rows))])
    after = stage(costs.groupBy("c").applyInPandas(_following, "c long, chunk long, after array<long>"), "after")
    ready = chunks.where("final = 0").withColumn("after", F.array(*[F.lit(x).cast("long") for x in END])).unionByName(many.join(after, ["c", "chunk"]))

    def work(r):
        begins = (0,) if r.chunk == 0 else (0, 1, 2, 3)
        got = solve(r.rows, tuple(int(x) for x in r.after), r.chunk == r.final, begins)
        return [(r.c, r.chunk, r.rows, r.final, *([got[q][k] if q in got else none for q in range(4)] for k, none in ((0, INF), (1, ""), (2, 0))))]

    kind = "c long, chunk long, rows string, final long, costs array<long>, edits array<string>, ends array<int>"
    solved = stage(_mapped(ready.select("c", "chunk", "rows", "final", "after"), kind, work), "solved")
    entry = solved.where("final > 0").select("c", "chunk", "ends").groupBy("c").applyInPandas(_entries, "c long, chunk long, entry int")
    solved = solved.join(entry, ["c", "chunk"], "left").na.fill(0, ["entry"]).withColumn("audit", F.expr("edits[entry]"))
    solved = stage(solved.select("c", "chunk", "rows", "entry", "audit", F.when(F.col("chunk") == 0, F.col("costs")[0]).alias("cost")), "solved")
    whole = solved.groupBy("c").agg(F.max("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "audit")))["audit"], "").alias("audit"))
    report = convs.join(sums.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")]), "c").join(joints, "c", "left").join(whole, "c")
    report = report.select("conv_id", "c", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("joints", F.lit(0))).alias("illegal"), "cost", "audit")

    def left(r):
        base = r.c + r.chunk * CHUNK
        return [(r.c, base + i, k, e, role) for i, k, e, role in steps(r.rows, r.audit, r.entry)]

    edits = stage(_mapped(solved.select("c", "chunk", "rows", "entry", "audit"), "c long, place long, at int, edit string, new string", left), "edits")
    # of equal rows only the first can be left, so a row is found by its key
    held = letters.select("conv_id", "c", "place", "key").join(edits.where("edit <> 'I'"), ["c", "place"])
    texts = rows.groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    held = texts.join(held, "key").select("conv_id", "c", "place", "at", "edit", F.coalesce("new", "role").alias("role"), "text")
    added = edits.where("edit = 'I'").join(convs.select("conv_id", "c"), "c").select("conv_id", "c", "place", "at", "edit", F.col("new").alias("role"), F.lit("").alias("text"))
    return common.keep(held.unionByName(added), "repaired"), common.keep(report, "report")


def digests(repaired: DataFrame) -> DataFrame:
    """Rows (c, repaired_sha256): of each conversation's ``role:text`` lines, read in order and never held together."""

    def run(batches):
        now, h = None, None
        for b in batches:
            out = []
            for c, line in zip(b.column(0).to_pylist(), b.column(1)):
                if c != now:
                    if h:
                        out.append((now, h.hexdigest()))
                    now, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["c", "sha"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["c", "sha"])

    lines = repaired.select("c", "place", "at", F.concat("role", F.lit(":"), "text").alias("line")).repartition(partitions(repaired.sparkSession), "c")
    return lines.sortWithinPartitions("c", "place", "at").select("c", "line").mapInArrow(run, "c long, sha string").withColumnRenamed("sha", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), damaged by a checksum of conv_id and turn."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    # By remainder 0 drop, 1 empty, 2 without marks, 3 twice, 4 user
    k = F.crc32(F.encode(F.concat(some("conv_id"), F.lit(":"), some("turn")), "utf-8")) % 20
    rows = rows.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k")
    return rows.withColumn("_t", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_t", "k")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """What repairing the damaged conversations takes, for every conversation that there was."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    with scratch(spark):
        repaired, report = repair(damage(rows))
        report = report.join(digests(repaired), "c", "left").drop("c").withColumnRenamed("conv_id", "_id")
        all_ = rows.select("conv_id").distinct()
        out = all_.join(report, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        none = F.lit(hashlib.sha256(b"").hexdigest())
        return common.keep(out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256")), "repair")
