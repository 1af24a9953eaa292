"""Quality rules: a threshold table compiled into one Spark projection.

Each rule is (name, measure, least, most). The measures are column expressions over the whole text (length, symbol,
stop-word, repeat and line ratios), bound once per row, so that the verdict is a single projection of built-in functions.

Defined cases: a null or wordless text has no words and fails the base rule; lines and windows are compared exactly,
windows by the 64-bit hash of their words; a document keeps one verdict however often it is repeated; columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in that is it for on with as was by are this be from or an at not a "
    "le la les de des du et en que qui un une dans pour sur est pas au "
    "der die das und in den von zu mit sich des auf ist im dem ein eine nicht "
    "el los las y del se por con una para es al como"
).split()
#: name, measure, least, most (None: no bound).
THRESHOLDS = (
    ("long_enough", "n_words", 20, None),
    ("word_length_low", "word_length", 1.5, None),
    ("word_length_high", "word_length", None, 25.0),
    ("symbols", "symbol_ratio", None, 0.30),
    ("stop_words", "stop_ratio", 0.004, None),
    ("repeated_lines", "line_ratio", None, 0.50),
    ("repeated_words", "repeat_ratio", None, 0.30),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more among ``words``, first occurrences included.

    Windows are hashed; sorting (hash, place) brings equal ones together, and the union of their ranges is summed from
    the sorted places, so that the cost of a text is n log n. Texts without any equal windows stop after one distinct.
    """

    def hashes(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        return let(h, lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW))))

    def covered(hs: Column) -> Column:
        rows = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["p"]))

        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last"))
        return let(rows, lambda s: F.aggregate(places(s), start, step, lambda a: a["sum"]))

    whole = let(hashes(words), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(covered(hs)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(whole)


def measures(text: Column) -> Column:
    """A struct of counts of the whole text; null counts as empty."""

    def of_words(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        plain = lambda x: F.lower(F.regexp_replace(x, r"[.,;:!?]+$", ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: plain(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop"),
        )

    words = lambda t: F.regexp_extract_all(t, F.lit(f"[^{SPACE}]+"), F.lit(0))
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of_words(t, w)))


def judged(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text") -> DataFrame:
    """Rows (row, q, base_failed, kept): docs' columns as a struct, so that they may have any names, the measures, and verdicts."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    measure = {
        "n_words": F.col("q.n_words"),
        "word_length": ratio("q.word_chars", "q.n_words"),
        "symbol_ratio": ratio("q.n_symbols", "q.n_words"),
        "stop_ratio": ratio("q.n_stop", "q.n_words"),
        "line_ratio": ratio("q.n_dup_lines", "q.n_lines"),
        "repeat_ratio": ratio("q.n_repeat_words", "q.n_words"),
    }
    passed = F.lit(True)
    for _, name, least, most in thresholds:
        if least is not None:
            passed = passed & (measure[name] >= F.lit(least))
        if most is not None:
            passed = passed & (measure[name] <= F.lit(most))
    base = (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measures(F.col(f"`{text}`")).alias("q"))
    return rows.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & passed)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged."""
    return judged(docs).where("kept").select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop"]
    return judged(docs).select("row.doc_id", *[F.col(f"q.{x}").alias(x) for x in q], "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, i - p))::BIGINT AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', '')) IN ({_STOP})))::BIGINT AS n_stop
      FROM w LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND word_chars >= 1.5::DOUBLE * n_words AND word_chars <= 25.0::DOUBLE * n_words AND n_symbols::DOUBLE / n_words <= 0.3::DOUBLE
    AND n_stop::DOUBLE / n_words >= 0.004::DOUBLE AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.5::DOUBLE) AS kept
FROM m
"""
