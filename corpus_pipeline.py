"""A corpus pipeline over ``documents``: quality rules, language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. ``run`` gives each stage a scope: its scratch tables are deleted once its rows are written.

Defined cases, of stages one by one: a null, empty or wordless text fails the quality rules and goes; a text without a
letter or of unclear language goes; of each class of near-duplicates the row of the smallest doc_id stays, rows with a
null doc_id or without words all stay; repeated passages are cut from all but their first document, one that this leaves
without a word goes; packing cuts only documents longer than a sequence. Equal rows are one class. Other columns, of any
names, come through unchanged, but for n_chars where text was cut. Empty tables give empty results; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm.common import delete, keep, scratch, scratch_path
from lodeworks.llm.jaccard import near_duplicate_filter
from lodeworks.llm.language import language_filter
from lodeworks.llm.packing import pack
from lodeworks.llm.passages import remove_repeats
from lodeworks.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return language_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicate_filter(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("quality rules", quality), ("language ID", language), ("near duplicates", near_duplicates), ("substring dedup", repeats), ("packing", packing)]

#: SQL has no classifier, tokenizer or packing search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what comes between them is written to the shared folder, and goes once it is read."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with scratch(spark):
        for _, step in STAGES[:-1]:
            path = scratch_path(spark, "docs")
            with scratch(spark):
                out = step(spark, docs, sf_dir)
                out.write.parquet(path)
            if last:
                delete(spark, last)
            docs, last = spark.read.schema(out.schema).parquet(path), path
        return keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
