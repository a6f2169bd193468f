"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes documents and returns documents (the last one pieces of sequences). All work on whole tables and
whole texts; what they keep between themselves is in tables in the shared folder.
"""

from __future__ import annotations

from codequarry.llm import packing, pii, quality, simhash, substrings
from codequarry.llm.common import Scratch, table
from codequarry.llm.queries import BYTE_BPE
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _documents(docs: DataFrame, text: Column, like: DataFrame) -> DataFrame:
    """The columns of `like`, held in docs' column doc, with a new text and n_chars to match it."""
    new = {"text": text}
    if "n_chars" in like.columns:
        new["n_chars"] = F.length(text).cast(like.schema["n_chars"].dataType)
    return docs.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in like.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quality.judge keeps, each as it is. Null and empty texts go; repeated rows stay or go together."""
    judged = quality.judge(docs.select(F.struct(*docs.columns).alias("whole"), "text", "lang"), carry=["whole"])
    return judged.where("kept").select("whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least doc_id, as it is.

    A document is its doc_id (nulls come last) and its text: rows that share both are one and leave one row; rows that
    share only the id are documents of their own, ordered by a hash of the text. Texts without words are one group."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    tagged = docs.select(own.alias("own"), F.struct(*docs.columns).alias("doc"))
    found = simhash.near_duplicates(tagged.select(F.col("own").alias("doc_id"), F.col("doc.text").alias("text")), Scratch(spark))
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("own")).distinct()
    # rows lie by `own` after the join, so numbering them shuffles nothing; a document has few rows
    nth = F.row_number().over(Window.partitionBy("own").orderBy(F.lit(0)))
    return tagged.join(first, "own", "left_semi").withColumn("nth", nth).where("nth = 1").select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that substrings.remove_repeats takes out. A text that loses none stays as it is, to
    the last space; the others are their kept words with one space between. Null text stays null."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    out = substrings.remove_repeats(rows, Scratch(spark))
    changed = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return _documents(out, changed, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null text stays null."""
    out = pii.redact(docs.select(F.struct(*docs.columns).alias("doc"), "text"))
    return _documents(out, F.col("text"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), BYTE_BPE, Scratch(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packed),
]

#: The divergence of histograms, the links and the network are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next one reads it."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
