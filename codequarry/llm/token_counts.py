"""Token counts through a digest cache.

The cache is a table (tokenizer, content, n_tokens): digests of a tokenizer file
and of normalised content. Counting joins the documents' digests with it,
encodes each distinct missing content once, appends those counts and joins
again, so a text that the cache knows is never encoded again.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import Scratch

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def version(path: str) -> str:
    """Digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def drops_white_space(path: str) -> bool:
    return path.endswith(".json") and bpe.codec(path).lowers


def content_digest(text: Column, path: str) -> Column:
    """SHA-256 of normalised text. Null is empty. Runs of white space become one space if the tokenizer drops white
    space anyway; for all others every character may matter, and only null is normalised."""
    text = F.coalesce(text, F.lit(""))
    if drops_white_space(path):
        text = F.regexp_replace(text, "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")
    return F.unhex(F.sha2(text, 256))


@functools.lru_cache(maxsize=4)
def counter(path: str):
    """A function from text to its number of tokens: tokenizers files (.json) or sentencepiece models (.model)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    return bpe.codec(path).count


def encode_misses(misses: DataFrame, path: str, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = pa.array([count(t or "") for t in batch.column("text").to_pylist()], pa.int64())
            names = pa.array([tokenizer] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([names, batch.column("content"), n], ["tokenizer", "content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) and drops `text`.

    cache: folder of the count table; made if absent, appended to if not. It may serve many tokenizers, and counts
    that two jobs appended twice count once. Null text counts as empty, with no tokens. Columns of the input that
    bear a result's name are replaced; the others stay. Repeated rows stay repeated; an empty table gives an empty
    one. Whole texts are counted, however long. A text that makes up a third of all rows is pre-aggregated before it is
    shuffled, encoded once, and its rows may be split when counts return to them.
    """
    spark, tokenizer = docs.sparkSession, version(path)
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    own = [c for c in kept.columns if c != "text"]
    keyed = kept.select(F.struct(*own, F.lit(0)).alias("doc"), "text", content_digest(F.col("text"), path).alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    known = _read(spark, cache, tokenizer)
    wanted = keyed.select("content", "text")
    if known is not None:
        wanted = wanted.join(known.select("content"), "content", "left_anti")
    misses = wanted.groupBy("content").agg(F.first("text").alias("text"))
    encode_misses(misses, path, tokenizer).write.mode("append").parquet(cache)
    # a written table, not an aggregate, on the small side of the join: only then can adaptive handling split the rows
    # of one content
    counts = Scratch(spark).cut(_read(spark, cache, tokenizer), "counts")
    out = keyed.drop("text").join(counts.hint("merge"), "content")
    return out.select(*(F.col("doc")[c].alias(c) for c in own), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _read(spark, cache: str, tokenizer: str) -> DataFrame | None:
    """The counts of one tokenizer; None if there is no table yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    schema = T._parse_datatype_string(CACHE_SCHEMA)
    rows = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
