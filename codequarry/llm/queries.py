"""The registered queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, packing, pii, quality, simhash, substrings, token_counts, topk, urls
from .common import Scratch, new_path, table

#: The tokenizer files of the registered queries; the operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, Scratch(spark), 10, 1024)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a folder named by spark.codequarry.tokenCounts keeps the cache from run to run
    cache = spark.conf.get("spark.codequarry.tokenCounts", None) or new_path(spark, "token-counts")
    return token_counts.count_tokens(docs, WORD_BPE, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])


def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, Scratch(spark))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_token_counts": op3_token_counts,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_quality_rules": op6_quality_rules,
    "op7_shortest_pack_first": op7_shortest_pack_first,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_url_filters": op10_url_filters,
}
ORACLES: dict[str, str] = {
    "op1_exact_top_k": topk.SQL,
    "op5_perspective_rotation": chat.SQL,
    "op8_substring_dedup": substrings.SQL,
    "op10_url_filters": urls.sql(),
}
