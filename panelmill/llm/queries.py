"""Registered queries over the operators, with the SQL that states their result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import (
    arrow_output, bpe, collocations, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, merkle, minhash_dedup, oracles,
    pii_crf, prefix_trie, secret_scan,
)

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; every executor has them."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(_table(spark, sf_dir, "documents"))
    each = F.transform("notices", lambda n: F.concat_ws(
        ":", n["license"], n["start"].cast("string"), n["end"].cast("string"), F.round(n["coverage"], 4).cast("string")))
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["coverage"])), F.lit(0.0))
    return out.select(
        "doc_id", F.size("notices").cast("long").alias("n_notices"), best.alias("coverage"), F.array_join(each, ",").alias("notices"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def _listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_crf.find(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", *(_count("base", kind) for kind in pii_crf.BASE_KINDS),
        F.sha2(F.encode(_listed("base"), "UTF-8"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), minhash_dedup.NearDup(similarity=85))


def op6_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_output.encode_and_check(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.without_repeated_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", *(_count("base", kind) for kind in secret_scan.BASE_KINDS),
        F.sha2(F.encode(_listed("base"), "UTF-8"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), collocations.Mining(min_count=30, inside_percent=80, top=2000))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_pii_crf": op4_pii_crf,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_arrow_output": op6_arrow_output,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_secret_scan": op9_secret_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_merkle": op12_merkle,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = {
    "op3_embedding_dedup": oracles.VECTOR_DUPLICATES,
    "op5_minhash_dedup": oracles.NEAR_DUPLICATES,
    "op7_line_dedup": oracles.LINE_DEDUP,
    "op8_decontaminate": oracles.CONTAMINATION,
    "op11_collocations": oracles.COLLOCATIONS,
    "op12_merkle": oracles.MERKLE,
    "op13_prefix_trie": oracles.PREFIX_TRIE,
}
