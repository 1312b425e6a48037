"""The opN queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from undertow.llm import bytecnn, decontaminate, exactdedup, hilbert, jaccard, langid, licenses, pieces, prefixtrie, tokenfile, toxicity, vectorcodes, wrapper
from undertow.llm.common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"), columns=["page_id", "url"])


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


def op5_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.report(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.report(documents(spark, sf_dir))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(_table(spark, sf_dir, "embeddings"))


def op12_bytecnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.report(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.report(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_toxicity, op3_wrapper, op4_jaccard, op5_exactdedup, op6_tokenfile, op7_hilbert, op8_langid, op9_pieces, op10_licenses, op11_vectorcodes, op12_bytecnn, op13_prefixtrie)
    return {f.__name__: f for f in own}
