"""A corpus pipeline of five stages; each takes the documents that its predecessor kept.

Stages keep all columns of their documents, also those that bear the name of a column that an operator adds.
An empty table passes through all of them. Rows with a null doc_id are judged as all others; rows repeated with
one doc_id and text stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import work_dir, written
from undertow.llm.decontaminate import ADDED, decontaminate
from undertow.llm.exactdedup import exact_dedup
from undertow.llm.jaccard import jaccard_components
from undertow.llm.langid import fit_languages, predict_languages
from undertow.llm.pieces import encode_pieces

NEAR_SHINGLE, NEAR_NUMER, NEAR_DENOM = 5, 80, 100  # near copies: words of a shingle, and the least Jaccard share


def apart(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` with other names for columns named as those that an operator adds; see ``back``."""
    return docs.withColumnsRenamed({c: f"{c}__own" for c in docs.columns if c in added})


def back(told: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return told.select(*(F.col(f"`{c}__own`").alias(c) if f"{c}__own" in told.columns else F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; without a letter or a clear language they go.

    A language is clear if its machine's margin against the rest reaches the model's limit, which is chosen on
    labelled rows. A corpus of one language has no rest, and all its texts with a letter stay. Null and empty
    texts go, and without any labelled row all documents go.
    """
    model = fit_languages(docs, clear=True)
    told = predict_languages(apart(docs, "lang_pred", "score", "margin"), model, margin=True)
    return back(told.where((F.col("lang_pred") != "und") & (F.col("margin") >= model.limit)), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id. Null and empty texts are equal."""
    return back(exact_dedup(apart(docs, "keep_id", "group_size", "kept", "text_sha256")).where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones (5-word shingles, Jaccard 0.8): that of the smallest doc_id.

    Texts without words link with nothing and stay. Rows are told apart by doc_id and text together: several texts of
    one doc_id, or without one, are judged one by one, a null doc_id counting as larger than all others. Should two rows
    ever share the 64 bits that stand for them, both stay.
    """
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = jaccard_components(rows.select("_row", "text"), key="_row", shingle=NEAR_SHINGLE, numer=NEAR_NUMER, denom=NEAR_DENOM)
    told = groups.groupBy("_row").agg(F.min("component_id").alias("group"), F.max("component_id").alias("other")).where("group = other")
    told = written(told.select("_row", "group"), "near-groups")
    several = told.where("group <> _row").select("group").distinct()
    members = told.join(several, "group").join(rows.select("_row", "doc_id").distinct(), "_row")
    stays = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    kept = members.groupBy("group").agg(F.min(stays).alias("x")).select(F.col("x._row").alias("_row"))
    gone = members.select("_row").join(kept, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item: the limit of coverage is 0. Null texts have none and stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    told = decontaminate(apart(docs, *ADDED), items, coverage_limit=0.0)
    return back(told.where(~F.col("dropped")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' piece ids; null and empty texts have none."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(docs, model, columns=["doc_id", "lang", "source"])


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("encode", encode)]
ORACLE_SQL = None  # SQL has no word for the language and piece stages; tests hold the others against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
