"""The queries of this subpackage over the synthetic tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import byte_pairs, decontamination, language_model, near_dedup, personal_data, pieces, search, secrets
from orderlens.llm import spelling, token_alignment, toxicity, url_rules, warc
from orderlens.llm.storage import shared_folder
from orderlens.llm.text import in_fold

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    items = read(spark, folder, "benchmark", "item_id", "text")
    return decontamination.contamination(decontamination.match_items(docs, items))


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 7, 2)
    model = language_model.count_filter(docs.where(~held_out))
    return language_model.scored(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.with_originals(read(spark, folder, "pages", "page_id", "url", "html"))
    manifest = warc.write_archives(records, shared_folder(spark, "warc"))
    return warc.read_archives(spark, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def toxic_model(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.ToxicModel:
    """Learnt from the documents and labels outside of the held-out fold."""
    labels = read(spark, folder, "labels", "doc_id", "toxic")
    return toxicity.train(docs, labels, ~in_fold(F.col("doc_id"), 5, 0))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    scores = toxicity.scored(docs, toxic_model(spark, docs, folder))
    return scores.select(
        "doc_id",
        in_fold(F.col("doc_id"), 5, 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def piece_rows(docs: DataFrame) -> DataFrame:
    """doc_id, ids of the pieces, their number, and whether they decode to the text."""
    rows = pieces.round_trip(docs.select("doc_id", "text"), pieces.read_vocabulary())
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", same.alias("round_trip"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_rows(read(spark, folder, "documents", "doc_id", "text"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), percent=85)


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(read(spark, folder, "pages", "page_id", "url"), URL_RULES)


def is_kind(kind: int | str) -> Callable[[Column], Column]:
    return lambda span: span["rank" if isinstance(kind, int) else "kind"] == kind


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    found = secrets.with_spans(docs, secrets.log_ratios(docs))
    counts = [
        F.size(F.filter("base_spans", is_kind(i))).cast("bigint").alias(f"n_{kind}")
        for i, kind in enumerate(secrets.KINDS[:3])
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.joined_spans("base_spans"), 256).alias("base_sha256"),
        secrets.joined_spans("spans").alias("spans"),
    )


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    found = personal_data.found(docs, personal_data.train(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [
        F.size(F.filter("base_spans", is_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in personal_data.BASE
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def op10_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.top_k(read(spark, folder, "documents", "doc_id", "text"), F.col("doc_id") % 100 == 0)
    return found.withColumn("score", F.round("score", 6))


def op11_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = byte_pairs.round_trip(docs, byte_pairs.tables(ranks, public_tokenizers.PATTERN))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, folder, "documents", "doc_id", "text"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, folder, "documents", "doc_id", "text")
    return token_alignment.measures(docs, token_alignment.read_tokenizers(a, b))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_language_model": op3_language_model,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_rules": op7_url_rules,
    "op8_secrets": op8_secrets,
    "op9_personal_data": op9_personal_data,
    "op10_search": op10_search,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_spelling": op12_spelling,
    "op13_token_alignment": op13_token_alignment,
}
