"""Registered queries of this folder: thin digests of the operators."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import (
    alignment,
    exact_dedup,
    fingerprint,
    language,
    lexical,
    line_dedup,
    minhash,
    mixing,
    near_dup,
    pieces,
    pii,
    quality,
    url_filter,
)
from turnwise.llm.common import documents
from turnwise.sources.session import configure


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(configure(spark), sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(configure(spark), sf_dir).select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(configure(spark), sf_dir)
    return near_dup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = configure(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge_urls(pages, rounds=None).select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(configure(spark), sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(configure(spark), sf_dir).select("doc_id", "text")
    held_out = quality.held_out()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs.where(~held_out), labels.where(~held_out))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(documents(configure(spark), sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(configure(spark), sf_dir).select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_texts(docs, model, keep_ids=False, keep=["doc_id"])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(configure(spark), sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(configure(spark), sf_dir).select("doc_id", "text", "lang")
    held_out = language.held_out()
    model = language.fit_languages(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_copies(documents(configure(spark), sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.search(documents(spark, sf_dir), items)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(configure(spark), sf_dir)
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.score_links(alignment.align_texts(docs, *paths, keep_groups=False))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_line_dedup,
        op3_near_duplicates,
        op4_url_filter,
        op5_mixing,
        op6_quality,
        op7_personal_data,
        op8_pieces,
        op9_fingerprints,
        op10_language,
        op11_minhash,
        op12_lexical_search,
        op13_alignment,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
