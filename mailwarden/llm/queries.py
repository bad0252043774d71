"""The registered queries: each operator over its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from mailwarden.llm import (embedding_dedup, html_text, jaccard_join, license_scan, packing, prefix_trie, quality_classifier, quality_rules, secret_scan,
                            sentencepiece_lattice, substring_dedup, twins, warc, whitening)
from mailwarden.llm.common import read

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = twins.SQL


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(read(spark, sf_dir, "documents"))


@query
def op6_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op7_warc_revisit(spark, sf_dir):
    return warc.deduplicated(spark, read(spark, sf_dir, "pages"))


@query
def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


@query
def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


@query
def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


@query
def op8_sentencepiece_lattice(spark, sf_dir):
    """Conversation turns, encoded and decoded again."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = sentencepiece_lattice.decode(sentencepiece_lattice.encode(turns))
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), "ids",
                      F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query
def op12_conversation_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


@query
def op13_html_extraction(spark, sf_dir):
    return html_text.html_text(read(spark, sf_dir, "pages"))
