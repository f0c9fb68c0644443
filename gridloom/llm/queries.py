"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    context_tree,
    decontaminate,
    fertility,
    grammar,
    html_text,
    licences,
    line_dedup,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    repair,
    token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; one row per piece."""
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=0
    )


@query
def op3_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, measures and verdict per document."""
    return fertility.rules(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


@query
def op6_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under a Jaccard similarity of 0.85 of three-word shingles."""
    return near_dedup.link(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op10_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document, from labels of rows that are not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query
def op5_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of each document's ids, read back from grammar-compressed files."""
    return grammar.store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op4_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without lines that equal, or nearly equal, an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, min_words=3, error_rate=0.05)


@query
def op7_pigeonhole_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents within five edits per hundred characters."""
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), error_rate=0.05)


@query
def op9_tree_model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query
def op2_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each field and line of every document."""
    return token_counts.count(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ("source", "lang", "text"), rule="most"
    )


@query
def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each document, from its paragraphs."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


@query
def op11_four_russians_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and checksum of every conversation after planted damage."""
    conversations = table(spark, sf_dir, "conversations")
    return repair.audits(repair.repair(repair.damage(conversations), conversations))


@query
def op12_ternary_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations whose first turns are those of their group's first one."""
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))))


@query
def op13_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each text, learned from rows that are not held out."""
    return context_tree.score(table(spark, sf_dir, "documents"), context_tree.fold(F.col("doc_id")) == 2)
