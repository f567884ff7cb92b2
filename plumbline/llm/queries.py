"""The registered queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bm25, collocations, covertree, langid, max_tree, mixing, oracles, quality, sharding, simhash, suffix_dedup, super_kmers, url_filter
from .bpe import encoding_digests
from .common import table


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op8_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op3_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op6_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"))


def op7_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"))


def op10_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.removal_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_language_id": op1_crf_language_id,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_link_graph_filter": op3_link_graph_filter,
    "op4_bpe_automaton": op4_bpe_automaton,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_cover_tree_dedup": op6_cover_tree_dedup,
    "op7_hierarchical_mixing": op7_hierarchical_mixing,
    "op8_ftrl_quality": op8_ftrl_quality,
    "op9_block_max_wand": op9_block_max_wand,
    "op10_gray_simhash": op10_gray_simhash,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_max_tree_search": op12_max_tree_search,
    "op13_super_kmer_dedup": op13_super_kmer_dedup,
}
ORACLES: dict[str, str] = {
    "op7_hierarchical_mixing": oracles.OP7,
    "op11_phrase_collocations": oracles.OP11,
    "op12_max_tree_search": oracles.OP12,
    "op13_super_kmer_dedup": oracles.OP13,
}
