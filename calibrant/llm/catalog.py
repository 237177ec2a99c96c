"""Registered queries of the text operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from calibrant.llm import conversation_trie, exact_dedup, ngram_join, packing, personal_data, pieces, quality_gam, quality_rules, source_mix, substrings, token_alignment, token_counts, token_file
from calibrant.llm.common import table
from calibrant.llm.word_tokens import vocabulary_path
from calibrant.sources.tables import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-file")
    token_file.write_token_file(table(spark, sf_dir, "documents"), folder, vocabulary_path(WORDS))
    return token_file.read_documents(spark, folder)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(WORDS))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(WORDS))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score_documents(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("at")


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("at", "removed_lines")


def piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary_path(PIECES))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align_documents(docs, vocabulary_path(BYTES), vocabulary_path(PIECES))


def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_nodes(conversation_trie.rebuilt_sequences(table(spark, sf_dir, "conversations")))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed, those that the quality classifier scores high drawn more often."""
    docs = table(spark, sf_dir, "documents")
    score = quality_gam.scorer(quality_gam.train(docs, table(spark, sf_dir, "labels")))
    found = source_mix.mix(docs, score(F.coalesce("text", F.lit(""))))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": piece_ids,
        "op2_token_binary": token_binary,
        "op3_token_counts": counts,
        "op4_quality_rules": rules,
        "op5_quality_gam": quality,
        "op6_personal_data": personal,
        "op7_substring_dedup": repeats,
        "op8_ngram_jaccard_join": near_copies,
        "op9_exact_dedup": exact_copies,
        "op10_best_fit_packing": packed,
        "op11_token_alignment": alignment,
        "op12_conversation_trie": trie,
        "op13_source_mix": mixed,
    }
