"""The queries of this subpackage: one for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balanced_shards, centroid_clusters, common, decontaminate, hard_negatives, jaccard_groups, mixing, ngram_quality, packing, piece_counts, quality_rules, surrogates, token_store, toxicity
from .encoding import default_vocabulary


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to seekable files and read back."""
    folder = common.new_folder(spark, "tokens")
    return token_store.token_digest(common.table(spark, sf_dir, "documents"), default_vocabulary(), folder)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    return toxicity.scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), default_vocabulary())


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return surrogates.pseudonymised(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents measured and judged by the threshold table."""
    found = quality_rules.judged(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards, equal texts together as far as the sizes allow."""
    return balanced_shards.shard_documents(common.table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the window."""
    found = decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def op8_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 3-word shingles have a similarity of 0.9 or more, as classes."""
    found = jaccard_groups.jaccard_classes(common.table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links", "row_hash")


def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of all documents."""
    return piece_counts.piece_counts(common.table(spark, sf_dir, "documents"), default_vocabulary())


def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by a model of those labelled as of good quality."""
    trusted = common.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    found = ngram_quality.judged(common.table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), F.col("_floor").alias("floor"), F.col("_limit").alias("limit"), F.col("_kept").alias("kept"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, among all."""
    return hard_negatives.mine_embeddings(common.table(spark, sf_dir, "embeddings"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters."""
    return centroid_clusters.cluster_embeddings(common.table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words of each that a mix by the sources' weights takes."""
    return mixing.mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs", "cut")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_toxicity": op2_toxicity,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_surrogates": op4_surrogates,
    "op5_quality_rules": op5_quality_rules,
    "op6_balanced_shards": op6_balanced_shards,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard_groups": op8_jaccard_groups,
    "op9_piece_counts": op9_piece_counts,
    "op10_ngram_quality": op10_ngram_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_mixing": op13_mixing,
}

SQL: dict[str, str] = {
    "op5_quality_rules": quality_rules.sql(),
    "op11_hard_negatives": hard_negatives.sql(),
    "op12_centroid_clusters": centroid_clusters.sql(),
    "op13_mixing": mixing.sql(),
}
