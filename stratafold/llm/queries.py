"""The operators' queries for the driver: opN_<name> over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm import chat, filter_audit, fingerprints, language, lm_scoring, media, mixing, packing, phrases, quality, simhash_pivot, toxicity, vector_packing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = quality.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return weights.select("doc_id", "n_grams", "log_weight", "chance", "gumbel_key", "selected")


def op4_progressive_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.encode(table(spark, sf_dir, "documents")))


def op5_boosted_tree_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_simhash_pivot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivot.near_duplicates(table(spark, sf_dir, "documents"))


def op7_evidence_fusion_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"), language.train(table(spark, sf_dir, "documents")))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash_block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op10_chat_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.planted(spark))
    return chat.read_back(chat.format_chats(turns))


def op11_vector_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(table(spark, sf_dir, "documents"))


def op12_suffix_automaton_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_cross_entropy_difference, op2_splitting_tree_mix, op3_importance_resampling, op4_progressive_jpeg_media, op5_boosted_tree_toxicity, op6_simhash_pivot_tables, op7_evidence_fusion_language, op8_sum_of_squares_packing, op9_simhash_block_tables, op10_chat_state_machine, op11_vector_best_fit_packing, op12_suffix_automaton_collocations, op13_filter_interaction_audit)}
ORACLE_SQL: dict[str, str] = {"op2_splitting_tree_mix": mixing.ORACLE, "op10_chat_state_machine": chat.ORACLE, "op12_suffix_automaton_collocations": phrases.ORACLE, "op13_filter_interaction_audit": filter_audit.ORACLE}
