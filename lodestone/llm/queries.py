"""The queries of the training-data operators, at their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.oracles import OP2_SQL, OP4_SQL, OP6_SQL, OP8_SQL, OP11_SQL, OP12_SQL, OP13_SQL


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), width=200)


def op3_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, tau=2)


def op4_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.recompression import recompression_dedup

    return recompression_dedup(table(spark, sf_dir, "documents"), width=35)


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.piece_lattice import segmentations

    return segmentations(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), best=4)


def op6_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fm_decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii_tagger import find_personal

    return find_personal(table(spark, sf_dir, "documents"))


def op8_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.shards import sharded

    return sharded(table(spark, sf_dir, "documents"), target_bytes=32 << 20, shard_rows=2000)


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.audio import audio_digest

    return audio_digest(table(spark, sf_dir, "documents"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_crf import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, "id % 100 = 0", scale=256, positives=5, negatives=10, least=30, most=90)


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"), least=0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_simhash_gph, op4_recompression_dedup, op5_piece_lattice, op6_fm_decontaminate, op7_pii_tagger, op8_tiered_shards, op9_telephony_audio, op10_language_crf, op11_filter_audit, op12_hard_negatives, op13_warc_salvage, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op4_recompression_dedup": OP4_SQL, "op6_fm_decontaminate": OP6_SQL, "op8_tiered_shards": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_warc_salvage": OP13_SQL}
