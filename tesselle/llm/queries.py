"""The registered queries of this subpackage: thin plans over its operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.llm import chat, embed_dedup, langid, licenses, minhash, mixing, ogg, spm, tokenbin, toxicity
from tesselle.llm.langid import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: under $TOKENIZER_DIR if set, else where the installed package has it."""
    if os.environ.get("TOKENIZER_DIR"):
        return os.path.join(os.environ["TOKENIZER_DIR"], name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.tokenize_to_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.decode_media(ogg.encode_media(table(spark, sf_dir, "documents")))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_components(table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Trained on labelled documents outside the held-out fifth."""
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    scored = toxicity.score(table(spark, sf_dir, "documents"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    """Learned from documents outside the held-out quarter."""
    return langid.fit(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) != 2)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = langid.predict(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_chat_perspectives, op3_token_shards, op4_mix, op5_toxicity, op6_ogg_media, op7_embedding_dedup, op8_language, op9_license_scan, op10_sentencepiece)}

ORACLE_SQL = {"op2_chat_perspectives": chat.SQL, "op4_mix": mixing.SQL}
