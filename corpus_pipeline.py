"""A corpus from raw documents: toxicity, language, near-duplicates, source mix, token ids.

Every stage works on all documents that its predecessor kept. The first four return the columns of
``documents``; the last returns the ids of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.llm import langid, minhash, mixing, spm, toxicity
from tesselle.llm.langid import fold
from tesselle.llm.queries import table, tokenizer_file
from tesselle.llm.storage import discard, materialize

#: A declared language is overruled where another one fits so much better.
LANGUAGE_MARGIN = 0.25
#: Documents whose 5-word shingle sets are alike to so many hundredths are near-duplicates.
SIMILAR = 80


def _packed(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row beside it under a name of its own, so that no other column can clash."""
    return docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. The classifier learns from the labelled ones outside the held-out fifth."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(_packed(docs), model, ["__row"]).filter(F.col("score") < 0.5).select("__row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter in them, or a text far from the language they declare.

    Far means that the best language's cosine exceeds the declared one's by LANGUAGE_MARGIN; a null
    or unknown declaration rejects nothing.
    """
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    got = langid.predict(_packed(docs), model, ["__row"], declared="lang")
    far = F.coalesce(F.col("score") - F.col("declared_score") > LANGUAGE_MARGIN, F.lit(False))
    return got.filter((F.col("lang_pred") != langid.UND) & ~far).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows of one id stay or go together."""
    gone = minhash.link_components(docs, SIMILAR).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at each source's cut one is shortened to the words taken."""
    return mixing.repeat_taken(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids (little-endian unsigned 32-bit integers) of every document of the mix."""
    ids = spm.encode(docs, tokenizer_file("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "ids")


STAGES = [("toxicity", toxic), ("language", language), ("near duplicates", near_duplicates), ("mix", mix), ("token ids", token_ids)]

#: Trained models and segmentations are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage{k}")
        discard(before)
    return docs
