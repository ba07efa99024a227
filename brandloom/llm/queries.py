"""The opN_ queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, chat, decontamination, fill_middle, html_text, packing, pii, sharding, simhash, spelling, substring_dedup, toxicity
from .common import stored, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.examples(turns.unionByName(chat.probe(spark))))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds recordings: each vector of embeddings is played as one, and those of queries (ids divisible by 50) once more, altered."""
    vectors, asked = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0
    prints = stored(audio.played_fingerprints(vectors, asked), "prints")
    return audio.summary(prints, (F.col("vec_id") >= 0) & asked, "vec_id")


def op9_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(spelling.variants(table(spark, sf_dir, "documents")))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(table(spark, sf_dir, "documents")))


def op13_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json")))


_ALL = (
    op1_decontamination, op2_sharding, op3_substring_dedup, op4_html_text, op5_simhash, op6_chat, op7_pii, op8_audio, op9_bpe, op10_toxicity,
    op11_spelling, op12_fill_middle, op13_packing,
)

QUERIES = {f.__name__: f for f in _ALL}
