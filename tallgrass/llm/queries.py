"""The operators' queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chroma, elkan, imatch, langid, licenses, merkle, oracles, oracles_exact, packing, pages, pii, quality, shingle_join, simhash, unigram
from .common import tables


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each embedding is rendered as a recording first."""
    return chroma.matches(chroma.rendered(tables(spark, sf_dir, "embeddings")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(tables(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(tables(spark, sf_dir, "documents"))


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(tables(spark, sf_dir, "pages"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(tables(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tables(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(tables(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(tables(spark, sf_dir, "documents"))


def op9_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.tokenise(tables(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(tables(spark, sf_dir, "documents"))


def op11_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster(tables(spark, sf_dir, "embeddings")).drop("n_distances")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(tables(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chroma, op2_pii, op3_imatch, op4_pages, op5_shingle_join, op6_packing, op7_quality, op8_language, op9_unigram, op10_licenses, op11_elkan, op12_merkle, op13_simhash)}
QUERIES |= oracles.QUERIES
ORACLES: dict[str, str] = oracles.ORACLES | {"op11_elkan": oracles_exact.CLUSTER, "op12_merkle": oracles_exact.manifest()}
