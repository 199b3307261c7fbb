"""The corpus pipeline: quality, language, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import langid, packing, pii, quality, shingle_join
from tallgrass.llm.common import written

STAGES = [
    ("quality classifier", quality.stage),
    ("language id", langid.stage),
    ("n-gram jaccard join", shingle_join.stage),
    ("personal data", pii.stage),
    ("packing", packing.stage),
]
#: A trained model decides in the first stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
