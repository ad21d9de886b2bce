"""The corpus pipeline: from raw documents to shards of a training mix.

Each stage is (name, function of (spark, docs, sf_dir)); its rows are written and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from petriflow.llm.common import save
from petriflow.llm.decontaminate import drop_leaks
from petriflow.llm.mixing import mix_documents
from petriflow.llm.quality import keep_good
from petriflow.llm.sharding import shard_documents
from petriflow.llm.simhash import keep_one

STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_one),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_documents),
    ("sharding", shard_documents),
]

#: Models are fitted and graphs closed on the way: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
