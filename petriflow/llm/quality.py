"""Quality classifier: naive Bayes support vectors on n-gram indicators.

The model is fitted on the driver from at most MAX_TRAIN labelled rows (a documented bound; rows picked by hash of the id) in
a bounded feature space; every whole text is scored on the executors.

Defined results: null and empty texts get the score of a text without n-grams; repeated rows are scored alike; labels that
are null or name no document are left out; without labels every score is 1/2; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petriflow.llm.ngrams import SHAPES, TRIGRAMS, Linear, fit, indicators, labelled_rows, pieces

#: Labelled rows that the model is fitted on at most.
MAX_TRAIN = 4000
#: Least score of a text that is kept.
THRESHOLD = 0.3


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> F.Column:
    """Whether a row is held out; rows with a null id are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", most: int = MAX_TRAIN) -> Linear:
    """Fit on labelled rows outside the held-out fold."""
    known = labels.where(~held_out(id_col)).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    rows, y = labelled_rows(docs, known, most, with_words=False, id_col=id_col)
    return fit(rows, y, TRIGRAMS + SHAPES)


def with_score(docs: DataFrame, model: Linear, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with a column `score`; least: only rows that score so much, and no such column."""
    docs = docs.drop("score") if least is None else docs
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text_col):
                scores = pa.array([model.probability(x) for x, _ in indicators(b.column(at))], pa.float64())
                if least is None:
                    yield pa.RecordBatch.from_arrays([*b.columns, scores], [*names, "score"])
                else:
                    yield b.filter(pa.compute.greater_equal(scores, least))

    schema = T.StructType([*docs.schema.fields] + ([] if least is not None else [T.StructField("score", T.DoubleType())]))
    return docs.mapInArrow(run, schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    scored = scored.select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that score THRESHOLD or more, null and empty texts by the score of a text without n-grams; repeated
    rows stay or go together."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, model, least=THRESHOLD)
