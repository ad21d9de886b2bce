"""Connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one is set from spark.checkpoint.dir, or a temporary one only where Spark runs locally."""
    context = spark.sparkContext
    at = context.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = "file://" + tempfile.mkdtemp(prefix="petriflow-")
        context.setCheckpointDir(at)
    return at


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) reaches.

    Every round replaces a node's edges by edges to its smallest neighbour, first for larger and then for smaller neighbours, so long
    chains halve and the edges end as stars; rounds are checkpointed."""
    checkpoint_dir(edges.sparkSession)
    now = edges.where("a <> b").select("a", "b").distinct().checkpoint()
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(low, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        low = up.groupBy("b").agg(F.min("a").alias("m"))
        down = up.join(low, "b")
        now = down.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).union(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        now = now.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint()
        before, state = state, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
