"""Helpers of the training-text operators: inputs, tables in the shared folder, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowfind.session import scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that the operators read, whatever else a table holds; a null text is empty."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b).

    Labels fall along the links and jump to the label of their label, so the rounds grow with the logarithm of a
    component's width. Each round is a table in the shared folder, which survives lost executors.
    """
    both = scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")),
                     "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
                .unionByName(labels).groupBy("node").agg(F.min("root").alias("root")))
        near = scratch(near, "near")
        above = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        fresh = scratch(near.join(above, "root").select("node", F.least("root", "next").alias("root")), "labels")
        changed = fresh.join(labels.select("node", F.col("root").alias("old")), "node").where("root <> old")
        stable = changed.isEmpty()
        labels = fresh
        if stable:
            return labels
    raise RuntimeError("components did not settle")
