"""Connected components of an edge table, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round gives a node the least label among its neighbours and itself and then follows
    labels once (pointer jumping). The tables of a round are written, so joins read plain
    exchanges and Spark can split those of a hub.
    """
    e = edges.where(F.col("a") != F.col("b")).select("a", "b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "label")
    while True:
        near = (
            e.join(label, e.b == label.node)
            .groupBy("a")
            .agg(F.min("comp").alias("least"))
            .join(label, F.col("a") == F.col("node"))
            .select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("new"))
        )
        near = written(near, "near")
        jump = label.select(F.col("node").alias("at"), F.col("comp").alias("then"))
        step = near.join(jump, F.col("new") == F.col("at"), "left").select(
            "node", F.least("new", F.coalesce("then", "new")).alias("comp"), "old"
        )
        step = written(step, "label")
        label = step.select("node", "comp")
        if step.where(F.col("comp") != F.col("old")).isEmpty():
            return label
