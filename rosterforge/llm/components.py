"""Connected components of a graph of edges, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written


def starred(edges: DataFrame) -> DataFrame:
    """Edges (a, b), each once, that join the same ids: an id is joined to its smallest neighbour, and its other smaller neighbours are joined to that one. Where neighbours are mostly the same, few edges are left."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    by_least = pairs.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    pair = lambda b: F.struct(F.col("least").alias("a"), F.col(b).alias("b"))
    return by_least.select(F.explode(F.array(pair("a"), pair("b"))).alias("pair")).select("pair.*").where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each end of an edge (a, b), both long: component is the smallest id that edges lead to.

    Each round takes, for each id, the smallest label next to it, and then the label of that label. Rounds are few where edges are stars
    around small ids. Each round's labels are written to the shared folder. No edges give no rows.
    """
    few = written(starred(edges), "cc-stars")
    both = written(few.union(few.select("b", "a")), "cc-edges")
    drop_written(few)
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = written(labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old")), "cc-near")
        of = lower.select(F.col("id").alias("of"), F.col("label").alias("root"))
        new = written(lower.join(of, lower["label"] == of["of"]).select("id", "root", "old"), "cc-jump")
        changed = new.where("root != old").limit(1).count()
        drop_written(labels)
        drop_written(lower)
        labels = new.select("id", F.col("root").alias("label"))
        if not changed:
            drop_written(both)
            return labels.select("id", F.col("label").alias("component"))
