"""Connected components of links by label propagation with pointer jumping, in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm._common import written


def components(links: DataFrame) -> DataFrame:
    """``key, component`` of every key in ``links`` (``a``, ``b``): the component's smallest key.

    A round gives each key the smallest label among itself and its neighbours, then the label of that label; it costs
    two joins on keys, and groups of any size sum up by partial minima. Rounds grow with the logarithm of the longest
    chain; stars take two.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("a").alias("b"), F.col("label").alias("near"))
        near = edges.join(of, "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(near, "a").select("a", F.least("label", "near").alias("b"), "label")
        new = written(lower.join(of, "b").select("a", F.least("b", "near").alias("label"), (F.least("b", "near") != F.col("label")).alias("changed")), "labels")
        labels = new.select("a", "label")
        if new.filter("changed").isEmpty():
            return labels.select(F.col("a").alias("key"), F.col("label").alias("component"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``key, component``) after its components, or keys that it doesn't have yet, are linked, too."""
    joined = components(links)
    step = joined.select(F.col("key").alias("component"), F.col("component").alias("to"))
    old = labels.join(step, "component", "left").select("key", F.coalesce("to", "component").alias("component"))
    return written(old.union(joined.join(labels, "key", "left_anti").select("key", "component")), "relabelled")
