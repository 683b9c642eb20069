"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import landed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Labels flow to neighbours and then jump to the label of the label, so the rounds grow with the logarithm of a
    component's diameter on chains. Each round is written to the shared folder. Loops and repeated links are harmless;
    null ends are left out; no links give no rows."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node is not null and other is not null and node <> other")
    edges = landed(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = landed(edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "other", "label": "theirs"}), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = landed(met.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")), "labels")
        changed = new.filter("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
