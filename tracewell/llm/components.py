"""Connected components of links, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for nodes in links(a, b): label is the least node of the component.

    Each round takes the least label among neighbours, then jumps to that
    label's own label, so that paths shorten by a factor a round. All state is in
    stored tables; nothing is gathered on the driver but one count a round.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = stored(stepped.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if not moved.filter("old != label").head(1):
            return moved.select("node", "label")
        labels = moved.select("node", "label")
