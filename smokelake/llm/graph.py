"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settled


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b. Returns node and label (the smallest node reachable) for every node that has a link.

    Labels spread over the links and are then replaced by their own labels, so long chains shorten by half in a round;
    rounds end when nothing changes. Tables stay distributed and the lineage is cut in each round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    both = settled(both)
    labels = made = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        spread = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        above = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        before, made = made, settled(spread.join(above, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        forget(before)
        labels = made.select("node", "label")
        if made.filter("old <> label").isEmpty():
            forget(both)
            return labels
