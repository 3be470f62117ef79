"""Connected components of a link table by label hops and pointer jumps.

Every node carries a label, at first the smallest of itself and its neighbours. A round
takes the smallest label among neighbours and then follows the label's own label, so a
chain shortens by about half each time. Each round is written to the shared folder, which
cuts the lineage; the rounds end when no label changes. A node with very many links is
never gathered: minima are pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of a link; label is the smallest node reachable.

    Links run both ways; null ends are ignored; self links keep their node.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    both = stored(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("_l")).select("node", F.least("node", "_l").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("_near"))
        hopped = labels.join(near, "node").select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("_hop"))
        onward = labels.select(F.col("node").alias("_hop"), F.col("label").alias("_end"))
        jumped = hopped.join(onward, "_hop", "left").select("node", "_was", F.least("_hop", "_end").alias("label"))
        following = stored(jumped)
        settled = following.filter("label < _was").limit(1).count() == 0
        discard(labels)
        labels = following.select("node", "label")
        if settled:
            discard(both)
            return labels
