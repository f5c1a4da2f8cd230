"""Connected components by minimum labels with pointer jumping.

Every round each node takes the smallest label among its neighbours' labels and then follows the label's
own label (pointer jumping), so that the number of rounds grows with the logarithm of the diameter.
A node with very many neighbours costs no more than its edges: labels are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaworks.session import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Null ends and self loops name no link, yet a self loop makes its node known.  An empty input gives
    an empty result.  Raises if ``max_rounds`` rounds do not suffice.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = stage(e.union(e.select("v", "u")).distinct(), "links")
    label = stage(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(label.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = label.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("label").alias("over"))
        nxt = stage(
            hooked.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("over", "new")).alias("label")),
            "labels",
        )
        moved = nxt.where("label <> old").limit(1).count()
        unstage(label)
        label = nxt.select("node", "label")
        label._lemmaworks_path = nxt._lemmaworks_path
        if not moved:
            unstage(both)
            return label.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")
