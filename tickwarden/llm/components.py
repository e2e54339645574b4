"""Connected components of a large graph of links between integer ids.

Rounds of contraction: every node points at its smallest neighbour (or
itself); links move to what their ends point at; links inside one node
vanish.  A round's pointers are written to the shared folder.  Pointers
always go to smaller ids, so following them ends at the smallest id of
the component.  Sums and minima combine before they shuffle; the joins
are plain equi-joins, which AQE splits where one node has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): for every node of a link the smallest
    node it is connected to."""
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "cc-links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy("a").agg(F.min("b").alias("p"))
        pointers = stored(pointers.select(F.col("a").alias("node"), F.least("a", "p").alias("root")), "cc-pointers")
        rounds.append(pointers)
        left = pointers.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = pointers.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = stored(moved.where("a <> b").distinct(), "cc-links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    labels = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = stored(
            labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-labels"
        )
    return labels
