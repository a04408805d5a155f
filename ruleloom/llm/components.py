"""Connected components of a link table, without gathering links or components on the driver.

Large-star and small-star steps alternate until only stars are left (about the logarithm of the longest chain). Before each
round every partition first replaces its own links by a spanning star forest, so links of dense groups shrink to one
a document at once. Minima are aggregated before they are joined back; no group of neighbours is ever collected.
As soon as at most TASK_LINKS links are left, one task connects them: rounds leave shuffle files and checkpoints by the
number of partitions, however few the links are.

Defined results: links with a null end and links of a node to itself are ignored; repeated links count once; an empty
table has no components; nodes without links are not returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import cut

#: Most links that one task connects.
TASK_LINKS = 200_000


class Forest(dict):
    """Union-find whose roots are the smallest members."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a < b:
            self[b] = a
        else:
            self[a] = b
        return True


def _stars(batches, centres: bool):
    """Every node of the partition with the smallest one it reaches; the smallest ones too, if centres are wanted."""
    import pyarrow as pa

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = np.fromiter(forest, np.int64, len(forest))
    roots = np.fromiter((forest.find(x) for x in nodes.tolist()), np.int64, len(nodes))
    if centres:
        nodes, roots = (np.concatenate([x, np.unique(roots)]) for x in (nodes, roots))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])


def _shrink(links: DataFrame) -> DataFrame:
    return links.mapInArrow(lambda batches: _stars(batches, False), "u long, v long")


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _settled(state: DataFrame) -> bool:
    """No node has two links upwards, or links both ways: all are stars around their smallest node."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(state.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) for every node of the two-column link table; component is the smallest node it reaches."""
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    state = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    state = cut(_shrink(state))
    while True:
        if state.count() <= task_links:
            state = state.coalesce(1).mapInArrow(lambda batches: _stars(batches, True), "u long, v long")
            return state.toDF("node", "component")
        state = cut(_small(_shrink(_large(state))).distinct())
        if _settled(state):
            centres = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return state.toDF("node", "component").union(centres)
