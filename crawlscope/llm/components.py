"""Connected components of a link table, without gathering any component.

The links are dealt to tasks of about ``LINKS_OF_TASK`` links, each of which
turns its links into a spanning forest of stars. One task's stars are the
result. Stars of several tasks are joined by rounds in which minimum labels
spread along them and jump over known labels; each round is a written table in
the shared folder, and the driver sees one number a round. Labels shrink a path
of n links in about log2(n) rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

LINKS_OF_TASK = 1_000_000
MAX_ROUNDS = 60


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the group of each of n, joined by links a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def _stars(links: DataFrame) -> DataFrame:
    """``node``, ``other``: each node of a partition's links, and the smallest node that they join it to."""

    def join(batches):
        both = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if both:
            node, place = np.unique(np.concatenate(both, axis=1), return_inverse=True)
            a, b = place.reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"node": node, "other": node[spanning_forest(len(node), a, b)]})

    return links.mapInArrow(join, "node long, other long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest node) of every node that has a link."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    tasks = -(-links.count() // LINKS_OF_TASK) or 1
    stars = written(_stars(links.repartition(tasks)), "stars")
    if tasks == 1:
        return stars.withColumnRenamed("other", "component")
    both = written(stars.unionByName(stars.select(F.col("other").alias("node"), F.col("node").alias("other"))).filter("node != other").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        # the smallest label of the neighbours, then the label of that label
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        # a node also passes its label on to the node that was its label, so that whole trees hang on
        hooks = near.join(labels, "node").filter("theirs < component").select(F.col("component").alias("node"), "theirs")
        best = near.unionByName(hooks).groupBy("node").agg(F.min("theirs").alias("theirs"))
        spread = labels.join(best, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("theirs", "component")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("component").alias("above"))
        now = written(spread.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("component")), "labels")
        changed = now.filter("old != component").limit(1).count()
        labels = now.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
