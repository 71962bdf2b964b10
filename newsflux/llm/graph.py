"""Connected components of an edge table, by contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _roots(parent: DataFrame) -> DataFrame:
    """Pointer jumping: (node, parent) with parent < node or a root, to (node, root)."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = C.stage(parent.join(up, "parent", "left")
                         .select("node", F.coalesce("grand", "parent").alias("parent"),
                                 (F.col("grand").isNotNull() & (F.col("grand") < F.col("parent"))).alias("moved")),
                         "graph-jump")
        parent = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return parent


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every end of an edge; root is the smallest node of its
    component. Every round each node that has a smaller neighbour points to the
    smallest one, the pointers are followed to their roots, and the edges are
    contracted; only local minima survive a round, so few rounds are needed.
    Nothing is gathered per component: a hub's edges are reduced by ``min`` with
    map-side combine."""
    left = C.stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "graph-edges")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        root = _roots(C.stage(parent.select("node", F.least("node", "m").alias("parent")), "graph-parent"))
        if labels is None:
            labels = root.withColumnRenamed("parent", "root")
        else:
            up = root.select(F.col("node").alias("root"), F.col("parent").alias("higher"))
            labels = C.stage(labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")),
                             "graph-labels")
        ra = root.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        rb = root.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        left = C.stage(left.join(ra, "a").join(rb, "b").where("ra != rb")
                       .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "graph-edges")
    if labels is None:
        labels = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
