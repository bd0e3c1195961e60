"""Connected components of a graph whose nodes are 64-bit hashes, by contraction.

Each round every component takes the smallest neighbouring label, follows it one step further and edges are
rewritten between labels, so edges inside a component disappear. Labels are hashes, hence in random order, and chains of decreasing
labels stay short. Aggregates are minima and combine before the shuffle; no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.sources.tables import cut_lineage


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after joining the components that ``links`` (a, b) connect. Both are in a written
    table; every end of a link has a label."""
    edges = _between(labels, links)
    while not edges.isEmpty():
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        parent = cut_lineage(both.groupBy("a").agg(F.min("b").alias("up")).selectExpr("a AS comp", "least(a, up) AS up"))
        further = parent.selectExpr("comp AS up", "up AS top")
        parent = cut_lineage(parent.join(further, "up", "left").selectExpr("comp", "coalesce(top, up) AS up"))
        labels = cut_lineage(labels.join(parent, "comp", "left").selectExpr("node", "coalesce(up, comp) AS comp"))
        ends = edges.withColumnRenamed("a", "comp").join(parent, "comp", "left").selectExpr("coalesce(up, comp) AS a", "b AS comp")
        ends = ends.join(parent, "comp", "left").selectExpr("a", "coalesce(up, comp) AS b")
        edges = cut_lineage(ends.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    return labels


def _between(labels: DataFrame, links: DataFrame) -> DataFrame:
    a = labels.selectExpr("node AS a", "comp AS ca")
    b = labels.selectExpr("node AS b", "comp AS cb")
    ends = links.join(a, "a").join(b, "b").where("ca <> cb")
    return cut_lineage(ends.selectExpr("least(ca, cb) AS a", "greatest(ca, cb) AS b").distinct())
