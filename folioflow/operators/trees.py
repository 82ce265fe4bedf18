"""Diagram trees from node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Point types that are nodes of a diagram.
NODE_TYPES = ("doc", "node", "asst")


def roots(nodes: DataFrame, edges: DataFrame, key: str = "diagram") -> DataFrame:
    """The nodes that no edge enters."""
    return nodes.join(edges.select(key, F.col("child").alias("node")), [key, "node"], "left_anti")


def tree_levels(nodes: DataFrame, edges: DataFrame, key: str = "diagram") -> DataFrame:
    """(key, node, text, level, path): the nodes of every diagram in the order of their paths.

    ``nodes`` has key, node, type, text, pos; ``edges`` key, parent, child, ord, pos. Only parent edges between real nodes
    count. Roots are the ``doc`` nodes, or without one the nodes that no edge enters. Children stand in order of ord, then
    of the edge. A node is taken once, where it is first met, so cycles end. A ``doc`` root without a text gives its
    place to its children. Levels are joined one after the other until none is left, since no path holds a node twice: the
    number of joins follows the deepest diagram and never the number of diagrams.
    """
    real = nodes.filter(F.col("type").isin(*NODE_TYPES))
    ids = real.select(key, "node")
    live = edges.join(ids.withColumnRenamed("node", "parent"), [key, "parent"], "left_semi").join(ids.withColumnRenamed("node", "child"), [key, "child"], "left_semi")
    live = live.withColumn("rank", F.row_number().over(Window.partitionBy(key, "parent").orderBy("ord", "pos")))
    has_doc = real.filter("type = 'doc'").select(key).distinct()
    free = roots(real, live, key).join(has_doc, key, "left_anti")
    level = real.filter("type = 'doc'").unionByName(free).select(key, "node", F.array(F.col("pos").cast("int")).alias("path"), F.array("node").alias("seen"))
    out = level
    while True:
        step = level.withColumnRenamed("node", "parent").join(live, [key, "parent"])
        step = step.filter(~F.array_contains("seen", F.col("child")))
        level = step.select(key, F.col("child").alias("node"), F.concat("path", F.array("rank")).alias("path"), F.concat("seen", F.array("child")).alias("seen"))
        level = level.checkpoint() if level.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else level.cache()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    first = out.withColumn("n", F.row_number().over(Window.partitionBy(key, "node").orderBy("path"))).filter("n = 1")
    named = first.join(real.select(key, "node", "type", "text"), [key, "node"])
    lifted = named.filter("type = 'doc' and text = '' and size(path) = 1").select(key, F.col("path").alias("above"))
    parents = first.filter("size(path) > 1").select(key, F.slice("path", 1, 1).alias("above")).distinct()
    lifted = lifted.join(parents, [key, "above"], "left_semi")
    placed = named.join(lifted, (named[key] == lifted[key]) & (F.slice(named["path"], 1, 1) == lifted["above"]), "left").select(named["*"], lifted["above"])
    placed = placed.filter("above is null or size(path) > 1")
    return placed.select(key, "node", "text", (F.size("path") - 1 - F.col("above").isNotNull().cast("int")).alias("level"), "path")
