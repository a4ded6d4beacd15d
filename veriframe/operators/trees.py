"""Hierarchies as adjacency tables, walked by doubling: each round joins stretches of a path to stretches twice as long,
so that a depth of thousands takes a dozen rounds. Each round ends in a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import settled


def paths(nodes: DataFrame) -> DataFrame:
    """(node_id, depth, path, administrative) of nodes(node_id, parent_id, title) reachable from a root; a node
    is administrative below an administrative ancestor too. A node given several times is taken once, under its
    smallest parent; nodes on or below a cycle, or below a parent that isn't there, are not reachable."""
    once = nodes.where("node_id is not null").groupBy("node_id").agg(F.min(F.struct(F.col("parent_id").isNotNull(), "parent_id", "title")).alias("n")).select("node_id", "n.parent_id", "n.title")
    own = F.coalesce(F.contains(F.lower("title"), F.lit("archive")), F.lit(False))
    walked = settled(once.select("node_id", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), F.coalesce("title", F.lit("")).alias("path"), own.alias("administrative")))
    reach, n = 1, walked.count()
    while reach <= n and not walked.where("up is not null").isEmpty():
        above = walked.toDF("up", "above", "more", "head", "kept")
        longer = walked.join(above, "up").select(
            "node_id", F.col("above").alias("up"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.concat("head", F.lit(" > "), "path").alias("path"),
            (F.col("administrative") | F.col("kept")).alias("administrative"),
        )
        walked = settled(walked.where("up is null").unionByName(longer))
        reach *= 2
    return walked.where("up is null").select("node_id", "depth", "path", "administrative")


def closure(edges: DataFrame) -> DataFrame:
    """(root, node, depth): everything that each root of edges(src, dst) reaches, by its shortest way; cycles end. What
    lies between k and 2k steps away is found from the rows at exactly k steps."""
    plain = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    roots = plain.select(F.col("src").alias("root"), F.col("src").alias("node"), F.lit(0).alias("depth")).distinct()
    known = settled(roots.unionByName(plain.where("src != dst").select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth"))))
    k = 1
    while not known.where(F.col("depth") == k).isEmpty():
        far = known.where(F.col("depth") == k).select("root", F.col("node").alias("via"))
        steps = known.where("depth > 0").select(F.col("root").alias("via"), "node", "depth")
        further = far.join(steps, "via").groupBy("root", "node").agg((F.min("depth") + k).alias("depth"))
        new = further.join(known.select("root", "node"), ["root", "node"], "left_anti")
        known = settled(known.unionByName(new.select("root", "node", "depth")))
        k *= 2
    return known
