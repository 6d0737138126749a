"""Connected components of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.sources.shared import written


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of the links (a, b) with the representative of its component.

    Round by round each node goes to the least of itself and its neighbours, and the links between what is left go on.
    Nodes should be named by hashes: with names in random order the number of links falls by a share in every round. A
    node with very many links is a sum per task and then a join that Spark splits. Each round is a written table.
    Self-links and repeated links are fine; no links give no nodes.
    """
    links = written(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to"))
        step = written(step, "link-step")
        steps.append(step)
        ends = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = ends.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = written(left, "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        on = step.select(F.col("node").alias("root"), "to")
        found = found.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
