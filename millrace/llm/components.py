"""Connected components of a graph given as a table of edges, all steps as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a, b); the label is the least node of the component. No edges: no rows.

    Each round every label takes the least label next to it, and labels are then followed to their ends; edges inside a label
    go. The labels left at least halve in a round, so the rounds are logarithmic. A node of very many edges is a hot key of
    equi-joins alone, which Spark may split, and of minima, which are taken before the shuffle.
    """
    links = cut(edges.select("a", "b").filter("a <> b").distinct())
    labels = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
        hooks = both.groupBy("x").agg(F.min("y").alias("to")).select("x", F.least("x", "to").alias("to"))
        # Hooks point to smaller labels only, so following them ends; each step doubles the way gone.
        while True:
            ahead = hooks.select(F.col("x").alias("to"), F.col("to").alias("far"))
            hooks = cut(hooks.join(ahead, "to", "left").select("x", F.coalesce("far", "to").alias("new"), "to"))
            moved = hooks.filter("new <> to").limit(1).count()
            hooks = hooks.select("x", F.col("new").alias("to"))
            if not moved:
                break
        labels = cut(labels.join(hooks.select(F.col("x").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        by = lambda side: hooks.select(F.col("x").alias(side), F.col("to").alias(f"{side}_to"))
        links = cut(links.join(by("a"), "a").join(by("b"), "b").filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if not links.limit(1).count():
            return labels
