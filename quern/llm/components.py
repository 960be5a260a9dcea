"""Connected components of a graph too large for one machine, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored, temporaries


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): each node's smallest reachable node, itself included.

    Each round gives a node the smallest label among its neighbours and then the label of its label, so a chain of
    length n takes about log n rounds. Minima are combined before each shuffle; the joins on a hot label have the
    label on one side once, so adaptive execution can split them. Each round ends in a written table; the last one stays."""
    with temporaries(edges.sparkSession):
        both = edges.select("a", "b").filter("a <> b")
        both = stored(both.union(both.select("b", "a")).distinct(), "edges")
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
            best = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
            jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
            after = best.join(jump, "root").select("node", F.least("root", "next").alias("root"), (F.least("root", "next") != F.col("was")).alias("moved"))
            step = stored(after, "labels")
            labels = step.select("node", "root")
            if step.filter("moved").isEmpty():
                return labels
