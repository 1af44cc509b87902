"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import saved

#: Times that pointers are shortened before links are contracted.
JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of a link.

    ``links`` has the long columns ``a`` and ``b``. Each round points every node at the
    smallest of its neighbours and itself, shortens the pointers, and replaces the links
    by those between the nodes pointed at. At least every second node of a component
    that is not yet done vanishes, so the rounds grow with the logarithm of its size.
    Only the question whether links are left reaches the driver.
    """
    edges = saved(links.select("a", "b").where("a <> b"))
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    roots = saved(ends.distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to"))
        to = saved(to)
        for _ in range(JUMPS):
            onward = to.select(F.col("from").alias("to"), F.col("to").alias("next"))
            to = to.join(onward, "to").select("from", F.col("next").alias("to"))
        to = saved(to)
        roots = _moved(roots, to, "root")
        edges = saved(_moved(_moved(edges, to, "a"), to, "b").where("a <> b").distinct())
        roots = saved(roots)
    return roots


def _moved(df: DataFrame, to: DataFrame, column: str) -> DataFrame:
    """``df`` with the nodes of one column replaced by those they point at."""
    step = to.select(F.col("from").alias(column), F.col("to").alias("_to"))
    others = [c for c in df.columns if c != column]
    moved = df.join(step, column, "left")
    return moved.select(*others, F.coalesce("_to", column).alias(column)).select(*df.columns)
