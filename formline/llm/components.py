"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them and the node itself.

    The large star looks at all neighbours and moves the larger ones; the small star
    looks at the smaller ones and moves the node along with them.
    """
    if large:
        at = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    else:
        at = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = at.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    moved = at.join(least, "node")
    if large:
        moved = moved.where(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select(F.col("other").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``) but the roots; the root is the least node.

    Both stars group by node with partial sums of one value, so a hub's links are
    reduced before they meet. Each round is written, and the loop ends when the
    links no longer change; that takes about the logarithm of the longest path.
    """
    links = materialize(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(state) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
        links = materialize(_star(_star(links, True), False))
