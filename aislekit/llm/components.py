"""Connected components of a table of links, by alternating large and small stars.

Each round moves links only; the links of a round are written to the shared folder, so that a lost
executor costs one round at most. Hubs are met by joins, never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aislekit.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that links reach. Null ends are no links."""
    links = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "links")
    before = None
    while True:
        # large star: every greater neighbour to the smallest of the neighbourhood
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: the node and its smaller neighbours to the smallest of them
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.col("m").alias("to"), "a", "b")
        small = small.select("to", F.explode(F.array("a", "b")).alias("b")).where("to != b").select(F.col("to").alias("a"), "b").distinct()
        links = written(small, "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
