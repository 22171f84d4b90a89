"""Connected components of a link table, by alternating stars.

Each round points the neighbours of a node at the smallest of them: first those
above the node, then those below (Kiveris et al., Connected Components in
MapReduce and Beyond). The minimum comes from an aggregate and a join, so the
neighbours of a node are never gathered in one place. Rounds are written to the
shared folder; the driver sees only a count and a checksum of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.llm.tables import stored


def _toward_smallest(links: DataFrame, larger: bool) -> DataFrame:
    """Links ``u > v`` after one star step, over the larger or the smaller neighbours."""
    if larger:
        sides = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = links.select("u", "v")
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = sides.join(least, "u")
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    ``links`` has two columns of one ordered type; nodes without a link are not in
    the result, except that the smallest node of each component is. An empty link
    table gives an empty result.
    """
    a, b = links.columns
    now = stored(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        now = stored(_toward_smallest(_toward_smallest(now, True), False), "stars")
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
