"""The most frequent items of each group, exactly, without counting every item.

Where most items are rare (free texts, words), counting all of them shuffles nearly the whole
column. Here tasks keep a summary of bounded size for each group (Spark's frequent-item
sketch), and a second scan counts only the items the summaries hold. A summary
that tracks m items misses none that makes up more than ``ERROR / m`` of its group, so if the
k-th exact count is above that, the answer is proven; groups for which it is not
are counted in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claravoz.scratch import reliable_checkpoint

#: An item that a summary of m items does not report has at most this, over m, of the group's rows:
#: twice the sketch's a-priori error (an item is reported if its least count exceeds the error),
#: which is 3.5 over the size of its table, of which 3/4 are for items.
ERROR = 2 * 3.5 * 0.75
#: Candidates (or groups) up to this many rows and bytes are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_by").orderBy(F.desc("n"), "item")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_by", "item").agg(F.count(F.lit(1)).alias("n"))


def summaries(rows: DataFrame, tracked: int) -> DataFrame:
    """(_by, rows, bound, items): of each group its rows, the most that an item not reported can have, and the items reported."""
    found = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(item, {tracked}, {tracked})").alias("_top"))
    return found.select("_by", "rows", (F.col("rows") * ERROR / tracked).alias("bound"), F.transform("_top", lambda t: t["item"]).alias("items"))


def top_items(df: DataFrame, by: str, item: Column, k: int = 5, tracked: int = 4096) -> DataFrame:
    """(by, item, n, position, proof): the ``k`` most frequent non-null items of each group, ties by name.

    ``proof`` is ``summary`` or ``full count``. A null group is a group. ``tracked`` bounds
    a summary; it changes the work, not the result. An empty table gives an empty result.
    """
    rows = df.select(F.struct(F.col(by).alias("by")).alias("_by"), item.alias("item")).where("item IS NOT NULL")
    told = reliable_checkpoint(summaries(rows, max(tracked, k)))
    candidates = told.select("_by", F.explode("items").alias("item"))
    group_bytes = F.octet_length(F.col("_by.by").cast("string"))
    item_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda total, t: total + F.octet_length(t.cast("string")))
    size = told.agg(F.count(F.lit(1)).alias("groups"), F.sum(group_bytes).alias("group_bytes"), F.sum(F.size("items")).alias("items"),
                    F.sum(item_bytes + F.size("items") * F.coalesce(group_bytes, F.lit(0))).alias("bytes")).first()
    if (size["items"] or 0) <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        counted = _counts(rows.join(F.broadcast(candidates), ["_by", "item"], "left_semi"))
    else:
        counted = _counts(rows).join(candidates, ["_by", "item"], "left_semi")
    exact = reliable_checkpoint(counted)
    ranked = _ranked(exact, k)
    last = ranked.groupBy("_by").agg(F.min("n").alias("_last"), F.count(F.lit(1)).alias("_found"))
    held = exact.groupBy("_by").agg(F.sum("n").alias("_held"))
    whole = F.col("_held") == F.col("rows")  # the reported items are all there are
    apart = (F.col("_found") == k) & (F.col("_last") > F.col("bound"))
    judged = told.join(last, "_by", "left").join(held, "_by", "left").select("_by", F.coalesce(whole | apart, F.lit(False)).alias("_proven"))
    proven = ranked.join(judged.where("_proven"), "_by", "left_semi").withColumn("proof", F.lit("summary"))
    open_groups = judged.where(~F.col("_proven")).select("_by")
    if size["groups"] <= BROADCAST_ROWS and (size["group_bytes"] or 0) <= BROADCAST_BYTES:
        open_groups = F.broadcast(open_groups)
    rest = rows.join(open_groups, "_by", "left_semi")
    both = proven.unionByName(_ranked(_counts(rest), k).withColumn("proof", F.lit("full count")))
    return both.select(F.col("_by.by").alias(by), "item", "n", "position", "proof")
