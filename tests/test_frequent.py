"""Top items by summaries equal a full count, proven or not."""

import collections
import random

from pyspark.sql import functions as F

from claravoz.operators import frequent


def brute(rows, k):
    groups = collections.defaultdict(collections.Counter)
    for g, item in rows:
        if item is not None:
            groups[g][item] += 1
    return {(g, item, n, i) for g, c in groups.items() for i, (item, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}


def test_equals_full_count(spark):
    rnd = random.Random(3)
    skewed = [("hot", f"w{int(rnd.paretovariate(0.8)) % 5000}") for _ in range(20_000)]
    flat = [("flat", f"u{rnd.randrange(4000)}") for _ in range(6000)]  # nothing stands out: counted in full
    small = [(None, "a"), (None, "b"), (None, "b"), (None, None), ("one", "x"), ("none", None), ("tie", "q"), ("tie", "p")]
    rows = skewed + flat + small
    df = spark.createDataFrame(rows, "g string, t string").repartition(6)
    for tracked in (64, 1024):
        got = frequent.top_items(df, "g", F.col("t"), 3, tracked).collect()
        assert {(r["g"], r["t" if "t" in r else "item"], r["n"], r["position"]) for r in got} == brute(rows, 3)
        proof = {r["g"]: r["proof"] for r in got}
        assert proof["hot"] == proof[None] == proof["one"] == "summary" and proof["flat"] == "full count"
    assert frequent.top_items(df.limit(0), "g", F.col("t")).count() == 0


def test_no_missing_item_exceeds_the_bound(spark):
    rnd = random.Random(4)
    rows = [("g", f"w{int(rnd.paretovariate(0.5)) % 20_000}") for _ in range(30_000)]
    counts = collections.Counter(t for _, t in rows)
    df = spark.createDataFrame(rows, "g string, item string").repartition(5).select(F.struct(F.col("g").alias("by")).alias("_by"), "item")
    for tracked in (32, 256):
        told = frequent.summaries(df, tracked).first()
        missed = max(n for t, n in counts.items() if t not in set(told["items"]))
        assert told["rows"] == len(rows) and missed <= told["bound"]
