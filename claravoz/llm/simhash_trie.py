"""Near duplicates by SimHash: a self-join of the binary trie of all fingerprints.

Links are pairs of fingerprints with at most ``k`` differing bits. Pairs of trie
nodes are walked down together, level by level as joins: a pair holds two
prefixes of one length and the number of bits in which they differ, its children
are pairs of their children, and a pair is pruned as soon as that number exceeds
the budget for its depth.

The budget rises with depth. Cut the bits into ``k + 1`` blocks; however ``k``
or fewer errors lie, some rotation of the blocks has fewer errors than blocks in
every prefix (the cycle lemma). So there is a trie for each rotation, and after
``j`` blocks at most ``j - 1`` bits may differ: none in the first block. Nothing
is lost, and near the root, where a plain trie would keep all pairs, only a node
and itself remain.

A pair of nodes with few fingerprints below them is not walked further, its
fingerprints are compared. So depth follows the number of fingerprints, and work
grows about in proportion to it. Exact copies share a fingerprint and enter once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claravoz.llm.byte_bpe import blocks
from claravoz.llm.components import components
from claravoz.llm.tables import join_by_run, keep_rows, row_id, stored, text_key, text_of

SEED = 42
#: Bits per level, and pairs of fingerprints that a node pair may compare at once.
STEP, COMPARED = 4, 16
_AT_ONCE = 1 << 16


def fingerprint(text: str, words: int) -> int:
    """SimHash of a text's shingles, as a signed number; 0 for a text without words.

    A-Z are lower-cased and ASCII white space separates words. A bit is set if it
    is set in over half of the shingles' XXH64, repeats included.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:n], ends[min(words, len(parts)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _AT_ONCE].tolist(), ends[at:at + _AT_ONCE].tolist())], np.uint64)
        if len(hashes) < 256:
            counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:  # bytes are counted first, then the bits of the 256 values
            octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
            for i in range(8):
                counts[8 * i:8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BITS
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(docs: DataFrame, words: int = 4) -> Column:
    """The fingerprint of ``docs.text`` (null: empty) as a long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        one = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([fingerprint(t.as_py(), words) for a, b in blocks(one, "text", 2_000_000)
                         for t in texts.slice(a, b - a)], pa.int64())

    return simhash(text_of(docs))


def budgets(k: int) -> list[list[int]]:
    """For each rotation of ``k + 1`` blocks the first bit of its trie, then the
    budget at every depth from 0 to 64."""
    sizes = [64 // (k + 1) + (i < 64 % (k + 1)) for i in range(k + 1)]
    out = []
    for r in range(k + 1):
        allowed = [0] + [j for j, size in enumerate(sizes[r:] + sizes[:r]) for _ in range(size)]
        out.append([sum(sizes[:r]), *allowed])
    return out


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("bits", 64 - depth) if depth < 64 else F.col("bits")


def linked(prints: DataFrame, k: int = 4) -> DataFrame:
    """Pairs (low, high) of different fingerprints of ``prints.fp`` (distinct longs)
    that differ in at most ``k`` bits, each once."""
    plan = budgets(k)
    rotated = prints.select("fp", F.explode(F.array(*(F.lit(r) for r in range(k + 1)))).alias("trie"))
    turned = F.lit(None).cast("long")
    for r, (first, *_) in enumerate(plan):
        turn = F.col("fp") if first == 0 else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
        turned = F.when(F.col("trie") == r, turn).otherwise(turned)
    leaves = stored(rotated.select("trie", "fp", turned.alias("bits")), "trie")

    def nodes(depth: int) -> DataFrame:
        return leaves.groupBy("trie", _prefix(depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))

    def budget(depth: int) -> Column:
        return F.element_at(F.array(*(F.lit(b[1 + depth]) for b in plan)), F.col("trie") + 1)

    depth = min(64 // (k + 1), 12)
    pairs = nodes(depth).where("n > 1").select(
        "trie", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("errors"), F.col("n").alias("na"), F.col("n").alias("nb"))
    found: list[DataFrame] = []
    while True:
        pairs = stored(pairs, "pairs")
        few = (F.col("na") * F.col("nb") <= COMPARED) | F.lit(depth == 64)
        low = leaves.select("trie", _prefix(depth).alias("a"), F.col("fp").alias("x"))
        high = leaves.select("trie", _prefix(depth).alias("b"), F.col("fp").alias("y"))
        near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= k) & (~F.col("same") | (F.col("x") < F.col("y")))
        found.append(pairs.where(few).select("trie", "a", "b", (F.col("a") == F.col("b")).alias("same"))
                     .join(low, ["trie", "a"]).drop("a").join(high, ["trie", "b"]).where(near).select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")))
        more = pairs.where(~few)
        if more.isEmpty():
            break
        step = min(STEP, 64 - depth)
        depth += step
        children = nodes(depth).withColumn("parent", F.shiftrightunsigned("node", step))
        left = children.select("trie", F.col("parent").alias("a"), F.col("node").alias("a2"), F.col("n").alias("na"))
        right = children.select("trie", F.col("parent").alias("b"), F.col("node").alias("b2"), F.col("n").alias("nb"))
        errors = F.col("errors") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << step) - 1)))
        alive = (errors <= budget(depth)) & (
            (F.col("a") != F.col("b")) | (F.col("a2") < F.col("b2")) | ((F.col("a2") == F.col("b2")) & (F.col("nb") > 1)))
        pairs = (more.select("trie", "a", "b", "errors").join(left, ["trie", "a"]).join(right, ["trie", "b"]).where(alive)
                 .select("trie", F.col("a2").alias("a"), F.col("b2").alias("b"), errors.cast("int").alias("errors"), "na", "nb"))
    all_found = found[0]
    for more_found in found[1:]:
        all_found = all_found.union(more_found)
    return all_found.distinct()


def find_groups(docs: DataFrame, words: int = 4, k: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id, first, and ``text_key``.

    ``component_id`` is the smallest id reachable over links, own id included; rows
    with null ids take part and have a null component only if no row of theirs has
    an id. ``first`` marks one row of each group: the smallest id, of ties the first
    row. All texts without words share the fingerprint zero, which links like any
    other. An empty table gives an empty result; other columns are not looked at.
    """
    rows = stored(docs.select(
        F.spark_partition_id().alias("run"), row_id().alias("uid"), "doc_id", fingerprints(docs, words).alias("fp"),
        *(c.alias(name) for name, c in text_key(docs).items())), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    prints = stored(rows.groupBy("fp").agg(F.min(rank).alias("best")), "distinct-prints")
    groups = components(linked(prints.select("fp"), k)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    placed = prints.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")
    firsts = placed.groupBy("root").agg(F.min("best").alias("first"))
    found = placed.select("fp", "root").join(firsts, "root").select("fp", "first")
    return join_by_run(rows, "fp", found).select(
        "doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("first"), *text_key(docs))


def keep_first(docs: DataFrame, words: int = 4, k: int = 4) -> DataFrame:
    """The rows of ``docs`` that come first in their group, with all their columns."""
    return keep_rows(docs, find_groups(docs, words, k).where("first"))
