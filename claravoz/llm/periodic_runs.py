"""Periodic runs of words, found by Kruskal over descending common prefixes.

The suffixes of a text, cut at words, are classes by their common prefix: at
length L, two word positions are in one class when the L words from them on are the
same. Classes are united from the longest common prefix down, each an ordered set of
positions in a union-find forest. Two positions p < q that become neighbours in a
set when it is united at L share L words exactly, so the words from p to q + L have
period q - p; where q - p <= L this is a seed.

Seeds are enough. Let a run of smallest period d begin at i and end before e. The
positions i and i + d share e - i - d words; a position between them in their class
would give the run a smaller period. So they become neighbours, and their seed
begins the run. No seed has a period that is a multiple of a smaller one, since the
position one smaller period on shares more words and is in the set already. Thus
seeds with the same period and end are of one run, which begins at the first of them.

A run of ``least`` words and ``times`` periods at least has a seed of
max((times - 1) d, least - d) words for its period d, never under ``seed_words``.
Classes of shorter prefixes are not united, and a text in which no such stretch of
words occurs twice has no run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.llm.byte_bpe import blocks
from claravoz.llm.tables import text_of

#: Bytes of text that a task works on at once; a longer text is alone.
BLOCK = 1_000_000
#: Odd multiplier of the rolling hash that looks for repeated stretches.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def seed_words(least: int, times: int) -> int:
    """Fewest words that the two positions of a run's seed share."""
    return max(1, min(max((times - 1) * d, least - d) for d in range(1, max(least, 1) + 1)))


def repeats(ids: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Owners in which a stretch of ``length`` words may occur twice; none is missed.

    ``ids`` are the words of all texts in a row, ``owner`` the number of each word's text.
    """
    n = len(ids) - length + 1
    if n < 2:
        return owner[:0]
    key = owner[:n].astype(np.uint64)
    for k in range(length):
        key = key * _MIX + ids[k:k + n].astype(np.uint64)
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(owner[:n] == owner[length - 1:])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    return np.unique(owner[order[1:][same]])


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common words of each with the one before), by prefix doubling.

    Only suffixes that are not told apart yet are sorted again. Ranks of each
    length are kept, so common prefixes come from them by halving the length.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    head = np.r_[True, ids[order[1:]] != ids[order[:-1]]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank.copy()], 1
    while True:
        shared = np.flatnonzero(~(head & np.r_[head[1:], True]))  # places in groups of two and more
        if not len(shared) or width >= n:
            break
        at = order[shared]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((second, rank[at]))
        at, second = at[again], second[again]
        order[shared] = at
        group = rank[at]
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        head[shared] = new
        rank[at] = shared[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        width *= 2
        levels.append(rank.copy())
    return order, common_prefixes(order, levels)


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of ``order`` shares with the one before it, 0 for the first.

    ``levels[k]`` ranks the suffixes by their first 2^k words, so equal ranks are equal words.
    """
    n = len(order)
    left, right = order[:-1].copy(), order[1:].copy()
    found = np.zeros(max(n - 1, 0), np.int64)
    for k in reversed(range(len(levels))):
        width = 1 << k
        fits = np.maximum(left, right) + width <= n
        same = np.zeros(len(found), bool)
        same[fits] = levels[k][left[fits]] == levels[k][right[fits]]
        step = same * width
        found += step
        left += step
        right += step
    return np.r_[0, found]


def find_seeds(order: np.ndarray, shared: np.ndarray, least_shared: int) -> dict[tuple[int, int], int]:
    """{(period, end): first start}, by uniting classes from the longest common prefix down."""
    places = np.flatnonzero(shared >= least_shared)
    places = places[np.argsort(-shared[places], kind="stable")]
    seeds: dict[tuple[int, int], int] = {}
    parent: dict[int, int] = {}  # of suffixes by their place in the order; the root holds the set
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def seed(p: int, q: int, length: int) -> None:
        if q - p <= length:
            key = q - p, q + length
            if seeds.get(key, p) >= p:
                seeds[key] = p

    for place, length in zip(places.tolist(), shared[places].tolist()):
        a, b = root(place - 1), root(place)
        large = members.pop(a, None) or [int(order[a])]
        small = members.pop(b, None) or [int(order[b])]
        if len(large) < len(small):
            large, small, a, b = small, large, b, a
        parent[b] = a
        spots = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for k, (p, spot) in enumerate(zip(small, spots)):  # neighbours of different origin
            if spot and (not k or spots[k - 1] < spot):
                seed(large[spot - 1], p, length)
            if spot < len(large) and (k == last or spots[k + 1] > spot):
                seed(p, large[spot], length)
        if len(small) * 8 < len(large):
            for p in small:
                insort(large, p)
        else:
            large = sorted(large + small)
        members[a] = large
    return seeds


def runs_of(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``least`` words and ``times`` periods
    at least, by start, then period."""
    if len(ids) < max(least, 2):
        return []
    found = find_seeds(*suffix_order(ids), seed_words(least, times))
    return sorted((start, end - start, period) for (period, end), start in found.items()
                  if end - start >= max(least, times * period))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def find_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed text of every row.

    Words are what lies between white space of ASCII, numbered from 0. A run is a
    stretch of words with smallest period d, of ``least`` words and ``times`` d at
    least, that cannot be made longer; runs come by start, then period. ``collapsed``
    has the words that are in no run behind its first period, joined by one space.
    A null text is empty: no word, no run, an empty collapsed text. Repeated rows and
    null ids are kept; other columns are not looked at. The longest text must fit in
    a task; ``times`` under 2 is an error.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    shortest = seed_words(least, times)
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(span)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in blocks(batch, "text", BLOCK):
                part = batch.slice(start, end - start)
                texts = [text.as_py().encode().split() for text in part.column("text")]
                number: dict[bytes, int] = {}
                sizes = np.array([len(words) for words in texts], np.int64)
                ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64, int(sizes.sum()))
                at = np.cumsum(sizes) - sizes
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for k in repeats(ids, np.repeat(np.arange(len(texts)), sizes), shortest).tolist():
                    runs[k] = runs_of(ids[at[k]:at[k] + sizes[k]], least, times)
                    if runs[k]:
                        texts[k] = [texts[k][i] for i in np.flatnonzero(kept_words(len(texts[k]), runs[k])).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], pa.list_(span)),
                     pa.array([b" ".join(words).decode() for words in texts], pa.string())], schema=schema)

    ddl = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).mapInArrow(run, ddl)
