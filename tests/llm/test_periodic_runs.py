import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claravoz.llm import periodic_runs, queries
from tests.llm.conftest import make


def brute_runs(words, least, times):
    """All maximal stretches of each period, those without a smaller one."""
    n, found = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - start
            smaller = any(all(words[k] == words[k + d] for k in range(start, start + size - d)) for d in range(1, q))
            if size >= max(least, times * q) and not smaller:
                found.append((start, size, q))
    return sorted(found)


def brute_kept(words, runs):
    dropped = {i for start, size, q in runs for i in range(start + q, start + size)}
    return [w for i, w in enumerate(words) if i not in dropped]


def ids_of(words):
    number = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.sampled_from([(6, 4), (2, 2), (6, 2), (9, 3), (1, 5)]))
def test_runs_of_two_words(words, size):
    assert periodic_runs.runs_of(ids_of(words), *size) == brute_runs(words, *size)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcde"), min_size=1, max_size=5), st.integers(1, 7)), max_size=6))
def test_runs_of_repeated_blocks(blocks):
    words = [w for block, n in blocks for w in block * n]
    found = periodic_runs.runs_of(ids_of(words))
    assert found == brute_runs(words, 6, 4)
    kept = periodic_runs.kept_words(len(words), found)
    assert [w for w, k in zip(words, kept) if k] == brute_kept(words, found)


def test_common_prefixes_and_order():
    rnd = random.Random(4)
    for _ in range(200):
        words = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 40))]
        order, shared = periodic_runs.suffix_order(np.array(words, np.int64))
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        for a, b, n in zip(order, order[1:], shared[1:]):
            want = 0
            while max(a, b) + want < len(words) and words[a + want] == words[b + want]:
                want += 1
            assert n == want


def test_no_text_with_a_run_is_passed_over():
    rnd = random.Random(5)
    texts = [[rnd.randint(0, 3) for _ in range(rnd.randint(0, 30))] for _ in range(300)]
    ids = np.array([w for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    looked_at = set(periodic_runs.repeats(ids, owner, periodic_runs.seed_words(6, 4)).tolist())
    assert {k for k, t in enumerate(texts) if brute_runs(t, 6, 4)} <= looked_at
    assert len(looked_at) < 300


def test_long_runs():
    assert periodic_runs.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic_runs.runs_of(np.arange(90_000) % 900) == [(0, 90_000, 900)]


def digests(doc, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc is None else str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 6, 4) if n < 500 else periodic_runs.runs_of(ids_of(words))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(brute_kept(words, runs))).hexdigest())


def test_query_on_odd_rows(spark, odd, odd_rows, tmp_path):
    rnd = random.Random(6)
    rows = [*odd_rows, *((100 + i, " ".join(rnd.choice("a b c  d\x1c e".split(" ")) for _ in range(rnd.randint(0, 60)))) for i in range(150)),
            (300, "x  y " * 9), (301, " \x0b".join(["la"] * 7)), (302, "p q " * 3)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = [digests(r[0], r[1]) for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows) and sum(r[1] > 0 for r in want) > 5


def test_operator(spark, odd, none):
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(make(spark, [(1, "so " + "ha ha ho " * 4 + "end"), (2, None)]), 6, 2).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(1, 12, 3)] and found[1]["collapsed"] == "so ha ha ho end"
    assert (found[2]["n_words"], found[2]["runs"], found[2]["collapsed"]) == (0, [], "")
    assert periodic_runs.find_runs(odd).count() == 18
    assert periodic_runs.find_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(odd, times=1)
