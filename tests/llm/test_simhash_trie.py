import random

import xxhash

from claravoz.llm import simhash_trie
from claravoz.llm.components import components
from tests.llm.conftest import make, prose


def brute_print(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i:i + words]), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, k):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            least = min(label[q] for q in prints if (p ^ q).bit_count() <= k)
            if least < label[p]:
                label[p], changed = least, True
    return label


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_links_match_brute_force(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(150)] + [0]
    prints = set(base)
    for p in base[:60] + [0]:
        for _ in range(6):
            q = p
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                q ^= 1 << b
            prints.add(q)
    for i in range(200):  # a hot subtree: many fingerprints that share their first bits
        prints.add((0x5A5A5 << 44) | rnd.getrandbits(12))
    prints = sorted(prints)
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for k in (4, 2):
        want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[i + 1:] if (a ^ b).bit_count() <= k}
        got = [(r["low"], r["high"]) for r in simhash_trie.linked(table, k).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_budget_loses_no_pattern_of_errors():
    rnd = random.Random(1)
    plan = simhash_trie.budgets(4)
    for _ in range(3000):
        errors = sorted(rnd.sample(range(64), 4))
        assert any(all(sum((e - first) % 64 < d for e in errors) <= allowed[d] for d in range(65)) for first, *allowed in plan)


def test_documents(spark, odd, odd_rows, none):
    rows = odd_rows + [(20, prose(9, 300)), (21, prose(9, 300) + " end"), (22, "AB c D e"), (23, "ab C d E")]
    docs = make(spark, rows).repartition(4)
    label = brute_groups(sorted({brute_print(t) for _, t, *_ in rows}), 4)
    ids = {}
    for d, t, *_ in rows:
        if d is not None:
            ids.setdefault(label[brute_print(t)], []).append(d)
    want = sorted((str(d), signed(brute_print(t)), str(min(ids.get(label[brute_print(t)], [None]), key=lambda x: (x is None, x)))) for d, t, *_ in rows)
    found = simhash_trie.find_groups(docs)
    assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in found.collect()) == want
    kept = simhash_trie.keep_first(docs)
    assert kept.count() == len(set(label.values())) and kept.columns == docs.columns
    assert simhash_trie.find_groups(odd).count() == len(odd_rows)
    assert simhash_trie.find_groups(none).count() == 0 and simhash_trie.keep_first(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
