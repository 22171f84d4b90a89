import random
import tracemalloc

import numpy as np
import pyarrow as pa

from claravoz.llm import decontamination as d
from tests.llm.conftest import make, prose

QUESTION = "Anna has 12 apples and gives 5 apples to Ben, who walks 3 km to the market. How many apples does Anna keep?"
RENAMED = "Carla has 40 apples and gives 9 apples to Dora, who walks 8 miles to the market. How many apples does Carla keep?"
MIXED = "Carla has 40 apples and gives 9 apples to Dora, who walks 8 miles to the market. How many apples does Egon keep?"
TANK = "A tank of 30 liters loses 30 liters in each of 12 hours until nothing at all is left in it"
SAME, OTHER = TANK.replace("30", "75"), TANK.replace("30", "75", 1).replace("30", "80")
SHORT = "seven words are all there is here"


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def brute(rows, items, size=8, least=5, share=0.5, enough=25):
    """Pairs by comparing every alignment of a document with an item, token by token."""
    def parsed(text):
        tokens, out = d.TOKEN.findall(text or ""), []
        for i, t in enumerate(tokens):
            number = t[0].isdigit()
            unit = not number and t.lower() in d.UNITS and i > 0 and tokens[i - 1][0].isdigit()
            name = not number and not unit and len(t) > 1 and t[0].isupper() and t[1:] == t[1:].lower()
            out.append((t.lower(), "number" if number else "unit" if unit else None, name))
        return out

    pairs = set()
    for doc, text, *_ in rows:
        a = parsed(text)
        for item, other in enumerate(items):
            b = parsed(other)
            w = min(size, len(b))
            if w < least:
                continue
            for shift in range(-len(b), len(a)):
                for view in (False, True):
                    covered, slots = set(), set()
                    for j in range(len(b) - w + 1):
                        i = j + shift
                        if i < 0 or i + w > len(a):
                            continue
                        left, right = a[i:i + w], b[j:j + w]
                        kinds = [[x[1] or ("name" if view and x[2] else None) for x in side] for side in (left, right)]
                        if kinds[0] != kinds[1] or any(k is None and x[0] != y[0] for k, x, y in zip(kinds[0], left, right)):
                            continue
                        if 2 * sum(k is not None for k in kinds[0]) > w or view and "name" not in kinds[0]:
                            continue
                        covered |= set(range(j, j + w))
                        slots |= {(k, x[0], y[0]) for k, x, y in zip(kinds[0], left, right) if k}
                    forth, back = {(k, x) for k, x, _ in slots}, {(k, y) for k, _, y in slots}
                    if covered and len(forth) == len(slots) == len(back) and (len(covered) >= share * len(b) or len(covered) >= enough):
                        pairs.add((str(doc), item))
    return pairs


def test_other_names_and_figures(spark):
    docs = make(spark, [(1, prose(1, 40) + " " + QUESTION), (2, RENAMED.upper().lower()), (3, prose(2, 30) + "\n" + RENAMED + " " + prose(3, 20)),
                        (5, prose(4, 100)), (6, QUESTION.upper()), (7, SAME), (8, OTHER)])
    rows = {r["doc_id"]: r for r in d.find_leaks(docs, bench(spark, QUESTION, TANK)).collect()}
    assert {1, 3, 6, 7} <= set(rows) and 5 not in rows
    assert 8 not in rows  # 30 cannot stand for both 75 and 80
    assert rows[7]["changed"]
    assert not rows[1]["changed"] and rows[3]["changed"] and not rows[6]["changed"]
    assert rows[1]["covered"] == len(d.TOKEN.findall(QUESTION)) and rows[1]["place"] == 40


def test_matches_brute_force(spark, odd_rows):
    rnd = random.Random(2)
    items = [QUESTION, SHORT, "a b", None, prose(50, 40), prose(51, 20), "Ben " * 12]
    rows = [r for r in odd_rows if len(r[1] or "") < 5000] + [(60, SHORT), (61, prose(50, 40)), (62, " ".join(prose(50, 40).split()[5:30])),
            (63, " ".join(prose(50, 40).split()[:12])), (64, "Ben " * 20), (65, RENAMED + " " + QUESTION)]
    for i in range(40):
        words = rnd.choice([QUESTION, RENAMED, MIXED, prose(51, 20)]).split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(["7", "km", "Ben", "other", "apples"])
        rows.append((100 + i, " ".join(words)))
    found = d.find_leaks(make(spark, rows).repartition(3), bench(spark, *items)).collect()
    assert {(str(r["doc_id"]), r["item_id"]) for r in found} == brute(rows, items)


def test_word_for_word_copies_are_found(spark):
    """Mostly numbers, and a long copy with one inconsistent slot."""
    sums, words = "What is 12 + 7 * 3 - 4?", prose(70, 54).split()
    table = " ".join(str(100 + 7 * i) for i in range(12))
    long, apart, merged = (" ".join([*words[:20], x, *words[20:26], y, *words[26:]]) for x, y in (("12", "12"), ("12", "15"), ("12", "12")))
    other = merged.replace("12", "3", 1).replace("12", "5")
    docs = make(spark, [(1, f"{prose(71, 30)} {sums} {prose(72, 30)}"), (2, f"{prose(73, 20)}\n{table}\n{prose(74, 20)}"), (3, apart),
                        (4, other.replace(" 3 ", " 4 ").replace(" 5 ", " 4 ")), (5, "What is 13 + 7 * 3 - 4?")])
    found = d.find_leaks(docs, bench(spark, sums, table, long, other)).collect()
    assert {(1, 0), (2, 1), (3, 2), (4, 3)} <= {(r["doc_id"], r["item_id"]) for r in found}
    assert 5 not in {r["doc_id"] for r in found}


def test_stage(spark, odd, odd_rows, none):
    clean = d.without_leaks(odd, bench(spark, prose(2, 60)))
    assert clean.columns == odd.columns
    assert {1, 5}.isdisjoint({r["doc_id"] for r in clean.collect()}) and clean.count() == len(odd_rows) - 3
    assert d.without_leaks(odd, bench(spark, None, "")).count() == len(odd_rows)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.without_leaks(odd, empty).count() == len(odd_rows) and d.find_leaks(none, bench(spark, QUESTION)).count() == 0


def test_memory_of_a_task_is_bounded():
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcdef')}{''.join(rng.choices('ghijklmnop', k=5))}" for _ in range(2_000)) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    found, nothing = 0, np.zeros(1 << (d._FILTER_BITS - 3), np.uint8)
    tracemalloc.start()
    try:
        for _, _, windows in d.in_blocks(iter([batch] * 2), [5, 6, 7, 8], nothing):
            found += len(list(windows))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 0 and peak < 110_000_000  # 167 MB with blocks of 4 MB and 500,000 tokens
