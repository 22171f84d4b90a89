import hashlib
import math
import random
import re

from claravoz.llm import pii
from tests.llm.conftest import make, prose


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    """The patterns as they are given, without any shortcut."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    rnd = random.Random(2)
    parts = [*"ab@@..-+%12 ()255", "1.2.3.4", "@x.y", "4266", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "٣"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_long_runs_are_scanned_once():
    assert pii.base_spans("a" * 300_000 + " @ " + "1" * 300_000 + "." + "+" * 1000) == []


def test_disclosing_terms(spark):
    """A name that only stands by one address gives it away, a common word does not."""
    address = "k.meier@firm.example"
    rows = [(i, f"{prose(i, 12)} Zacharias the wrote {address} the rest {prose(100 + i, 12)}") for i in range(5)]
    rows += [(50 + i, f"{prose(200 + i, 30)} the end") for i in range(30)]
    docs = make(spark, rows)
    found = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    for i, (doc, text) in enumerate(rows[:5]):
        spans = [(k, text[int(a):int(b)]) for k, a, b in (s.split(":") for s in found[doc]["spans"].split(","))]
        assert spans[0] == ("email", address) and ("remove", "Zacharias") in spans
        assert not any(word == "the" for _, word in spans)
    assert all(found[d]["spans"] == "" for d, _ in rows[5:])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("Zacharias" not in clean[d] and address not in clean[d] and "[EMAIL]" in clean[d] for d, _ in rows[:5])
    assert all(clean[d] == t for d, t in rows[5:])


def expected(rows, threshold=0.8, certain=0.98, support=3):
    """Spans of every row, from counts over all pairs of an entity and a term."""
    told = []
    for _, text in rows:
        base = plain(text)
        words = [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W\d_]+", text)]
        own = {k + text[a:b].lower() if k == "email" else k + re.sub("[^0-9]", "", text[a:b]) for k, a, b in base}
        told.append((base, own, [w for w in words if not any(a < w[2] and w[1] < b for _, a, b in base)], {w[0] for w in words}))
    total, out = len(rows), []
    for base, own, free, _ in told:
        added = {}
        for term in {w[0] for w in free}:
            for e in own:
                n_e, n_t = sum(e in x[1] for x in told), sum(term in x[3] for x in told)
                both = sum(e in x[1] and term in {w[0] for w in x[2]} for x in told)
                if n_e == total or math.log2((both + n_e / total) / (n_t + 1) * total / n_e) < threshold * math.log2(total / n_e):
                    continue
                sure = both >= support and math.log2(both / n_t * total / n_e) >= certain * math.log2(total / n_e)
                added[term] = max(added.get(term, ""), "remove" if sure else "generalise")
        spans = base + sorted((added[t], a, b) for t, a, b in free if t in added)
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    return out


def test_all_spans_equal_brute_force(spark):
    rnd = random.Random(4)
    mails = [f"user{i}@mail.example" for i in range(6)] + ["192.168.0.7", "+49 (30) 1234-5678", "hot@mail.example"]
    names = ["Zacharias", "Philippa", "Ottokar", "Brunhild"]
    rows = []
    for i in range(150):
        words = prose(300 + i, rnd.randint(0, 30)).split()
        for m in {rnd.choice(mails[:8]) for _ in range(rnd.choice([0, 0, 0, 1, 3]))} | ({mails[8]} if i % 3 == 0 else set()):
            words.insert(rnd.randint(0, len(words)), m)
            words[:0] = [names[mails.index(m) % 4]] * rnd.randint(0, 2)
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, "one@only.example " * 3 + "Xanthippe and the rest Xanthippe"), (202, "")]
    got = {r["doc_id"]: (r["spans"], r["n_added"]) for r in pii.find_spans(make(spark, rows).repartition(5)).collect()}
    want = expected(rows)
    assert [got[d][0] for d, _ in rows] == want
    assert all(n == sum(s.startswith(("gen", "rem")) for s in spans.split(",")) for spans, n in got.values())
    assert sum(w.count("remove") for w in want) > 5 and sum(w.count("generalise") for w in want) > 20
    assert got[201][0].count("generalise") == 3  # the name twice, and "rest", which no other text has


def test_a_name_far_from_the_address_is_found(spark):
    rows = [(i, f"Ottilie {prose(i, 300)} a.b@firm.example {prose(40 + i, 5)}") for i in range(6)]
    rows += [(10 + i, prose(500 + i, 60)) for i in range(40)]
    found = {r["doc_id"]: r for r in pii.find_spans(make(spark, rows)).collect()}
    assert all("remove:0:7" in found[i]["spans"] for i in range(6))
    assert all(found[d]["spans"] == "" for d, _ in rows[6:])


def test_frequencies_cover_the_corpus(spark):
    docs = make(spark, [(i, prose(i, 50)) for i in range(20)])
    terms = spark.createDataFrame([("the",), ("of",), ("absent",)], "term string")
    texts = [set(pii._WORD.findall(r["text"].lower())) for r in docs.collect()]
    want = {w: n for w in ("the", "of", "absent") if (n := sum(w in t for t in texts))}
    assert {r["term"]: r["n"] for r in pii.document_frequency(docs, terms).collect()} == want


def test_odd_rows(odd, odd_rows, none):
    rows = pii.find_spans(odd).collect()
    want = sorted((str(d), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or "")).encode()).hexdigest()) for d, t, *_ in odd_rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    assert pii.find_spans(none).count() == 0
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == len(odd_rows)
