import hashlib
import re

from claravoz.llm import exact_dedup
from tests.llm.conftest import make


def brute(rows):
    """doc_id, keep_id, group_size, text_sha256 of each row, and the number of rows that stay."""
    groups = {}
    for i, (doc, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i, doc))
    return sorted((str(x[4]), str(min(g)[4]), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for x in g), len(groups)


def shown(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in df.collect())


def test_matches_brute_force(spark, odd, odd_rows):
    found = exact_dedup.find_copies(odd)
    want, groups = brute(odd_rows)
    assert shown(found) == want
    assert found.where("kept").count() == groups


def test_every_number_of_rounds(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(200)]
    docs = make(spark, rows).repartition(40)
    want, _ = brute(rows)
    for bits in (1, 2, 6):
        assert shown(exact_dedup.find_copies(docs, bits)) == want


def test_kept_rows_keep_their_columns(spark, odd, odd_rows, none):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert kept.count() == brute(odd_rows)[1]
    assert exact_dedup.keep_first(none).count() == 0 and exact_dedup.find_copies(none).count() == 0


def test_no_python_in_the_plan(documents):
    plan = exact_dedup.find_copies(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
