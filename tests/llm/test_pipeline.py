import hashlib

import numpy as np
import pytest

import corpus_pipeline
from claravoz.llm import byte_bpe, language_id, queries
from tests.llm.conftest import make, prose
from tests.llm.test_byte_bpe import reference  # noqa: F401
from tests.llm.test_exact_dedup import brute as exact_groups
from tests.llm.test_simhash_trie import brute_groups, brute_print

SHAPES = {
    "op1_decontamination": {"doc_id", "item_id"}, "op2_unit_dedup": {"doc_id", "clean_text"}, "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op4_piece_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op5_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op6_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op7_licenses": {"doc_id", "path", "licence"},
    "op8_simhash_trie": {"doc_id", "fingerprint", "component_id"}, "op9_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op12_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
}


@pytest.mark.parametrize("name", list(SHAPES))
def test_query(spark, sf, documents, name):
    found = queries.QUERIES[name](spark, sf)
    assert SHAPES[name] <= set(found.columns)
    n = found.count()
    assert 0 < n <= documents.count() if name in ("op1_decontamination", "op2_unit_dedup") else n == documents.count()


def test_exact_dedup_sql(spark, sf):
    from tests.oracle import compare, connect
    name = "op5_exact_dedup"
    assert compare(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_run_matches_brute_force(spark, tmp_path, reference):  # noqa: F811
    leak = prose(70, 30)
    rows = [(i, prose(i, 40 + i)) for i in range(40)] + [(i, prose(i, 40, "de"), "de") for i in range(40, 60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + "  "), (102, "9 8 7 !!"), (103, None), (104, ""), (105, prose(71, 20) + " " + leak)]
    rows += [(106, rows[39][1] + " the"), (107, rows[39][1].upper())]
    make(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    filters = language_id.fit(make(spark, rows).where(~language_id.held_out()))
    stay = [r for r in rows if filters.predict([r[1] or ""])[1][0] >= 0.4]
    assert {102, 103, 104}.isdisjoint(r[0] for r in stay) and len(stay) == len(rows) - 3
    keepers = {x[1] for x in exact_groups(stay)[0]}
    stay = [r for r in stay if str(r[0]) in keepers]
    label = brute_groups(sorted({brute_print(t) for _, t, *_ in stay}), 4)
    first = {}
    for r in sorted(stay):
        first.setdefault(label[brute_print(r[1])], r)
    stay = [r for r in first.values() if leak not in r[1]]
    assert set(found) == {r[0] for r in stay}
    for doc, text, *_ in stay:
        ids = reference.encode_ordinary(text)
        assert found[doc]["ids"] == ids
        assert found[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages(spark, sf, odd, none):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, none, sf).count() == 0
    assert byte_bpe.encode(none).count() == 0
