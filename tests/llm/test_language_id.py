import zlib

from claravoz.llm import language_id
from tests.llm.conftest import make, prose


def test_held_out_accuracy(documents):
    found = {r["doc_id"]: r for r in language_id.identify(documents).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [d for d, r in found.items() if r["held_out"]]
    assert set(held) == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(found[d]["lang_pred"] == truth[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_odd_rows(odd, none):
    rows = language_id.identify(odd).collect()
    assert len(rows) == 18
    by = {r["doc_id"]: r for r in rows}
    for doc in (2, 3, 4, 8):
        assert by[doc]["lang_pred"] == "und" and by[doc]["score"] == 0
    assert by[12]["lang_pred"] == "de" and by[1]["lang_pred"] == "en"
    assert language_id.identify(none).count() == 0
    kept = language_id.reject_unknown(odd)
    assert kept.columns == odd.columns and {2, 3, 4, 8}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_nothing_learned(spark):
    docs = make(spark, [(1, "some words", None), (2, "more words", None)])
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()} == {("und", 0.0)}


def test_filters_hold_every_trigram_and_their_chance_is_measured(spark):
    docs = make(spark, [(i, prose(i, 200, lang), lang) for i, lang in enumerate(["en", "de"] * 20)])
    filters = language_id.fit(docs, bits=12, share=0.0)
    for doc, text, lang in [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]:
        grams, _ = language_id.trigrams([text])
        held = None
        for at in language_id.slots(grams, 12):
            held = filters.masks[at] if held is None else held & filters.masks[at]
        assert ((held >> filters.languages.index(lang)) & 1).all()
    assert (filters.chance > 0).all() and (filters.chance < 1).all()
