import re

from claravoz.llm import unit_dedup
from tests.llm.conftest import make, prose

PASSAGE = "One rather long sentence that is in both texts. No. Another sentence that is rather long as well."


def brute(rows, cut, least):
    """Removed intervals by (document row): every long unit whose normal form was seen
    before in the order of (null, id, row, place), with its tail if that is the same."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, out = {}, {}
    for i in order:
        text = rows[i][1] or ""
        pieces = [(unit_dedup.normal(text[a:b]), a, b) for a, b in unit_dedup.units(text, cut)]
        for j, (words, a, b) in enumerate(pieces):
            if len(words.split()) < least:
                continue
            tail, end = [], b
            for w, _, e in pieces[j + 1:]:
                if len(w.split()) >= least:
                    break
                if w:
                    tail.append(w)
                    end = e
            if words in first:
                out.setdefault(i, []).append((a, end if first[words] == tail else b))
            else:
                first[words] = tail
    return out


def removed_text(text, spans):
    keep = set(range(len(text)))
    for a, b in spans:
        keep -= set(range(a, b))
    return re.sub(r"\s+", " ", "".join(text[i] for i in sorted(keep))).strip()


def test_matches_brute_force(spark, odd_rows):
    rows = [(i, t) for i, (_, t, *_) in enumerate(odd_rows)] + [
        (100, f"{prose(30, 40)}\n{PASSAGE} {prose(31, 30)}"), (101, f"{prose(32, 25)} tail {PASSAGE}\n{prose(33, 30)}"),
        (102, f"{PASSAGE}\n{PASSAGE}"), (103, prose(34, 70)), (104, prose(34, 70)), (105, "Short. Short. Short.")]
    docs = make(spark, rows).repartition(5)
    for unit in ("phrase", "line", "sentence", "paragraph"):
        want = brute(rows, unit_dedup.CUTS[unit], 5)
        got = {r["doc_id"]: r["clean_text"] for r in unit_dedup.changed(docs, unit).collect()}
        assert set(got) == {rows[i][0] for i in want}
        for i, spans in want.items():
            assert re.sub(r"\s+", " ", got[rows[i][0]]).strip() == removed_text(rows[i][1], spans), (unit, rows[i][0])


def test_passage_in_the_middle_of_a_sentence_goes(spark):
    docs = make(spark, [(1, f"{prose(40, 20)} and then {PASSAGE} {prose(41, 20)}"), (2, f"{prose(42, 20)} but {PASSAGE} {prose(43, 20)}")])
    row, = unit_dedup.changed(docs).collect()
    assert row["doc_id"] == 2 and PASSAGE not in row["clean_text"] and [s["keep_doc_id"] for s in row["spans"]] == [1]
    text = docs.where("doc_id = 2").first()["text"]
    assert text[row["spans"][0]["start"]:row["spans"][0]["end"]] == PASSAGE


def test_rows_and_columns_stay(odd, odd_rows, none):
    clean = unit_dedup.clean(odd)
    assert clean.columns == odd.columns and clean.count() == len(odd_rows)
    assert clean.where("text IS NULL").count() == 2
    assert unit_dedup.clean(none).count() == 0 and unit_dedup.changed(none).count() == 0
    repeated = sorted(r["text"] for r in clean.where("doc_id = 5").collect())
    assert repeated[0].strip() == "" and repeated[1].strip() == ""  # document 1 has their text


def test_passage_of_short_pieces_goes(spark):
    german = ("Die Sitzung der Kommission für Haushalt und Finanzen begann am Montag im Rathaus der Stadt. Der Vorsitzende begrüßte die Gäste "
              "aus Politik und Wirtschaft, den Leiter des Amtes und die Vertreter der Presse.")
    assert max(len(german[a:b].split()) for a, b in unit_dedup.units(german, unit_dedup.CUTS["phrase"])) < 5
    chinese = "今天的会议讨论了明年的财政预算和城市交通建设的详细规划。"
    for passage in (german, chinese):
        docs = make(spark, [(1, f"{prose(50, 20)} {passage} {prose(51, 20)}"), (2, f"{prose(52, 20)}\n{passage}\n{prose(53, 20)}")])
        row, = unit_dedup.changed(docs).collect()
        left = set(unit_dedup.normal(passage).split()) & set(unit_dedup.normal(row["clean_text"]).split())
        assert row["doc_id"] == 2 and [s["keep_doc_id"] for s in row["spans"]] == [1] and not left


def test_short_lines_go_and_what_stays_is_whole(spark):
    menu = "Home\nNews\nSports\nWeather\nOpinion\nContact Us\nSubscribe Now\nHelp"
    docs = make(spark, [(1, f"{menu}\n{prose(60, 30)}\nAll rights reserved."), (2, f"{prose(61, 30)}\nAll rights reserved.\n{prose(62, 20)}\n{menu}"),
                        (3, "Ja " * 100), (4, f"{prose(63, 20)}\nThe End.\n{prose(64, 20)}"), (5, f"{prose(65, 20)}\nThe End.")])
    got = {r["doc_id"]: r for r in unit_dedup.changed(docs).collect()}
    assert set(got) == {2, 3} and len(got[2]["spans"]) == 2  # short lines under 12 characters repeat by chance
    assert got[2]["clean_text"].split() == f"{prose(61, 30)} {prose(62, 20)}".split()
    assert len(got[3]["clean_text"].split()) == 25 and got[3]["clean_text"].startswith("Ja Ja")
