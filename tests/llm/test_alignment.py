import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from claravoz.llm import alignment, queries
from claravoz.llm.byte_bpe import byte_characters, tokenizer_path
from tests.llm.conftest import make, prose

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PARTS = ["a", "b", " ", " ", "  ", "\n", " \n", "\t", "é", "▁", "\0", "<s>", "<unk>", "<0x0A>", "<|endoftext|>", "the", "語", "😀", "Word", "'s", "　", ".", "\x1c", "\x85",
         "1234", "international", "​", "ß", "--", "ﬁ", "Ａ"]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(tokenizer_path(alignment.BYTES))
    a.encode_special_tokens = True
    value = {c: b for b, c in enumerate(byte_characters())}
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), value


def spans(ids, parts):
    out, at = [], 0
    for i, p in zip(ids, parts):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def brute(text, libraries):
    """Tokens, groups and links of a whole text, by comparing all tokens."""
    a, b, value = libraries
    text = text or ""
    ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
    ids_b = b.encode(text) if text else []
    parts_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
        return 0, 0, [], Counter()
    one, two = spans(ids_a, parts_a), spans(ids_b, parts_b)
    common = {e for _, _, e in one} & {e for _, _, e in two}
    groups, start = [], 0
    for end in sorted(common):
        groups.append(",".join(str(i) for i, s, e in one if start <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in two if start <= s and e <= end))
        start = end
    links = Counter((i, j) for i, s, e in one for j, t, f in two if s < f and t < e)
    return len(ids_a), len(ids_b), groups, links


def random_texts(n, seed=9):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 18))) for _ in range(n)]


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(tokenizer_path(alignment.BYTES), tokenizer_path("piece_bpe_32k.model"))


def check(own, texts, libraries):
    numbers, groups, links, times, bounds = own.align(texts)
    for k, text in enumerate(texts):
        n_a, n_b, want, pairs = brute(text, libraries)
        assert numbers[k].tolist() == [n_a, n_b, len(want)], repr(text)
        assert groups[k] == ";".join(want), repr(text)
        a, b = bounds[k], bounds[k + 1]
        assert dict(zip(links[a:b].tolist(), times[a:b].tolist())) == {i * alignment.PAIR + j: n for (i, j), n in pairs.items()}, repr(text)
        assert links[a:b].tolist() == sorted(links[a:b].tolist())


def test_texts_equal_brute_force(own, libraries):
    texts = random_texts(2500)
    for k in range(0, len(texts), 100):
        check(own, texts[k:k + 100], libraries)
    assert sum(brute(t, libraries)[0] > 0 for t in texts) > 1000


def test_forgetting_changes_nothing(own, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    for text in random_texts(150, 3):
        check(own, [text, "the " + text], libraries)
    assert not own.known


def test_long_texts(own, libraries):
    check(own, [prose(3, 400), "ab" * 600, "日本語の文" * 60, "-" * 700, "", "▁", prose(4, 100, "de")], libraries)
    numbers, *_ = own.align(["x" * 200_000])
    assert numbers[0, 2] > 0


def test_gallop_finds_the_first_place():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        rows = [np.sort(rnd.choice(200, rnd.integers(0, 60), replace=False)) for _ in range(3)]
        size = np.array([len(r) for r in rows])
        longer, stop = np.concatenate(rows), np.cumsum(size)
        of = np.sort(rnd.integers(0, 3, 20))
        drive = rnd.integers(-5, 210, 20)
        got = alignment.gallop(drive, longer, (stop - size)[of], stop[of])
        assert got.tolist() == [int((stop - size)[k] + np.searchsorted(rows[k], x)) for k, x in zip(of, drive)]


@pytest.mark.parametrize("head", [12_000_000, 600, 0])
def test_query(spark, odd, odd_rows, libraries, tmp_path, monkeypatch, head):
    """Also when few or no pairs are frequent, and counts leave tasks early."""
    rows = [*((r[0], r[1]) for r in odd_rows if len(r[1] or "") < 5000), *enumerate(random_texts(120, 4), 100), *((900 + k, prose(50 + k % 7, 30)) for k in range(20))]
    make(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    full = alignment.score
    monkeypatch.setattr(alignment, "score", lambda rows: full(rows, head_bytes=head))
    got = queries.op11_alignment(spark, str(tmp_path)).collect()
    found = [brute(t, libraries) for _, t in rows]
    count = Counter(pair for *_, links in found for pair in links)
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    want = []
    for (doc, _), (n_a, n_b, groups, links) in zip(rows, found):
        best = sum(n for (i, j), n in links.items() if count[i, j] == most[i])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want.append((doc, n_a, n_b, len(groups), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), digest))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r[c] for c in names)) for r in got) == sorted(map(str, want))


def test_operator_on_odd_rows(spark, odd, none):
    found = alignment.score(alignment.align(odd))
    assert found.count() == 18 and found.where("n_links < 0 OR n_best > n_links").count() == 0
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    assert alignment.score(alignment.align(none)).count() == 0


def test_pieces_whose_bytes_differ_spoil_no_others(own, libraries, monkeypatch):
    """A row of pieces that does not spell its bytes is taken apart."""
    own.forget()
    real = own.b

    class Changing:
        def encode(self, texts, num_threads):
            return [real.encode(t.replace("odd", "even")) for t in texts]

    monkeypatch.setattr(own, "b", Changing())
    numbers, groups, *_ = own.align(["good words stay", "odd words go", "more good words"])
    monkeypatch.undo()
    own.forget()
    assert numbers[1].tolist() == [0, 0, 0] and groups[1] == ""
    for k, text in ((0, "good words stay"), (2, "more good words")):
        n_a, n_b, want, _ = brute(text, libraries)
        assert numbers[k].tolist() == [n_a, n_b, len(want)] and groups[k] == ";".join(want)
