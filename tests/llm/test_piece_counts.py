import random

import pytest

from claravoz.llm import byte_bpe, piece_counts

sentencepiece = pytest.importorskip("sentencepiece")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "▁", "▁▁", "\0", "<s>", "</s>", "<unk>", "<0x0A>", "the", "語", "😀", "Word", " x", "　", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=byte_bpe.tokenizer_path(piece_counts.MODEL))


def test_no_piece_has_a_blank_inside(library):
    """The cut before blanks rests on this."""
    import re
    assert not [p for p in map(library.id_to_piece, range(library.get_piece_size())) if re.search("[^▁]▁", p)]


def test_sums_equal_the_library(library):
    rnd = random.Random(3)
    path = byte_bpe.tokenizer_path(piece_counts.MODEL)
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert sum(piece_counts.piece_counts(piece_counts.pretokens(text), path)) == len(library.encode(text)), repr(text)


@pytest.mark.parametrize("head", [12_000_000, 200, 0])
def test_documents(odd, odd_rows, library, head):
    """Also when few or no pre-tokens are frequent."""
    want = sorted((str(d), len((t or "").encode()), len(library.encode(t or ""))) for d, t, *_ in odd_rows)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in piece_counts.count_tokens(odd, head_bytes=head).collect())
    assert got == want


def test_empty_table(none):
    assert piece_counts.count_tokens(none).count() == 0
