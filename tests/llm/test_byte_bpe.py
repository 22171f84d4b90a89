import base64
import hashlib
import random

import numpy as np
import pytest

from claravoz.llm import byte_bpe
from tests.llm.conftest import make

tiktoken = pytest.importorskip("tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "½", "²", "'s", "'", "!", " ", "　", "語", "😀", "👨‍👩", "Ⅷ", "\r\n", "_",
         "<|endoftext|>", "ͅ", "​", "\x1c", "\x85", "\0", "word", "Word.", "word,\n", " then"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    with open(P.path(byte_bpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P
    return byte_bpe.codec(P.path(byte_bpe.RANKS), P.PATTERN)


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_ids_and_round_trip(codec, reference):
    texts = random_texts(4000)
    ids, counts = codec.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        own = ids[at:at + n]
        at += n
        assert own.tolist() == reference.encode_ordinary(text), repr(text)
        assert codec.decode(own).tobytes() == text.encode()


def test_forgetting_changes_nothing(codec, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    for text in random_texts(200, 6):
        assert codec.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_offsets_cover_split_characters(codec):
    texts = ["aé😀 語x", "", "次の文 and more", "", "😀"]
    ids, counts = codec.encode(texts)
    starts, ends = codec.offsets(ids, counts)
    at = 0
    for text, n in zip(texts, counts):
        data = text.encode()
        place = 0
        for i in range(at, at + n):
            stop = place + int(codec.lengths[ids[i]])
            # the characters that have a byte among those of the id
            touched = [k for k in range(len(text)) if len(text[:k].encode()) < stop and len(text[:k + 1].encode()) > place]
            assert (starts[i], ends[i]) == (touched[0], touched[-1] + 1)
            place = stop
        assert place == len(data)
        at += n
    assert any(codec.lengths[i] < 3 for i in ids[:6])  # some character is split
    none = codec.offsets(*codec.encode(["", ""]))
    assert [len(x) for x in none] == [0, 0]


def test_documents(spark, odd, odd_rows, none, reference):
    found = byte_bpe.encode(odd).collect()
    want = sorted((str(d), len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in odd_rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    assert byte_bpe.encode(none, tokens=False).count() == 0


def test_decode(spark):
    docs = make(spark, [(1, "héllo 😀"), (2, None)])
    rows = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert rows == {1: "héllo 😀".encode(), 2: b""}
