"""Byte-level BPE encoding and decoding over Arrow batches.

A text is cut before every single space or line break that has a non-space before
and after it. The byte-level pattern always ends a match there, so the pieces
between (the blank and what follows) can be encoded on their own; each worker asks
the ``tokenizers`` library once for every distinct piece of a batch and then
assembles documents by table look-up, in whole arrays. Decoding takes the bytes
of each id from the byte table, so a character that is split over several ids
comes back whole once its bytes stand together again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.llm.tables import text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of pieces, and of what is known of them, that a worker remembers; beyond, it forgets
#: all and starts anew. A piece counts its text and ``OVERHEAD``, so long ones fill it soon.
REMEMBERED = 24_000_000
OVERHEAD = 180
#: Bytes of text that a task works on at once, with and without arrays of tokens.
BLOCK, BLOCK_BARE = 256_000, 1_000_000
#: Pieces that the library gets in one text.
JOINED = 2_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than a single space or line break between two pieces.
_ODD = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z|\0")
_END, _LATIN = ".,!?", "\u0250"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next unused one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """The ranks of one file, the library's tokenizer for them, and the memory of pieces."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        by_id = {int(rank): base64.b64decode(token) for token, rank in pairs}
        ids = {token: rank for rank, token in by_id.items()}
        char = byte_characters()
        shown = {rank: "".join(char[b] for b in token) for rank, token in by_id.items()}
        merges = [(shown[ids[left]], shown[ids[right]]) for rank, token in sorted(by_id.items())
                  if len(token) > 1 for left, right in [_halves(token, rank, ids)]]
        self.tokenizer = Tokenizer(models.BPE({s: r for r, s in shown.items()}, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.lengths = np.zeros(max(by_id) + 1, np.int32)
        for rank, token in by_id.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.held = 0

    def learn(self, keys: list[str]) -> None:
        """Encode the pieces that are new. A stem and the full stops or commas
        after it are apart in the pattern, so each is asked for once."""
        known = self.known
        new = [k for k in dict.fromkeys(keys) if k not in known]
        stems = [stem if (stem := k.rstrip(_END)) and stem[-1] < _LATIN and stem[-1].isalpha() else k for k in new]
        both = [(k, s, "\0" + k[len(s):]) for k, s in zip(new, stems) if len(s) < len(k)]
        self._ask([k for k in dict.fromkeys([*stems, *(end for _, _, end in both)]) if k not in known])
        if both:
            of = np.array([(known[s], known[end]) for _, s, end in both], np.int64)
            self._add([k for k, _, _ in both], self.flat[ragged(self.at[of].ravel(), self.size[of].ravel())], self.size[of].sum(1))

    def _ask(self, keys: list[str]) -> None:
        """One call of the library; pieces that follow a space or a line break
        can stand in a row, as the pattern cuts between them anyway."""
        keys = sorted(keys, key=lambda k: k[0] != "\0")
        whole = [k[1:] if k[0] == "\0" else k if k[0] == "\n" else " " + k for k in keys]
        alone = sum(k[0] == "\0" for k in keys)
        rows = ["".join(whole[i:i + JOINED]) for i in range(alone, len(whole), JOINED)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(whole[:alone] + rows, add_special_tokens=False)]
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, sum(map(len, found)))
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in whole), np.int64, len(whole)))
        self._add(keys, flat, np.diff(np.searchsorted(np.cumsum(self.lengths[flat]), ends) + 1, prepend=0))

    def _add(self, keys: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.size), len(self.size) + len(keys))))
        self.at = np.concatenate([self.at, (np.cumsum(size) - size + len(self.flat)).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat])
        self.held += sum(map(len, keys)) + OVERHEAD * len(keys) + 4 * len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many belong to each text."""
        if self.held > REMEMBERED:
            self.forget()
        keys, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = pieces_of(text)
            counts[i] = len(cut)
            keys += cut
        self.learn(keys)
        of = np.fromiter(map(self.known.__getitem__, keys), np.int32, len(keys))
        size = self.size[of]
        ids = self.flat[ragged(self.at[of], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, as one array."""
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point that each id touches and the one after its last, counted in its
        own text. An id that holds part of a character touches the whole character."""
        points = np.cumsum((self.decode(ids) & 0xC0) != 0x80, dtype=np.int32)  # number of each byte's character, from 1
        size = self.lengths[ids]
        end = np.cumsum(size)
        first, last = points[end - size] - 1, points[end - 1]
        before = np.append(0, last)[np.cumsum(counts) - counts]  # characters of the texts before
        before = np.repeat(before, counts).astype(np.int32)
        return first - before, last - before


def _halves(token: bytes, rank: int, ids: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two last parts of a token when its bytes are merged by lower ranks only."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: r if (r := ids.get(parts[i] + parts[i + 1], rank)) < rank else rank + i)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the runs that begin at ``starts`` and are ``sizes`` long."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(starts - ends + sizes, sizes)
    return out


def pieces_of(text: str) -> list[str]:
    """The text cut before single spaces and line breaks, as keys of ``Codec.known``.

    A key without mark has lost the space in front; one that begins with a line
    break is the piece itself; after a zero byte the piece follows as it is.
    """
    if not text:
        return []
    if _ODD.search(text):
        head, *rest = _CUT.split(text)
        return ["\0" + head, *("\0 " + p if p[0] == "\0" else p for p in rest)]
    head, *rest = text.replace("\n", " \n").split(" ")
    return ["\0" + head, *rest]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def blocks(table: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.asarray(pc.binary_length(table.column(column)).fill_null(0))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           tokens: bool = True) -> DataFrame:
    """Encode every whole text and decode it again; one row per row of ``docs``.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 and, with ``tokens``, the arrays ``ids``,
    ``char_start`` and ``char_end`` (code points; an id with part of a character
    covers it whole). A null text is empty and has no ids. Repeated rows and null
    ids are kept as they are; other columns are not looked at.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path(RANKS), pattern or public_tokenizers.PATTERN
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if tokens:
        fields += [("ids", pa.list_(pa.int32())), ("char_start", pa.list_(pa.int32())), ("char_end", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for start, end in blocks(batch, "text", BLOCK if tokens else BLOCK_BARE):
                part = batch.slice(start, end - start)
                ids, counts = own.encode(part.column("text").to_pylist())
                ends = np.cumsum(counts)
                cuts = list(zip((ends - counts).tolist(), ends.tolist()))
                columns = [part.column("doc_id"), pa.array(counts),
                           pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in cuts]),
                           pa.array([hashlib.sha256(own.decode(ids[a:b]).tobytes()).hexdigest() for a, b in cuts])]
                if tokens:
                    at = pa.array(np.append(0, ends).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, *own.offsets(ids, counts))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ddl += ", ids array<int>, char_start array<int>, char_end array<int>" if tokens else ""
    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).mapInArrow(run, ddl)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The bytes of ``ids`` as column ``decoded`` (binary); null ids give no bytes.

    Ids outside the table are an error. Bytes need not be whole characters: a
    cut in the middle of one leaves its bytes as they are.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path(RANKS), pattern or public_tokenizers.PATTERN

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.decode(np.asarray(x or [], np.int64)).tobytes() for x in ids.to_pylist()], pa.binary())

    return tokens.withColumn("decoded", bytes_of("ids"))
