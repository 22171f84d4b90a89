"""Alignment of a text's tokens under two tokenizers, by galloping intersection.

Tokenizer A is byte-level BPE (``tokenizers``), B a sentencepiece model. Both spell
the same bytes, a space and the text; each token ends at a byte offset. The list of
ends that is shorter drives the search: for each of its entries an exponential search
from the start of the longer list, then a binary search within the last step, gives
the entry's rank there. An equal entry is a common end; common ends cut the tokens into
groups. The ranks of a token's two ends say which tokens of the other list its bytes
overlap: that range is the token's links.

Neither tokenizer merges across a single space between two characters that are no
white space, so such a space is always a common end. The pieces between are aligned
once for every distinct piece that a task meets, all new pieces of a block at a time,
and a text is put together from its pieces. A text without spaces is one piece.

How well an id pair is supported is the number of documents that hold it linked. Each
task counts the pairs of its documents before they are shuffled. The scores of a
document sum over its links: the most frequent pairs, as many as fit in ``head_bytes``,
are looked up in a broadcast table, all others joined by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.llm.byte_bpe import blocks, byte_characters, ragged, tokenizer_path
from claravoz.llm.piece_counts import MODEL, processor
from claravoz.llm.tables import row_id, stored, text_of

BYTES = "byte_bpe_50k.json"
#: Bytes of text that a task works on at once; a longer text is alone.
BLOCK = 500_000
#: Bytes of pieces and of what is known of them that a worker remembers between blocks.
REMEMBERED = 60_000_000
#: Pieces that a library gets in one text.
JOINED = 500
#: A space next to other white space, or white space at an end.
_ODD = re.compile(r" \s|[^\S ] |\A\s|\s\Z")
#: An id pair as one number: A's id times this, plus B's id.
PAIR = 1 << 32
#: Links that a task scores at once; a longer document is alone.
LINKS = 500_000
#: Distinct pairs that a task holds before it hands its counts on.
HELD = 500_000


def gallop(drive: np.ndarray, longer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each entry of ``drive`` the first place in ``longer``, from ``start`` to before
    ``stop``, whose entry is not smaller (``stop`` if none is).

    Steps from ``start`` double until the entry is reached, then the last step is halved;
    all entries of ``drive`` go on side by side.
    """
    low, step = start.copy(), np.ones(len(drive), np.int64)
    going = np.flatnonzero(low < stop)
    while len(going):
        probe = np.minimum(low[going] + step[going], stop[going]) - 1
        below = longer[probe] < drive[going]
        going = going[below]
        low[going] = probe[below] + 1
        step[going] *= 2
        going = going[low[going] < stop[going]]
    high = np.minimum(low + step, stop)  # the place lies in low to high
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        below = longer[middle] < drive[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


class Tokens:
    """The tokens of many texts in a row: ids, ends in bytes of all texts, how many a text has."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        self.ids, self.sizes, self.counts = ids, sizes, counts
        self.ends = np.cumsum(sizes)
        self.first = np.cumsum(counts) - counts


def intersect(short: Tokens, long: Tokens, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of ``short`` in the ``texts`` (numbers), their first link in ``long`` and the one after the last.

    A token from byte s to byte e overlaps the tokens of the other list from the one
    after the last end up to s, to the first end of e or more.
    """
    counts = short.counts[texts]
    drive = ragged(short.first[texts], counts)
    if not len(drive):
        return drive, drive, drive
    start, stop = long.first[texts], long.first[texts] + long.counts[texts]
    rank = gallop(short.ends[drive], long.ends, np.repeat(start, counts), np.repeat(stop, counts))
    after = rank + (long.ends[np.minimum(rank, len(long.ends) - 1)] == short.ends[drive])
    head = np.cumsum(counts) - counts
    first = np.append(0, after[:-1])  # where the token before ends
    first[head[counts > 0]] = start[counts > 0]
    return drive, first, rank + 1


class Aligner:
    """Both tokenizers, and the memory of aligned pieces."""

    def __init__(self, path_a: str, path_b: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = processor(path_b)
        value = {c: b for b, c in enumerate(byte_characters())}
        bytes_a = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            bytes_a[number] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_a, self.size_b = (np.array([len(x) for x in every], np.int64) for every in (bytes_a, bytes_b))
        self.text_a, self.text_b = (np.frombuffer(b"".join(every), np.uint8) for every in (bytes_a, bytes_b))
        # ids as text with what comes behind them: A's within and at the end of a group, B's within, at the end, and last
        self.names = [f"{i}{end}" for ids, ends in ((len(bytes_a), ",|"), (len(bytes_b), (",", ";", ""))) for end in ends for i in range(ids)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # as text, one of each piece
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, 1 if the bytes agree
        self.links = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.held = 0

    def encoded(self, keys: list[str]) -> tuple[Tokens, Tokens, np.ndarray]:
        """The tokens of A and of B of pieces, and whether their bytes are the piece's. A piece whose
        bytes a tokenizer changes has no tokens."""
        whole = [" " + k for k in keys]
        want = np.frombuffer("".join(whole).encode(), np.uint8)
        sizes = np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in whole), np.int64, len(whole))
        out, good = [], np.ones(len(keys), bool)
        for rows, size, text in ((self._rows_a(keys), self.size_a, self.text_a), (self._rows_b(keys), self.size_b, self.text_b)):
            joined = np.repeat(np.arange(len(rows)), [n for n, _ in rows])  # the row that a piece is in
            ids = np.fromiter(chain.from_iterable(r for _, r in rows), np.int64)
            of = np.repeat(np.arange(len(rows)), [len(r) for _, r in rows])
            spelled = np.bincount(of, size[ids], len(rows)).astype(np.int64)
            wanted = np.bincount(joined, sizes, len(rows)).astype(np.int64)
            bad = spelled != wanted
            begins = np.cumsum(size) - size
            fits = ~bad[of]
            got = text[ragged(begins[ids[fits]], size[ids[fits]])]
            differs = np.flatnonzero(got != want[np.repeat(~bad[joined], sizes)])
            bad[np.repeat(of[fits], size[ids[fits]])[differs]] = True
            ids, fits = ids[~bad[of]], ~bad[joined]
            ends, cuts = np.cumsum(size[ids]), np.cumsum(sizes[fits])
            upto = np.searchsorted(ends, cuts) + 1
            if len(cuts):
                bad[joined[fits][ends[np.minimum(upto, len(ends)) - 1] != cuts]] = True  # a token lies across two pieces
            out.append((ids, np.diff(upto, prepend=0), fits))
            good &= ~bad[joined]
        parts = []
        for (ids, counts, fits), size in zip(out, (self.size_a, self.size_b)):
            keep = np.repeat(good[fits], counts)
            every = np.zeros(len(keys), np.int64)
            every[fits] = counts
            parts.append(Tokens(ids[keep], size[ids[keep]], every * good))
        return *parts, good

    def _rows_a(self, keys: list[str]) -> list[tuple[int, list[int]]]:
        rows = joined_rows(keys)
        found = self.a.encode_batch_fast([" " + text for _, text in rows], add_special_tokens=False)
        return [(n, e.ids) for (n, _), e in zip(rows, found)]

    def _rows_b(self, keys: list[str]) -> list[tuple[int, list[int]]]:
        rows = joined_rows(keys)
        return [(n, ids) for (n, _), ids in zip(rows, self.b.encode([text for _, text in rows], num_threads=1))]

    def learn(self, keys: list[str]) -> None:
        """Align the pieces that are new. A piece is given without its first space.

        Pieces without white space at their ends stand in a row for the libraries, as the
        tokenizers do not merge across the space between; a row whose bytes differ is
        encoded again piece by piece.
        """
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        if not new:
            return
        plain = [k for k in new if not (k[0].isspace() or k[-1].isspace() or "▁" in k)]
        if len(plain) < len(new):
            known = set(plain)
            for key in new:
                if key not in known:
                    self._learn([key])
        if plain:
            self._learn(plain)

    def _learn(self, new: list[str]) -> None:
        a, b, agrees = self.encoded(new)
        if len(new) > 1 and not agrees.all():
            for key in (k for k, ok in zip(new, agrees) if not ok):
                self._learn([key])
            new = [k for k, ok in zip(new, agrees) if ok]
            if not new:
                return
            a, b, agrees = self.encoded(new)
        links, counts, owner = [], np.zeros(len(new), np.int64), []
        last = np.zeros(len(a.ids), np.int64)  # A's tokens at whose end a token of B ends: one more than its place in B
        for short, long, of_a, texts in ((a, b, True, np.flatnonzero(a.counts <= b.counts)), (b, a, False, np.flatnonzero(a.counts > b.counts))):
            drive, first, end = intersect(short, long, texts)
            common = np.flatnonzero(short.ends[drive] == long.ends[end - 1])
            last[drive[common] if of_a else end[common] - 1] = (end[common] if of_a else drive[common] + 1)
            n = end - first
            one, other = short.ids[np.repeat(drive, n)], long.ids[ragged(first, n)]
            links.append(one * PAIR + other if of_a else other * PAIR + one)
            of = np.repeat(np.repeat(texts, short.counts[texts]), n)
            counts += np.bincount(of, minlength=len(new))
            owner.append(of)
        order = np.argsort(np.concatenate(owner), kind="stable")
        self._add(new, a, b, last, np.concatenate(links)[order], counts, agrees)

    def _add(self, new: list[str], a: Tokens, b: Tokens, last: np.ndarray, links: np.ndarray, counts: np.ndarray, agrees: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        cut, cut_b = np.flatnonzero(last), last[last > 0] - 1  # last tokens of the groups
        groups = np.bincount(np.repeat(np.arange(len(new)), a.counts)[cut], minlength=len(new))
        i, j = np.arange(len(a.ids)), np.arange(len(b.ids))
        of_i, of_j = np.searchsorted(cut, i), np.searchsorted(cut_b, j)  # their groups
        n_a, n_b = len(self.size_a), len(self.size_b)
        final = np.zeros(len(cut), bool)
        final[np.cumsum(groups)[groups > 0] - 1] = True  # groups that end a piece
        codes = np.empty(len(i) + len(j), np.int64)
        codes[i + np.append(0, cut_b + 1)[of_i]] = a.ids + n_a * (i == cut[of_i])
        codes[j + cut[of_j] + 1] = 2 * n_a + b.ids + n_b * ((j == cut_b[of_j]) * (1 + final[of_j]))
        shown = list(map(self.names.__getitem__, codes.tolist()))
        ends = np.cumsum(a.counts + b.counts).tolist()
        held = start = 0
        for end in ends:
            self.groups.append("".join(shown[start:end]))
            held += len(self.groups[-1])
            start = end
        self.numbers = np.concatenate([self.numbers, np.column_stack([a.counts, b.counts, groups, agrees])])
        self.at = np.concatenate([self.at, np.cumsum(counts) - counts + len(self.links)])
        self.size = np.concatenate([self.size, counts])
        self.links = np.concatenate([self.links, links])
        self.held += held + 8 * len(links) + sum(map(len, new)) + 250 * len(new)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of A, of B and groups) and groups as text, of each text; the distinct
        links of all texts, how often each is there, and where those of a text begin and end."""
        keys = [pieces_of(t) for t in texts]
        flat = [k for own in keys for k in own]
        self.learn(flat)
        of = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        text = np.repeat(np.arange(len(texts)), counts)
        good = np.bincount(text, 1 - self.numbers[of, 3], len(texts)) == 0  # texts with bytes that differ have no tokens
        numbers = np.column_stack([np.bincount(text, self.numbers[of, c], len(texts)) for c in range(3)]).astype(np.int64) * good[:, None]
        shown, start = [], 0
        groups = self.groups
        for n, ok in zip(counts.tolist(), good.tolist()):
            shown.append(";".join([groups[k] for k in of[start:start + n].tolist()]) if ok else "")
            start += n
        links = self.links[ragged(self.at[of], self.size[of])]
        owner = np.repeat(text, self.size[of])
        links, owner = links[good[owner]], owner[good[owner]]
        order = np.lexsort((links, owner))
        links, owner = links[order], owner[order]
        new = np.flatnonzero(np.r_[True, (links[1:] != links[:-1]) | (owner[1:] != owner[:-1])]) if len(links) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(links)))
        bounds = np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(texts))))
        if self.held > REMEMBERED:
            self.forget()
        return numbers, shown, links[new], times, bounds


def pieces_of(text: str) -> list[str]:
    """The text cut at single spaces between characters that are no white space, each
    piece without that space. The space that both tokenizers get in front is left out, too."""
    if not text:
        return []
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    joined = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and joined[-1] and not joined[-1][-1].isspace():
            joined.append(part)
        else:
            joined[-1] += " " + part
    return joined


def lists(bounds: np.ndarray, values: np.ndarray, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind)))


def joined_rows(keys: list[str]) -> list[tuple[int, str]]:
    """Pieces put in rows by the spaces that belong between them, and how many are in each."""
    return [(len(part), " ".join(part)) for part in (keys[k:k + JOINED] for k in range(0, len(keys), JOINED))]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The aligned tokens of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_a, n_b, n_groups, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of A and
    of B, group by group), and the distinct ``links`` (A's id times 2^32 plus B's id) with
    ``times``, how often each occurs. Special strings in a text are plain text. A null or
    empty text, and one whose bytes a tokenizer changes, has no tokens: zeros, an empty
    text, no links. Repeated rows and null ids are kept; other columns are not looked at.
    """
    path_a, path_b = path_a or tokenizer_path(BYTES), path_b or tokenizer_path(MODEL)
    fields = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
              ("links", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for start, end in blocks(batch, "text", BLOCK):
                part = batch.slice(start, end - start)
                numbers, groups, links, times, bounds = own.align(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(numbers[:, c]) for c in range(3)), pa.array(groups, pa.string()),
                     lists(bounds, links, np.int64), lists(bounds, times, np.int32)], schema=schema)

    ddl = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).mapInArrow(run, ddl)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether no pair of the
    same id of A is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([pairs, *waiting])
            weight = np.concatenate([counts, np.ones(len(every) - len(pairs), np.int64)])
            found, of = np.unique(every, return_inverse=True)
            return found, np.bincount(of, weight, len(found)).astype(np.int64)

        for batch in batches:
            flat = batch.column("links").flatten().to_numpy()
            waiting.append(flat)
            size += len(flat)
            if size > 2 * HELD:
                pairs, counts = merged()
                waiting, size = [], 0
                if len(pairs) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    counted = stored(aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of_a = F.shiftright("pair", 32)
    # a row for each id of A at most, so the vocabulary bounds it
    highest = counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return stored(counted.withColumn("a", of_a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def frequent(pairs: DataFrame, head_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, n, best) of the most frequent pairs that take ``head_bytes`` at most, by pair.

    The frequency from which on they fit is found from counts by frequency, about the
    square root of the number of links at most."""
    sizes = pairs.where("n > 1").groupBy("n").agg((F.count(F.lit(1)) * 17).alias("size")).toArrow()
    order = np.argsort(-np.asarray(sizes.column("n")), kind="stable")
    within = np.cumsum(np.asarray(sizes.column("size"))[order]) <= head_bytes
    if not within.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    least = int(np.asarray(sizes.column("n"))[order][within][-1])
    head = pairs.where(F.col("n") >= least).toArrow().sort_by("pair")
    return np.asarray(head.column("pair")), np.asarray(head.column("n")), np.asarray(head.column("best"))


def score(aligned: DataFrame, head_bytes: int = 12_000_000) -> DataFrame:
    """``aligned`` without ``links`` and ``times``, with n_links, n_best and count_sum.

    A link's count is that of its id pair over all rows of ``aligned``. n_best are the
    links whose count is the highest of their id of A, ties included; count_sum is the
    sum over the links. ``aligned`` is written once and read twice.
    """
    others = [c for c in aligned.columns if c not in ("links", "times")]
    rows = stored(aligned.withColumn("_al_row", row_id()), "aligned")
    pairs = pair_counts(rows)
    head = rows.sparkSession.sparkContext.broadcast(frequent(pairs, head_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = head.value
        for batch in batches:
            every = np.asarray(batch.column("links").offsets)
            cuts = np.searchsorted(every, np.arange(every[0], every[-1], LINKS)).tolist() + [batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                pair, often = part.column("links").flatten().to_numpy(), part.column("times").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(end - start), np.diff(every[start:end + 1]))
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                seen = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                at, here, weight = at[seen], row[seen], often[seen]
                total = np.zeros((3, end - start), np.int64)
                np.add.at(total[0], row, often)
                np.add.at(total[1], here, weight * best[at])
                np.add.at(total[2], here, weight * n[at])
                bounds = np.append(0, np.cumsum(np.bincount(row[~seen], minlength=end - start)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_al_row"), *map(pa.array, total), lists(bounds, pair[~seen], np.int64), lists(bounds, often[~seen], np.int32)],
                    names=["_al_row", "n_links", "known_best", "known_sum", "rare", "often"])

    summed = rows.select("_al_row", "links", "times").mapInArrow(
        run, "_al_row long, n_links long, known_best long, known_sum long, rare array<long>, often array<int>")
    found = stored(summed, "scores")
    rest = (found.select("_al_row", F.explode(F.arrays_zip("rare", "often")).alias("x"))
            .select("_al_row", F.col("x.rare").alias("pair"), F.col("x.often").alias("often")).join(pairs, "pair")
            .groupBy("_al_row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
                                    F.sum(F.col("often") * F.col("n")).alias("more_sum")))
    sums = found.drop("rare", "often").join(rest, "_al_row", "left")
    return rows.select("_al_row", *others).join(sums, "_al_row").select(
        *others, "n_links", (F.col("known_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("known_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
