"""Personal data: patterns, and terms that give away whom a text is about.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Then the
corpus tells which words reveal them. For an entity ``e`` (one address or number)
and a term ``t`` of the same document, the pointwise mutual information of their
documents says how many of the bits that identify ``e`` are known from ``t``:

    PMI(e, t) / IC(e) = log2(P(e | t) N / n(e)) / log2(N / n(e))
    P(e | t) = (n(e, t) + n(e) / N) / (n(t) + 1)

The estimate is smoothed by one document that is like the whole corpus, so an entity
of a single text counts, too, and a chance meeting counts for less than a habit.
Terms at or over the disclosure threshold are generalised; those that give the
entity away completely, and did so in ``support`` documents, are removed, wherever they
stand in a document with the entity. (Sanchez and Batet, Automatic General-Purpose
Sanitization of Textual Documents.)

Counts are over all documents and whole texts. As n(e, t) is at most n(e), a term
with n(t) over (n(e) + n(e) / N) (N / n(e))^(1 - threshold) - 1 cannot disclose e; such
terms lose no disclosure when they are left out before the pairs are counted.
Entities of the same set of documents have the same counts and are one class, so a
list of addresses pairs with a term once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claravoz.llm.tables import join_by_run, row_id, stored, text_key, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number is tried from its first digit only: later starts in it would fail alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_FILTER_BITS = 23


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @: what stands before it must be
    local characters, as far back as they go, and no other start can match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """An address in lower case, a number by its digits, after the kind."""
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(_DIGIT.findall(value))}"


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words, lower-cased, that no span touches."""
    taken = sorted((a, b) for _, a, b in spans)
    at, reach = 0, 0
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            yield m.group().lower(), m.start(), m.end()


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _split(base: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(","))] if base else []


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: uid, run, doc_id, ``text_key``, ``base`` (its spans, joined), the
    number of each kind, base_sha256, its ``entities``, and its text if it has any."""
    keys = text_key(docs)
    carried = ["uid", "run", "doc_id", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, numbers, digest, entities, held = [], [[] for _ in BASE], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                spans = base_spans(text)
                base.append(_joined(spans))
                digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
                for out, kind in zip(numbers, BASE):
                    out.append(sum(s[0] == kind for s in spans))
                entities.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                held.append(text if spans else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(base, pa.string()), *(pa.array(n, pa.int64()) for n in numbers),
                 pa.array(digest, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(held, pa.string())],
                names=[*carried, "base", *(f"n_{k}" for k in BASE), "base_sha256", "entities", "held"])

    rows = docs.select(row_id().alias("uid"), F.spark_partition_id().alias("run"), "doc_id",
                       *(c.alias(n) for n, c in keys.items()), text_of(docs).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    numbers = ", ".join(f"n_{k} long" for k in BASE)
    return stored(rows.mapInArrow(
        run, f"{kinds}, base string, {numbers}, base_sha256 string, entities array<string>, held string"), "spans")


def _slot(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 42) >> (64 - _FILTER_BITS)


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): the documents that have each of ``terms.term`` (distinct)."""
    slot = F.shiftrightunsigned(F.xxhash64("term"), 64 - _FILTER_BITS)  # XXH64 with the seed 42, as in _slot
    found = terms.groupBy(F.shiftrightunsigned(slot, 3).alias("octet")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(F.lit(7)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    bits[np.asarray(found.column("octet"))] = np.asarray(found.column("bits")).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, seen = shared.value, {}, Counter()

        def wanted(word: str) -> bool:
            if word not in known:
                if len(known) > 400_000:
                    known.clear()
                at = _slot(word)
                known[word] = bool(held[at >> 3] >> (at & 7) & 1)
            return known[word]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(filter(wanted, set(_WORD.findall(text.as_py().lower()))))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    counted = docs.select(text_of(docs).alias("text")).mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


def document_terms(scanned: DataFrame) -> DataFrame:
    """(run, uid, term): the distinct terms of every document with an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, base = batch.column("held")[i].as_py(), batch.column("base")[i].as_py()
                terms = sorted({t for t, _, _ in terms_of(text, _split(base))})
                own = [pa.array([batch.column(c)[i].as_py()] * len(terms), k) for c, k in (("run", pa.int32()), ("uid", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.string())], names=["run", "uid", "term"])

    return scanned.where("held IS NOT NULL").select("run", "uid", "base", "held").mapInArrow(run, "run int, uid long, term string")


def disclosing(docs: DataFrame, scanned: DataFrame, threshold: float, certain: float, support: int) -> DataFrame:
    """(uid, term, kind): the terms of every document that reveal one of its entities."""
    total = float(scanned.count())
    named = scanned.select("run", "uid", F.explode("entities").alias("entity"))
    # entities of the same documents have the same digests of their sets of documents
    sets = stored(named.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), F.bit_xor(F.xxhash64("uid")).alias("set_a"),
        F.bit_xor(F.xxhash64(F.lit("b"), "uid")).alias("set_b")), "entities")
    most = F.col("n_entity") * (1 + 1 / total) * F.pow(total / F.col("n_entity"), F.lit(1 - threshold)) - 1 if total else F.lit(0.0)
    reach = sets.where(F.col("n_entity") < total).agg(F.max(most)).first()[0] or 0.0
    classes = join_by_run(named, "entity", sets).where(F.col("n_entity") < total) \
        .select("uid", "n_entity", "set_a", "set_b").distinct()
    terms = stored(document_terms(scanned), "terms")
    known = stored(document_frequency(docs, terms.select("term").distinct()).where(F.col("n") <= reach + 1e-6), "frequency")
    pairs = join_by_run(terms, "term", known).join(classes, "uid").where(F.col("n") <= most + 1e-6).select(
        "run", "uid", "term", "n", "n_entity", F.concat_ws(":", F.hex("set_a"), F.hex("set_b"), "term").alias("pair"))
    pairs = stored(pairs, "pairs")
    content = F.log2(total / F.col("n_entity"))
    smooth = F.log2((F.col("both") * total / F.col("n_entity") + 1) / (F.col("n") + 1)) / content
    plain = F.log2(F.col("both") * total / (F.col("n_entity") * F.col("n"))) / content
    found = pairs.groupBy("pair").agg(
        F.count(F.lit(1)).alias("both"), F.first("n").alias("n"), F.first("n_entity").alias("n_entity")).where(smooth >= threshold).select(
        "pair", F.when((plain >= certain) & (F.col("both") >= support), ADDED[1]).otherwise(ADDED[0]).alias("kind"))
    told = join_by_run(pairs.select("run", "uid", "term", "pair"), "pair", stored(found, "disclosing"))
    return told.groupBy("uid", "term").agg(F.max("kind").alias("kind"))


@F.arrow_udf(StringType())
def _added(texts: pa.Array, bases: pa.Array, generalised: pa.Array, removed: pa.Array) -> pa.Array:
    """Spans of every occurrence of the terms, by kind, then start, joined."""
    out = []
    for text, base, *terms in zip(texts, bases, generalised, removed):
        kinds = {t: k for k, ts in zip(ADDED, terms) for t in ts.as_py() or ()}
        spans = [(kinds[t], a, b) for t, a, b in terms_of(text.as_py(), _split(base.as_py())) if t in kinds] if kinds else []
        out.append(_joined(sorted(spans)))
    return pa.array(out, pa.string())


def find_spans(docs: DataFrame, threshold: float = 0.8, certain: float = 0.98, support: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans (base spans, then ``generalise`` and ``remove`` ones), n_added, ``text_key``.

    ``spans`` is kind:start:end, comma-joined, by kind, then start. A null text is
    empty. Repeated rows and null ids are kept, and repeats count as documents; an entity
    of all documents tells nothing. An empty table gives an empty result.
    """
    scanned = scan(docs)
    of = {k: F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(k) for k in ADDED}
    terms = disclosing(docs, scanned, threshold, certain, support).groupBy("uid").agg(*of.values())
    own = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256"]
    keys = list(text_key(docs))
    marked = scanned.where("held IS NOT NULL").join(terms, "uid", "left").select(
        *own, "base", _added("held", "base", *ADDED).alias("added"), *keys)
    rows = marked.unionByName(scanned.where("held IS NULL").select(*own, "base", F.lit("").alias("added"), *keys))
    parts = F.filter(F.array("base", "added"), lambda s: s != "")
    number = F.when(F.col("added") == "", 0).otherwise(F.size(F.split("added", ",")))
    return rows.select(*own, F.array_join(parts, ",").alias("spans"), number.cast("long").alias("n_added"), *keys)


@F.arrow_udf(StringType())
def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, listed in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None or not listed:
            out.append(text)
            continue
        parts, done = [], 0
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in listed.split(","))):
            if start < done:  # inside a longer span, as a card number in a phone number
                done = max(done, end)
                continue
            parts += [text[done:start], "" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]"]
            done = end
        out.append("".join([*parts, text[done:]]))
    return pa.array(out, pa.string())


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind, or taken out."""
    keys = list(text_key(docs))
    spans = find_spans(docs, **options).where("spans != ''").select(*keys, F.col("spans").alias("_key_spans")).dropDuplicates(keys)
    both = docs.withColumns(text_key(docs)).join(spans, keys, "left")
    return both.withColumn("text", _masked("text", "_key_spans")).select(*docs.columns)
