"""A stored vector index: cells of a coarse quantiser, product-quantised codes in them.

A vector belongs to the cell of its nearest centroid. What is left of it beyond the
centroid is cut into parts, and each part is stored as the number of the nearest entry of
that part's codebook: some bytes a vector. Rows are (cell, id, code, vec) in files sorted
by cell, so a search reads ``cell, id, code`` of the probed cells only; vectors are
fetched for the few best codes of each query and compared exactly.

Centroids and codebooks are learned by rounds of Lloyd's method. Tasks hand on one sum
per entry, so what reaches the driver in a round is as large as the quantiser, never as
the data. The quantiser is learned from a sample of bounded size, every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claravoz.functions import vectors as fv
from claravoz.operators.neighbors import (
    BLOCK_ROWS, BROADCAST_BYTES, DIGITS, _field, _matrix, _top_k, blocked_sides, exact_knn, recall,
)
from claravoz.scratch import reliable_checkpoint

_CHUNK_CELLS = 4_000_000
# Distances that decide a cell or a code are rounded to this many digits, ties by number.
_NEAR_DIGITS = 9
_ENTRY = "part int, entry int, vals array<double>"


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared L2 distances of all points to all centres."""
    away = (points * points).sum(1)[:, None] - 2.0 * (points @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.round(np.maximum(away, 0.0), _NEAR_DIGITS)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, _CHUNK_CELLS // max(1, len(centres)))
    found = [_distances(points[i:i + step], centres).argmin(1) for i in range(0, len(points), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _cut(m: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, width): the columns in ``parts`` equal parts, zeros where they do not fill them."""
    width = math.ceil(m.shape[1] / parts)
    padded = np.pad(m, ((0, 0), (0, parts * width - m.shape[1])))
    return padded.reshape(len(m), parts, width).transpose(1, 0, 2)


@dataclass(frozen=True)
class Quantiser:
    """``centroids`` (cells, dimensions) and ``books`` (parts, entries, width)."""

    centroids: np.ndarray
    books: np.ndarray

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (rows, parts) of unit vectors."""
        cell = _nearest(m, self.centroids)
        left = _cut(m - self.centroids[cell], len(self.books))
        return cell, np.stack([_nearest(p, b) for p, b in zip(left, self.books)], 1).astype(np.uint8)

    def code_distances(self, asked: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(queries, rows): distances of queries to the vectors that the codes stand for."""
        left = _cut(asked - self.centroids[cell], len(self.books))
        total = np.zeros((len(asked), len(codes)))
        for p, (part, book) in enumerate(zip(left, self.books)):
            total += _distances(part, book)[:, codes[:, p]]
        return np.round(total, DIGITS)


def lloyd(rows: DataFrame, vec_col: str, centres: np.ndarray, rounds: int,
          prepare: Callable[[np.ndarray], np.ndarray] = lambda m: m) -> np.ndarray:
    """``centres`` (parts, entries, width) after ``rounds`` of moving each to the mean of its rows.

    ``prepare`` makes the matrix to be cut into parts from a block of unit vectors.
    An entry without rows stays where it is.
    """
    parts, entries, width = centres.shape
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total, n = np.zeros((parts, entries, width)), np.zeros((parts, entries), np.int64)
            for pdf in batches:
                for p, part in enumerate(_cut(prepare(_matrix(pdf[vec_col])), parts)) if len(pdf) else ():
                    own = _nearest(part, shared.value[p])
                    np.add.at(total[p], own, part)
                    n[p] += np.bincount(own, minlength=entries)
            part, entry = np.nonzero(n)
            if len(part):  # Arrow makes no array of lists from an empty column
                yield pd.DataFrame({"part": part, "entry": entry, "n": n[part, entry], "total": list(total[part, entry])})

        moved = rows.select(vec_col).mapInPandas(sums, "part int, entry int, n long, total array<double>") \
            .select("part", "entry", "n", F.posexplode("total").alias("at", "x")) \
            .groupBy("part", "entry", "at").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        centres = centres.copy()
        where = tuple(np.asarray(moved.column(c)) for c in ("part", "entry", "at"))
        centres[where] = np.asarray(moved.column("x"))
    return centres


def learn(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec", cells: int | None = None, parts: int = 8,
          entries: int = 256, rounds: int = 8, sample_rows: int = 200_000,
          quantiser_bytes: int = BROADCAST_BYTES) -> Quantiser:
    """A quantiser for these vectors.

    It is learned from about ``sample_rows`` vectors, those with the smallest hash of
    their id, and starts from the first of these by MD5 of the id. ``cells`` is by
    default the root of the number of vectors, within ``quantiser_bytes``. ``rounds=0``
    keeps the vectors it starts from. Null vectors are left out; without any vector
    there is nothing to learn from and a ValueError is raised.
    """
    known = vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    if not size["n"]:
        raise ValueError("an index needs at least one vector to learn from")
    n, d = size["n"], size["d"]
    if cells is None:
        cells = min(math.ceil(math.sqrt(n)), max(1, quantiser_bytes // (8 * d)))
    if n > sample_rows:
        share = int(2.0 ** 64 * sample_rows / n) - 2 ** 63
        known = known.where(F.xxhash64(id_col) <= F.lit(share))
    sample = reliable_checkpoint(known)
    first = sample.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(max(cells, min(entries, 256))).collect()
    start = _matrix([r[vec_col] for r in first])
    centroids = lloyd(sample, vec_col, start[None, :cells], rounds)[0]

    def beyond(m: np.ndarray) -> np.ndarray:
        return m - centroids[_nearest(m, centroids)]

    begin = _cut(beyond(start[-min(entries, 256):]), parts)
    return Quantiser(centroids, lloyd(sample, vec_col, begin, rounds, beyond))


class VectorIndex:
    """Rows (cell, id, code, vec) of unit vectors at ``path``, with their quantiser."""

    def __init__(self, spark: SparkSession, path: str, quantiser: Quantiser, probes: int = 16,
                 candidates: int = 100) -> None:
        self.spark, self.path, self.quantiser = spark, path, quantiser
        self.probes, self.candidates = probes, candidates

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "vec", **options) -> VectorIndex:
        """Learn a quantiser (options of :func:`learn`), store it, and index every vector."""
        index = cls.create(vectors.sparkSession, path, learn(vectors, id_col, vec_col, **options))
        index.add(vectors, id_col, vec_col)
        return index

    @classmethod
    def create(cls, spark: SparkSession, path: str, quantiser: Quantiser) -> VectorIndex:
        """An index without vectors; ``path`` must not hold one."""
        entries = [(-1, i, c.tolist()) for i, c in enumerate(quantiser.centroids)] \
            + [(p, i, c.tolist()) for p, b in enumerate(quantiser.books) for i, c in enumerate(b)]
        spark.createDataFrame(entries, _ENTRY).write.parquet(f"{path}/quantiser")
        index = cls(spark, path, quantiser)
        index._save_settings()
        return index

    def _save_settings(self) -> None:
        self.spark.createDataFrame([(self.probes, self.candidates)], "probes int, candidates int").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/quantiser").orderBy("part", "entry").collect()
        centroids = np.array([r["vals"] for r in rows if r["part"] < 0])
        books = [[r["vals"] for r in rows if r["part"] == p] for p in range(max(r["part"] for r in rows) + 1)]
        return cls(spark, path, Quantiser(centroids, np.array(books)), *spark.read.parquet(f"{path}/settings").first())

    def add(self, vectors: DataFrame, id_col: str = "id", vec_col: str = "vec") -> None:
        """Append vectors under the quantiser as it is; null vectors are left out."""
        shared = self.spark.sparkContext.broadcast(self.quantiser)
        rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))

        def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    m = _matrix(pdf["vec"])
                    cell, codes = shared.value.encode(m)
                    yield pd.DataFrame({"cell": cell, "id": pdf["id"].to_numpy(), "code": [c.tobytes() for c in codes],
                                        "vec": list(m.astype(np.float32))})

        rows.mapInPandas(encoded, f"cell int, {_field(rows, 'id')}, code binary, vec array<float>") \
            .repartitionByRange("cell", "id").sortWithinPartitions("cell", "id") \
            .write.mode("append").parquet(f"{self.path}/vectors")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _probed(self, queries: DataFrame, probes: int, query_id: str, query_vec: str) -> DataFrame:
        """(query_id, cell, nth, query_vec): every query with its ``probes`` nearest cells."""
        shared = self.spark.sparkContext.broadcast(self.quantiser.centroids)
        asked = queries.where(F.col(query_vec).isNotNull()).select(query_id, query_vec)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                step = max(1, _CHUNK_CELLS // len(shared.value))
                for i in range(0, len(pdf), step):
                    ids, m = pdf[query_id].to_numpy()[i:i + step], _matrix(pdf[query_vec].iloc[i:i + step])
                    cells = np.argsort(_distances(m, shared.value), axis=1, kind="stable")[:, :probes]
                    which = np.repeat(np.arange(len(m)), cells.shape[1])
                    nth = np.tile(np.arange(cells.shape[1]), len(m))
                    yield pd.DataFrame({query_id: ids[which], "cell": cells.ravel(), "nth": nth, query_vec: list(m[which])})

        return asked.mapInPandas(nearest, f"{_field(asked, query_id)}, cell int, nth int, `{query_vec}` array<double>")

    def calibrate(self, target: float = 0.95, k: int = 10, queries: int = 100) -> float:
        """Set and store ``probes`` and ``candidates`` for a share of ``target`` of the true
        neighbours, and return the share that was measured.

        Four times ``queries`` indexed vectors, from each cell the first by a salted MD5 of their ids,
        are compared with all others, exactly. Without the salt they would be those that the
        centroids started from, whose neighbours are found more easily than most. The quarter with the farthest neighbours is asked, so a
        large group of near copies, whose neighbours are easily found, does not stand for all
        vectors. The cells of what they find say how many cells to probe; then candidates are doubled until the share is reached or every probed vector is one.
        """
        rows = self.rows()
        digest = F.md5(F.concat(F.lit("calibrate "), F.col("id").cast("string")))
        each = 2 * math.ceil(4 * queries / len(self.quantiser.centroids))
        turn = F.row_number().over(Window.partitionBy("cell").orderBy(digest, "id"))
        seen = reliable_checkpoint(rows.withColumn("_turn", turn).where(F.col("_turn") <= each).orderBy("_turn", digest, "id").limit(4 * queries)
                                   .select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")))
        nearest = reliable_checkpoint(exact_knn(seen, rows, k, exclude_self=True))
        far = nearest.groupBy("query_id").agg(F.max("distance").alias("far")).orderBy(F.desc("far"), "query_id").limit(queries).select("query_id")
        asked = reliable_checkpoint(seen.join(far, "query_id"))
        truth = nearest.join(asked.select("query_id").distinct(), "query_id", "left_semi")
        place = Window.partitionBy("query_id").orderBy("nth")
        ranked = self._probed(asked, len(self.quantiser.centroids), "query_id", "query_vec") \
            .withColumn("rank", F.row_number().over(place)).select("query_id", "cell", "rank")
        cells = truth.join(rows.select("id", "cell"), "id")
        # leave half of what may be missed to the cells, half to the codes
        share = (1 + target) / 2
        needed = cells.join(ranked, ["query_id", "cell"]).agg(F.percentile("rank", F.lit(share))).first()[0]
        self.probes, self.candidates = math.ceil(needed or 1), 10 * k
        total = rows.count()
        while True:
            found = recall(self.search(asked, k, exclude_self=True), truth).first()["recall"]
            if found is None or found >= target or self.candidates >= total:
                break
            self.candidates *= 2
        self._save_settings()
        return 1.0 if found is None else found

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None,
               query_id: str = "query_id", query_vec: str = "query_vec", exclude_self: bool = False,
               among: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """The k nearest vectors of every query: (query_id, id, distance, position).

        Of the ``probes`` cells nearest to a query, the ``candidates`` vectors with the
        nearest codes are compared exactly; without these two the index's own are taken,
        which :meth:`calibrate` sets. ``among`` (id) restricts the vectors before
        the codes are ranked. Equal distances are ordered by id. A query without a vector
        has no hits; a query id that repeats is one query for each of its vectors' hits.
        """
        probes, candidates = probes or self.probes, candidates or self.candidates
        shared = self.spark.sparkContext.broadcast(self.quantiser)
        asked = reliable_checkpoint(self._probed(queries, probes, query_id, query_vec).drop("nth"))
        # at most one number for each centroid, which the driver holds anyway
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
        vectors = self.rows()
        if len(cells) < len(self.quantiser.centroids):
            vectors = vectors.where(F.col("cell").isin(cells))
        if among is not None:
            vectors = vectors.join(among.select("id").distinct(), "id", "left_semi")
        most = candidates + (1 if exclude_self else 0)
        left, right, keys = blocked_sides(asked, vectors.select("cell", "id", "code"), ["cell"], query_id, "id", block_rows)

        def nearest_codes(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(q) and len(v):
                codes = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), -1)
                ids, m = v["id"].to_numpy(), np.stack(q[query_vec].to_numpy())
                order = np.argsort(ids, kind="stable")
                ids, codes = ids[order], codes[order]
                step = max(1, _CHUNK_CELLS // len(v))
                for i in range(0, len(q), step):
                    away = shared.value.code_distances(m[i:i + step], int(key[0]), codes)
                    best = np.argsort(away, axis=1, kind="stable")[:, :most]  # ties by id, as rows are in its order
                    which = np.repeat(np.arange(len(away)), best.shape[1])
                    found.append(pd.DataFrame({query_id: q[query_id].to_numpy()[i + which], "cell": int(key[0]),
                                               "id": ids[best.ravel()], "distance": away[which, best.ravel()]}))
            return pd.concat(found) if found else pd.DataFrame({query_id: [], "cell": [], "id": [], "distance": []})

        schema = f"{_field(asked, query_id)}, cell int, {_field(vectors, 'id')}, distance double"
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest_codes, schema)
        if exclude_self:
            found = found.where(F.col(query_id) != F.col("id"))
        near = _top_k(found, candidates, query_id, "id").select(query_id, "cell", "id").distinct()
        unit = queries.select(query_id, fv.unit(F.col(query_vec)).alias("_unit"))
        both = near.join(vectors.select("cell", "id", "vec"), ["cell", "id"]).join(unit, query_id)
        dot = F.aggregate(F.zip_with("_unit", "vec", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        exact = both.select(query_id, "id", F.round(F.greatest(2.0 - 2.0 * dot, F.lit(0.0)), DIGITS).alias("distance"))
        return _top_k(exact, k, query_id, "id")
