"""Maximum-inner-product search with score-aware (anisotropic) product quantisation and four-bit table scans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added, discard, drawn, stored


#: Bytes of one array at work in a task or in the driver: slices of rows and groups of queries follow from it.
WORK_BYTES = 16 << 20


def _rows_of(each: int, most: int) -> int:
    """How many rows of `each` bytes make an array of WORK_BYTES, `most` at most."""
    return max(1, min(most, WORK_BYTES // each))


@dataclass(frozen=True)
class Quantiser:
    """Codebooks: for each subspace 16 centroids; `pull` is the weight of the residual parallel to the vector."""

    books: np.ndarray  # (subspaces, 16, width)
    pull: float
    dim: int

    def _split(self, unit: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        padded = np.zeros((len(unit), m * w), np.float64)
        padded[:, : unit.shape[1]] = unit
        return padded.reshape(len(unit), m, w)

    def assign(self, unit: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes (n, subspaces): coordinate descent on |r|^2 + (pull - 1) (x . r)^2 with r = x - decoded(x)."""
        step = _rows_of(len(self.books) * 16 * 8, len(unit))
        return np.concatenate([self._assign(unit[at : at + step], rounds) for at in range(0, len(unit), step)])

    def _assign(self, unit: np.ndarray, rounds: int) -> np.ndarray:
        x, books = self._split(unit), self.books
        n, m, _ = x.shape
        near = np.stack([((x[:, j, None, :] - books[j]) ** 2).sum(-1) for j in range(m)], 1)  # (n, m, 16)
        along = np.stack([x[:, j] @ books[j].T for j in range(m)], 1)
        own = (x**2).sum(-1)
        codes = near.argmin(-1)
        parallel = own - np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
        total = parallel.sum(1)
        for _ in range(rounds):
            for j in range(m):
                rest = total - parallel[:, j]
                options = own[:, j, None] - along[:, j]
                codes[:, j] = (near[:, j] + (self.pull - 1) * (rest[:, None] + options) ** 2).argmin(1)
                parallel[:, j] = np.take_along_axis(options, codes[:, j, None], 1)[:, 0]
                total = rest + parallel[:, j]
        return codes

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        codes = self.assign(unit).astype(np.uint8)
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, queries, 256): what each byte of a code adds to each query's inner product."""
        q = self._split(queries)
        each = np.einsum("qmw,mkw->mqk", q, self.books).astype(np.float32)
        low, high = each[::2], each[1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(low), len(queries), 256)


def fit(sample: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
    """Train on unit vectors: assignments and the least-squares centroids of the same loss take turns."""
    dim = sample.shape[1]
    m = -(-dim // width)
    m += m % 2
    pull = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.Generator(np.random.PCG64(seed))
    q = Quantiser(np.zeros((m, 16, width)), pull, dim)
    x = q._split(sample)
    for j in range(m):
        q.books[j] = x[rng.choice(len(x), 16, replace=len(x) < 16), j] + rng.normal(0, 1e-6, (16, width))
    for _ in range(rounds):
        codes = q.assign(sample, 1)
        decoded = np.stack([q.books[j][codes[:, j]] for j in range(m)], 1)
        parallel = (x * (x - decoded)).sum(-1)
        for j in range(m):
            rest = parallel.sum(1) - parallel[:, j]
            for k in range(16):
                own = codes[:, j] == k
                if own.any():
                    v = x[own, j]
                    left = own.sum() * np.eye(width) + (pull - 1) * v.T @ v
                    right = v.sum(0) + (pull - 1) * (v * (rest[own] + (v**2).sum(1))[:, None]).sum(0)
                    q.books[j, k] = np.linalg.solve(left, right)
            parallel[:, j] = (x[:, j] * (x[:, j] - q.books[j][codes[:, j]])).sum(-1)
    return q


def usable(vector: Column, dim: int | None = None) -> Column:
    """Not null, of the dimension, without null or non-finite components, and not zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) == dim if dim else F.size(v) > 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, np.float64).reshape(-1, dim)


def _whole(x: np.ndarray) -> np.ndarray:
    """Each row as one value that can be sorted and compared."""
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclass(frozen=True)
class Index:
    """Stored codes and vectors of every usable row: (id, vector array<double>, code binary)."""

    rows: DataFrame
    quantiser: Quantiser


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample_rows: int = 8192, width: int = 2, sample_bytes: int = 8 << 20) -> Index | None:
    """Fit codebooks on about sample_rows rows, or as many as have sample_bytes together where these are fewer (by a hash of
    the key, never more than twice as many; any so many rows where so few keys are repeated so often that none of them is
    drawn), and encode every usable row. None if no row is usable.

    The dimension is that of most rows, counted over all of them (the smaller one of a tie). Left out: rows with a null
    key, and vectors that are null, zero, of another dimension or with null or non-finite components.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if most is None:
        return None
    dim = most["dim"]
    own = rows.where(F.size("vector") == dim)
    size = max(16, min(sample_rows, sample_bytes // (8 * dim)))
    sample = _matrix(drawn(own, "id", size).select("vector").toArrow().column(0), dim)
    if not len(sample):
        sample = _matrix(own.select("vector").limit(size).toArrow().column(0), dim)
    quantiser = fit(_unit(sample[np.argsort(_whole(sample), kind="stable")]), width)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = _rows_of(8 * dim, 4096)
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                codes = quantiser.encode(_unit(_matrix(part.column(1), dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "vector", "code"])

    return Index(stored(own.mapInArrow(encode, "id long, vector array<double>, code binary"), "ann-index"), quantiser)


def _first_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Positions of at most k + 1 rows of each distinct vector, those with the smallest ids.

    Equal vectors tie at any query and ties go to smaller ids, so further copies can be in no result.
    """
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(_whole(vectors[order]), return_inverse=True)
    by = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    rank = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[by[rank <= k]])


def _scan(index: Index, q_ids: np.ndarray, q_vectors: np.ndarray, k: int, rerank: int) -> DataFrame:
    """Each task's k nearest of one block of queries, by exact cosine of its `rerank` best by table scan a chunk.

    A task reads its rows' codes once for the whole block. Rows come in slices, queries in groups and reranked vectors in
    smaller ones, each an array of WORK_BYTES at most whatever the dimension; so memory grows with the block by its vectors and
    the k best of each query only.
    """
    dim, quantiser = index.quantiser.dim, index.quantiser

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt((q_vectors * q_vectors).sum(1))
        unit, n = q_vectors / norms[:, None], len(q_ids)
        m = len(quantiser.books)
        group = _rows_of(m // 2 * 1024, 256)
        few = quantiser.tables(unit) if n * m // 2 * 1024 <= 2 * WORK_BYTES else None
        best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for b in batches:
            step = _rows_of(8 * dim, 8192)
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids, vectors = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                own = _first_copies(ids, vectors, k)
                ids, vectors, codes = ids[own], vectors[own], codes[own]
                lengths = np.sqrt((vectors * vectors).sum(1))
                take = min(len(ids), rerank)
                for lo in range(0, n, group):
                    hi = min(n, lo + group)
                    tables = quantiser.tables(unit[lo:hi]) if few is None else few[:, lo:hi]
                    approx = np.zeros((hi - lo, len(ids)), np.float32)
                    for j in range(codes.shape[1]):
                        approx += np.take(tables[j], codes[:, j], axis=1)
                    pick = np.argpartition(-approx, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (hi - lo, 1))
                    exact, few_q = np.empty(pick.shape), _rows_of(8 * dim * take, hi - lo)
                    for x in range(0, hi - lo, few_q):
                        exact[x : x + few_q] = (vectors[pick[x : x + few_q]] * q_vectors[lo + x : min(hi, lo + x + few_q), None, :]).sum(-1)
                    exact /= lengths[pick] * norms[lo:hi, None]
                    found = ids[pick]
                    exact[found == q_ids[lo:hi, None]] = -np.inf
                    s, i = np.concatenate([best_s[lo:hi], exact], 1), np.concatenate([best_i[lo:hi], found], 1)
                    first = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s[lo:hi], best_i[lo:hi] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
        there = np.isfinite(best_s)
        if there.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, k)[there.ravel()]), pa.array(best_i[there]), pa.array(best_s[there])], ["query_id", "vec_id", "score"]
            )

    return index.rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _found(index: Index, part: list, k: int, rerank: int, before: DataFrame | None) -> DataFrame:
    """What one block of queries finds, appended to what the blocks before it have."""
    found = _scan(index, np.array([r.q for r in part], np.int64), np.array([r.v for r in part], np.float64), k, rerank)
    return added(found, before, "ann-found")


def search(index: Index | None, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, rerank: int = 96, block_bytes: int = 16_000_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each usable query's k nearest rows found, by cosine in double precision,
    ties to the smaller vec_id; a row with the query's own id is no candidate.

    The stated query set meets all rows in blocks of about block_bytes of query vectors (31,250 of 64 dimensions): a
    block travels to every task, which scans its rows' codes and reranks exactly, and gives back k rows a query. A block
    is a scan of the whole index, whose work outweighs its start by far; what it has found is appended to one table in
    the shared folder before the next block is fetched, so the driver holds one block and one plan however many there
    are. Rows of a repeated query id count once (the smallest vector). Rows of the index that share an id are
    candidates each, but a pair of equal id and score counts once. Queries that are not usable give no rows, nor does an
    empty index.
    """
    spark = queries.sparkSession
    out = None
    if index is not None:
        dim = index.quantiser.dim
        asked = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
        asked = asked.where(F.col("q").isNotNull() & usable(F.col("v"), dim)).groupBy("q").agg(F.min("v").alias("v"))
        asked = stored(asked, "ann-queries")
        part: list = []
        for r in asked.toLocalIterator():
            part.append(r)
            if len(part) * dim * 8 >= block_bytes:
                out, part = _found(index, part, k, rerank, out), []
        if part:
            out = _found(index, part, k, rerank, out)
        discard(asked)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # A row of the index may be stored twice under one id; the pair counts once.
    return out.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
