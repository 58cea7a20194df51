"""Nearest neighbours by score-aware quantisation, with an exact check of what it leaves open.

Small Euclidean distance is large inner product: ``|x - q|^2`` is
``|x|^2 - 2 <q, x>`` but for a constant of the query. Vectors are quantised two
components at a time to one of 16 centroids (4 bits). The quantiser weighs the
part of the residual that is parallel to the vector, which shifts the products
with near queries, ``eta`` times as much as the rest (anisotropic loss), both
when centroids are fitted and when codes are chosen. A scan adds up table
entries for the codes, and the best candidates of a query are measured exactly
on the original vectors.

Codes say little where vectors lie in tight groups, far from the origin or on
very different scales, or where many are equally near. Each row therefore
keeps the length of its residual: a query is no nearer to a row than to the
row's code less that length. Every row that this bound lets through is
measured too, so the result is exact for all rows, ties included, and the codes
decide only how much is measured: at worst all rows, in slices of bounded size.

The quantiser is fitted on a bounded sample (``sample`` vectors, by a hash of
vec_id). Every valid row is indexed. Queries are dealt to blocks of about
``query_block`` by a hash and written; one block at a time is read by the
driver, sent out, and each task's ``k`` nearest written before the next, so
neither the driver nor what is sent grows with the queries. Each block is one
pass over codes and vectors, so the cost is queries times rows. Of equal
vectors the index holds only the ``k`` + 1 smallest ids, once each, which is
all that a result of ``k`` and the query itself can take.

Edge cases: vectors that are null or zero, hold null or non-finite components
or have another size than most are neither queries nor candidates; rows with a
null vec_id neither; rows that repeat a vec_id count once, by the nearest of
them; ties go to the smaller vec_id; fewer than ``k`` candidates give fewer
rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.llm.textcore import mix64
from sheetwright.llm.workspace import Workspace

CODED = "vec_id long, code binary, gap double, vector_key long"
INDEXED = f"{CODED}, error double, vector binary"
NEAR = "query_id long, vec_id long, score double"

#: Rows that a scan looks at together, and pairs that it measures together.
SLICE, PAIRS = 2048, 32_768


@dataclass
class Quantiser:
    """centroids: by pair of components, 16 points each, of vectors times ``scale``, a power of two; so are all its arguments."""

    centroids: np.ndarray
    size: int
    eta: float
    scale: float = 1.0

    def _parts(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), 2 * len(self.centroids)))
        wide[:, : self.size] = x
        return wide.reshape(len(x), len(self.centroids), 2)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of least anisotropic loss, by coordinate descent from the nearest centroids."""
        parts = self._parts(x)
        unit = parts / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]
        gap = parts[:, :, None, :] - self.centroids[None]  # row, pair, centroid, component
        plain = (gap * gap).sum(axis=3)
        along = (gap * unit[:, :, None, :]).sum(axis=3)
        code = plain.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, code[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(len(self.centroids)):
                rest = total - along[rows, m, code[:, m]]
                code[:, m] = (plain[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, code[:, m]]
        return code

    def read(self, code: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.centroids[np.arange(len(self.centroids))[None], code].reshape(len(code), -1)[:, : self.size]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code (two pairs), what the byte adds to the squared distance of the code's vector."""
        gap = self._parts(queries)[:, :, None, :] - self.centroids[None]
        if self.size % 2:
            gap[:, (self.size - 1) // 2, :, 1] = 0
        gap[:, -(-self.size // 2) :] = 0
        add = (gap * gap).sum(axis=3)
        low, high = add[:, 0::2], add[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), low.shape[1], 256).astype(np.float32)


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
    """A quantiser for vectors like ``x``; ``threshold``: cosine from which products matter."""
    n, size = x.shape
    pairs = -(-size // 4) * 2
    scale = 2.0 ** -min(1000.0, max(-1000.0, np.floor(np.log2(np.abs(x).max()))))
    x = x * scale
    random = np.random.default_rng(seed)
    wide = np.zeros((n, 2 * pairs))
    wide[:, :size] = x
    parts = wide.reshape(n, pairs, 2)
    centroids = np.stack([parts[random.choice(n, 16, replace=n < 16), m] for m in range(pairs)])
    centroids += random.normal(0, 1e-6, centroids.shape)
    eta = max(1.0, (size - 1) * threshold**2 / (1 - threshold**2))
    out = Quantiser(centroids, size, 1.0, scale)
    unit = parts / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]
    for turn in range(rounds):
        if turn == rounds // 2:
            out.eta = eta
        code, heavy = out.codes(x, sweeps=1), out.eta - 1
        gap = parts - out.centroids[np.arange(pairs)[None], code]
        along = (gap * unit).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(pairs):
            u, p, c = unit[:, m], parts[:, m], code[:, m]
            rest = total - along[:, m] + (p * u).sum(axis=1)
            left = np.zeros((16, 2, 2))
            for i in range(2):
                for j in range(2):
                    left[:, i, j] = np.bincount(c, weights=(i == j) + heavy * u[:, i] * u[:, j], minlength=16)
            right = np.stack([np.bincount(c, weights=p[:, i] + heavy * u[:, i] * rest, minlength=16) for i in range(2)], axis=1)
            used = np.bincount(c, minlength=16) > 0
            out.centroids[m, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            if (~used).any():
                out.centroids[m, ~used] = p[random.integers(0, n, int((~used).sum()))]
    out.eta = eta
    return out


def _usable(embeddings: DataFrame) -> DataFrame:
    given = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return given.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    given = _usable(embeddings)
    most = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return given.where(F.size("v") == (most["n"] if most else 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def encode(vectors: DataFrame, quantiser: Quantiser, kept: str = "<f8") -> DataFrame:
    """The index's rows. gap: what the squared length loses by the code; error: the residual's length, rounded up; ``kept``: the type that holds components as given."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = _matrix(part.column("v"))
                with np.errstate(all="ignore"):
                    near = x * quantiser.scale
                    code = quantiser.codes(near)
                    back = quantiser.read(code)
                    gap = (near * near).sum(axis=1) - (back * back).sum(axis=1)
                    error = np.sqrt(((near - back) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-150
                small = code.astype(np.uint8)
                small = small[:, 0::2] | small[:, 1::2] << 4
                key = np.zeros(len(x), dtype=np.uint64)
                for j in range(x.shape[1]):
                    key = mix64(key ^ (x[:, j] + 0.0).view(np.uint64))
                binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.record_batch([part.column("vec_id"), binary(small), pa.array(gap), pa.array(key.view(np.int64)), pa.array(error), binary(x.astype(kept))], names=["vec_id", "code", "gap", "vector_key", "error", "vector"])

    return vectors.mapInArrow(run, INDEXED)


def few_copies(coded: DataFrame, most: int) -> DataFrame:
    """Rows of the ``most`` smallest ids of each vector_key, one row for each id.

    Tasks cut their own rows to ``most`` ids a key before the exchange, so a key with many copies stays small.
    """
    place = F.dense_rank().over(Window.partitionBy("vector_key").orderBy("vec_id"))
    return coded.withColumn("place", place).where(F.col("place") <= most).drop("place").dropDuplicates(["vector_key", "vec_id"]).select(*coded.columns)


def rerank_for(rows: int) -> int:
    """Candidates measured for their scores alone: 200 up to 20,000 rows, and then more by the square root of the rows."""
    return int(200 * max(1.0, rows / 20_000) ** 0.5)


def _measured(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of columns ``at`` of x and ``to`` of y, with components added in their order."""
    out = np.empty(len(at))
    for k in range(0, len(at), PAIRS):
        apart = np.take(y, to[k : k + PAIRS], axis=1) - np.take(x, at[k : k + PAIRS], axis=1)
        out[k : k + PAIRS] = np.sqrt(np.add.reduce(apart * apart, axis=0))
    return out


def _nearest(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest ids of each query, each id once, in order of query, score and id."""
    order = np.lexsort((score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.ones(len(query), dtype=bool)
    first[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[first], ids[first], score[first]
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], score[kept]


def scan(index: DataFrame, sent, rerank: int, k: int, scale: float, kept: str) -> DataFrame:
    """Each task's ``k`` nearest rows of every query of a block; ``sent``: the broadcast (ids, vectors, tables) of the block."""

    def run(batches):
        query_ids, asked, tables = sent.value
        y, near_y = np.ascontiguousarray(asked.T), asked * scale
        loose = np.float32(1 + (tables.shape[1] + 8) * 2.0**-22)  # what rounding to 32 bits can add up to
        best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        least = np.full(len(query_ids), np.inf)  # by query, the k-th distance so far

        def take(at, to):
            nonlocal best
            other = own[to] != query_ids[at]
            at, to = at[other], to[other]
            score = _measured(y, x, at, to)
            good = score <= least[at]
            best = _nearest(*[np.concatenate(z) for z in zip(best, (at[good], own[to[good]], score[good]), strict=True)], k)
            full = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
            least[best[0][full]] = best[2][full]

        def open_pairs(done):
            """Pairs that the codes' bound lets through; many of them go through products of the vectors first."""
            reach = np.nextafter((least * scale).astype(np.float32), np.float32(np.inf))[:, None] + np.nextafter(error.astype(np.float32), np.float32(np.inf))[None]
            reach *= reach
            reach *= loose
            reach += np.float32(1e-30)
            left = ~(square > reach)
            if done is not None:
                np.put_along_axis(left, done, False, axis=1)
            if np.count_nonzero(left) <= 4 * len(query_ids):
                return np.nonzero(left)
            rows = np.flatnonzero(left.any(axis=0))
            near_x = x.T[rows] * scale
            centre = near_x.mean(axis=0)
            a, b = near_y - centre, near_x - centre
            a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
            apart = a @ b.T
            apart *= -2
            apart += a2[:, None]
            apart += b2[None]
            apart -= (len(x) + 16) * 2.0**-49 * (a2[:, None] + b2[None])
            at, to = np.nonzero(left[:, rows] & ~(apart > ((least * scale) ** 2 * (1 + 1e-9) + 1e-290)[:, None]))
            return at, rows[to]

        with np.errstate(all="ignore"):
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    own, gap, error = (part.column(c).to_numpy() for c in ("vec_id", "gap", "error"))
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                    x = np.ascontiguousarray(np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=kept).reshape(part.num_rows, -1).T.astype(np.float64))
                    square = np.zeros((len(query_ids), part.num_rows), dtype=np.float32)
                    for m in range(code.shape[1]):
                        square += tables[:, m][:, code[:, m]]
                    done = None
                    if np.isinf(least).any():
                        most = min(rerank, part.num_rows)
                        done = np.argpartition(square + gap.astype(np.float32), most - 1, axis=1)[:, :most]
                        take(np.repeat(np.arange(len(query_ids)), most), done.ravel())
                    take(*open_pairs(done))
        if len(best[0]):
            yield pa.record_batch([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, NEAR)


def search(embeddings: DataFrame, queries: DataFrame, k: int = 10, rerank: int | None = None, sample: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the ``k`` nearest rows of each query.

    ``queries``: rows of ``embeddings``; a query is no candidate of its own.
    """
    spark = embeddings.sparkSession
    space = Workspace(spark, "ann")
    vectors = valid(embeddings)
    n = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    rerank = rerank or rerank_for(n)
    kept = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    part = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    quantiser = fit(_matrix(part.toArrow().column("v").combine_chunks()))
    index = space.save(few_copies(encode(vectors, quantiser, kept), k + 1), "codes")

    asked = _usable(queries).where(F.size("v") == quantiser.size).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // query_block))
    asked = space.save(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks))), "queries")

    found = []
    for b in range(blocks):
        held = asked.where(F.col("block") == b).toArrow()
        if not held.num_rows:
            continue
        block = _matrix(held.column("v").combine_chunks())
        sent = spark.sparkContext.broadcast((held.column("vec_id").to_numpy(), block, quantiser.tables(block * quantiser.scale)))
        found.append(space.save(scan(index, sent, rerank, k, quantiser.scale, kept), "near"))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], schema)

    measured = functools.reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = measured.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
