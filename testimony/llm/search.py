"""Exact search for the highest inner products by an index of distances to pivots.

Every vector is keyed by its nearest pivot and its distance from it. The index is sorted by this key and cut into shards, and a shard into
annuli: runs of vectors of one pivot in a narrow range of distances. By the triangle inequality, a query at distance d from the pivot is at
least |d - r| from a vector at distance r, and the inner product is (|q|^2 + |x|^2 - |q - x|^2) / 2, so each annulus has a bound on any score in it.
A query goes to its most promising shard first, then to 4, 16, ... more in the order of their bounds, and is done when the next bound is below its worst
kept score; within a shard it expands annuli in the same way. Nothing is approximate: pivots and sizes decide the cost, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.llm.common import settle

#: Most pivots; they are fitted on so many vectors, drawn by hash, and on so many numbers in all.
PIVOTS, SAMPLE_ROWS, SAMPLE_NUMBERS = 128, 8_192, 8_000_000
ROUNDS = 8
#: Vectors of a shard, and most shards: with more vectors than both allow, shards are larger.
SHARD_ROWS, MOST_SHARDS = 2_048, 65_536
ANNULUS_ROWS = 128
#: Queries compared at once.
_QUERIES = 1_024
_LONG = np.iinfo(np.int64)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def fit_pivots(sample: np.ndarray, most: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of the sample's clusters (k-means from evenly spaced members); the zero vector comes first."""
    few = min(most - 1, len(sample) // 16)
    zero = np.zeros((1, sample.shape[1]))
    if few < 1:
        return zero
    centre = sample[np.linspace(0, len(sample) - 1, few).astype(int)]
    for _ in range(rounds):
        own = distances(sample, centre).argmin(axis=1)
        n = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        # A mean beyond double precision is nobody's nearest.
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return np.concatenate([zero, centre])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each vector to each pivot; infinite where a square is beyond double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.square(x).sum(axis=1)[:, None] - 2 * x @ pivots.T + np.square(pivots).sum(axis=1)
    return np.sqrt(np.maximum(np.where(np.isnan(square), np.inf, square), 0))


def lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.square(x).sum(axis=1))


def upper_bounds(d: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """The most that a query's inner product with a vector can be: queries at distance d (a column for each range) from the pivots, with norms ``norm``; vectors
    at a distance from low to high and no longer than ``longest``. Rounding is allowed for; where doubles do not suffice, there is no bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        scale = d + high + longest + norm[:, None]
        gap = np.maximum(np.maximum(low - d, d - high) - 1e-7 * scale, 0)
        by_distance = (np.square(norm)[:, None] + np.square(longest) - np.square(gap)) / 2
        bound = np.minimum(by_distance, norm[:, None] * longest) + 1e-7 * np.square(scale) + 1
    return np.where(np.isnan(bound), np.inf, bound)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond 64 bits, the nearest 64-bit number."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(whole, _LONG.min, _LONG.max).astype(np.int64)


class Found:
    """The ``top`` highest scores of each of some queries, ties to the smaller id; ``least`` is what a further vector has to reach."""

    def __init__(self, queries: np.ndarray, least: np.ndarray, top: int):
        self.queries, self.least, self.top = queries, least.copy(), top
        self.score = np.full((len(queries), top), _LONG.min)
        self.ids = np.full((len(queries), top), _LONG.max)
        self.full = np.zeros((len(queries), top), bool)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``at`` (rows) with the vectors ``ids`` (columns)."""
        fit = (score >= self.least[at, None]) & (ids[None, :] != self.queries[at, None])
        some = np.flatnonzero(fit.any(axis=1))
        for i in some.tolist():
            k, j = at[i], np.flatnonzero(fit[i])
            s, v = np.append(self.score[k][self.full[k]], score[i, j]), np.append(self.ids[k][self.full[k]], ids[j])
            order = np.lexsort((v, ~s))[: self.top]
            n = len(order)
            self.score[k, :n], self.ids[k, :n], self.full[k, :n] = s[order], v[order], True
            if n == self.top:
                self.least[k] = max(self.least[k], self.score[k, -1])


class Shard:
    """Vectors of one pivot, sorted by their distance from it, with their annuli."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray, pivot: np.ndarray):
        self.ids, self.x, self.pivot = ids, x, pivot
        self.cuts = np.append(np.arange(0, len(ids), ANNULUS_ROWS), len(ids))
        starts = self.cuts[:-1]
        self.low, self.high = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)
        self.longest = np.maximum.reduceat(lengths(x), starts)

    def search(self, queries: np.ndarray, q: np.ndarray, least: np.ndarray, top: int) -> Found:
        """Each query expands annuli by falling bound until the next is below its least score."""
        found = Found(queries, least, top)
        norm = lengths(q)
        bound = upper_bounds(np.repeat(distances(q, self.pivot[None, :]), len(self.low), axis=1), norm, self.low, self.high, self.longest)
        order = np.argsort(-bound, axis=1, kind="stable")
        going = np.arange(len(q))
        for step in range(bound.shape[1]):
            going = going[bound[going, order[going, step]] >= found.least[going]]
            if not len(going):
                break
            next_ = order[going, step]
            for a in np.unique(next_).tolist():
                at, span = going[next_ == a], slice(self.cuts[a], self.cuts[a + 1])
                found.add(at, products(q[at], self.x[span]), self.ids[span])
        return found


def _keyed(shared):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for i in range(0, len(batch), _QUERIES):
                part = batch.slice(i, _QUERIES)
                x = _matrix(part.column("vector"), pivots.shape[1])
                d = distances(x, pivots)
                own = d.argmin(axis=1)
                added = [pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own]), pa.array(lengths(x))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), *added], names=["vec_id", "vector", "pivot", "far", "norm"])

    return keyed


def _numbered(rows: int):
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of rows that are sorted by pivot and distance."""
        from pyspark import TaskContext

        shard, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            for i, pivot in enumerate(batch.column("pivot").to_pylist()):
                if last is not None and (pivot != last or held == rows):
                    shard, held = shard + 1, 0
                last, held, out[i] = pivot, held + 1, shard
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "shard"])

    return numbered


def _next(shared, shards, visited: int, more: int):
    def next_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards that come next for each query, by falling bound, as far as they may hold a better vector."""
        pivots, (number, pivot, low, high, longest) = shared.value, shards.value
        for batch in batches:
            # A row of bounds for each query, about 32 MB at once.
            for i in range(0, len(batch), step := max(1, min(_QUERIES, (1 << 22) // max(1, len(number))))):
                part = batch.slice(i, step)
                q = _matrix(part.column("vector"), pivots.shape[1])
                least = part.column("least").to_numpy(zero_copy_only=False)
                bound = upper_bounds(distances(q, pivots)[:, pivot], lengths(q), low, high, longest)
                order = np.argsort(-bound, axis=1, kind="stable")[:, visited : visited + more]
                row, col = np.nonzero(np.take_along_axis(bound, order, 1) >= least[:, None])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[order[row, col]]), pa.array(np.ones(len(row), np.int32)), part.column("vec_id").take(take), part.column("vector").take(take), part.column("least").take(take)],
                    names=["shard", "side", "vec_id", "vector", "least"],
                )

    return next_


def _scored(shared, top: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's vectors come first (side 0), then its queries, however many."""
        pivots, held, shard, at = shared.value, [], None, None
        for batch in batches:
            number, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "side"))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part = batch.slice(a, b - a) if len(batch) else batch
                if not len(part):
                    continue
                if number[a] != at:
                    held, shard, at = [], None, number[a]
                if side[a] == 0:
                    held.append(part)
                    continue
                if shard is None:
                    if not held:
                        continue
                    own = pa.Table.from_batches(held).combine_chunks()
                    x = _matrix(own.column("vector").combine_chunks(), pivots.shape[1])
                    far = own.column("far").to_numpy()
                    by = np.argsort(far, kind="stable")
                    shard, held = Shard(own.column("vec_id").to_numpy()[by], x[by], far[by], pivots[own.column("pivot")[0].as_py()]), []
                for i in range(0, len(part), _QUERIES):
                    some = part.slice(i, _QUERIES)
                    ids, least = (some.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "least"))
                    found = shard.search(ids, _matrix(some.column("vector"), pivots.shape[1]), least, top)
                    row, col = np.nonzero(found.full)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found.ids[row, col]), pa.array(found.score[row, col])], names=["query_id", "vec_id", "score"])

    return scored


def top_products(
    vectors: DataFrame, *, top: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The ``top`` highest inner products of each query with all other vectors: query_id, rank (from 1), vec_id, score.

    Each component x counts as floor(scale * x), x in double precision; queries are the rows whose id is divisible by ``every``. Equal scores go to the smaller id.
    Fewer than ``top`` other vectors: all of them.

    Vectors that are null or hold null or non-finite components (also after scaling), and rows with a null id, take no part. An empty vector has inner product 0 with
    other empty ones. Vectors of different lengths do not meet. An id that has several rows counts as one vector, the least in component order. Scores beyond 64 bits
    are the nearest 64-bit number. An empty table gives an empty result. Other columns are ignored.

    Pivots are fitted on at most SAMPLE_ROWS vectors of each length; all vectors are indexed. Vectors of each length are searched by themselves.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col), lambda x: _floor(x.cast("double") * scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = settle(rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(odd, F.lit(True))).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    # One row for each length of vectors.
    sizes = sorted((r.d, r.n) for r in rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect())
    out = None
    for dims, n in sizes:
        part = _search(rows.where(F.size("vector") == dims), dims, n, top, every, pivots, shard_rows)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _floor(x):
    """floor() of doubles that stays a double, whatever its size."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _search(rows: DataFrame, dims: int, n: int, top: int, every: int, pivots: int, shard_rows: int) -> DataFrame:
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, dims)))).collect()
    centre = share(fit_pivots(np.array([r.vector for r in sample], np.float64).reshape(len(sample), dims), pivots))
    keyed = rows.mapInArrow(_keyed(centre), "vec_id long, vector array<double>, pivot int, far double, norm double")
    size = max(shard_rows, -(-n // MOST_SHARDS))
    index = settle(settle(keyed).repartitionByRange("pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id").mapInArrow(
        _numbered(size), "vec_id long, vector array<double>, pivot int, far double, norm double, shard long"))
    # At most MOST_SHARDS rows, and one more for each pivot and each partition.
    held = index.groupBy("shard").agg(F.first("pivot"), F.min("far"), F.max("far"), F.max("norm")).orderBy("shard").collect()
    shards = share(tuple(np.array([r[k] for r in held], kind) for k, kind in enumerate((np.int64, np.int64, float, float, float))))
    queries = settle(index.where(F.col("vec_id") % every == 0).select("vec_id", "vector", F.lit(_LONG.min).alias("least")))
    side = index.select("shard", F.lit(0).alias("side"), "vec_id", "vector", F.lit(0).cast("long").alias("least"), "pivot", "far")
    best, visited, more = None, 0, 1
    while visited < len(held):
        asked = settle(queries.mapInArrow(_next(centre, shards, visited, more), "shard long, side int, vec_id long, vector array<double>, least long"))
        wanted = asked.select("shard").distinct()
        if visited and asked.isEmpty():
            break
        both = side.join(F.broadcast(wanted), "shard").unionByName(asked, allowMissingColumns=True)
        met = both.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(_scored(centre, top), "query_id long, vec_id long, score long")
        best = settle(_top(met if best is None else met.unionByName(best.drop("rank")), top))
        worst = best.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("now"))
        queries = settle(queries.join(worst, "vec_id", "left").select("vec_id", "vector", F.greatest("least", "now").alias("least")))
        visited, more = visited + more, more * 4
    return best


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
