"""Exact top-k by inner product over a pivot-distance index.

Vectors are quantised to integers and lifted by one coordinate so that all have the same length M: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, and the nearest vectors are those with the highest inner products (the query's own
lift is 0). The index keys each vector by (nearest pivot, distance to it). A histogram of the distances, `BINS` bins a pivot, cuts each
pivot's vectors in parts of about `part_rows` that are ranges of distance: annuli [a, b]. An annulus of
a pivot at distance d from the query holds nothing nearer than max(a - d, d - b) (triangle inequality). Ties count, so
only what is strictly beyond the k-th best is left out.

Two passes. First each query meets the one part whose annulus it is nearest to, and gets a k-th best distance. Then it is sent only to
parts whose annulus comes as near as that; each search there starts with the annuli around the query's own distance and stops at its
bound. Where the annuli do not part the vectors (many dimensions, no clusters), all parts are met: the exact answer then costs every
product, in tiles of a block of queries and a part.

Spark plan. Equal rows are counted, and equal vectors fall to the k + 1 smallest ids (more can't enter any answer, as a query
leaves out one id), by a group limit that works before the shuffle. Pivots come from a bounded sample of `pivot_rows` rows
by farthest-first choice and have no bearing on the answers. The table of parts has at most pivots x BINS rows, whatever the data, so
it is held by every task. A part keeps a query's best k alone; a last group limit merges parts.

Cases. Vectors null, empty or with null or non-finite components take no part, nor do rows with a null id or of
another dimension than most of the sample's rows. Ties go to the smaller id. Repeated rows count as often as they are there (up to k);
a query is one for each different (id, vector) and never answers with its own id; an id with several vectors has an answer for each.
Fewer than k candidates give fewer rows; an empty table none. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm import files
from loomdex.runtime import materialise, on_workers

BINS = 1024
HITS = pa.schema([("query_id", pa.int64()), ("qn", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])


def usable(vector: Column) -> Column:
    """No null, no component that is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first from the sample's middle."""
    best = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = []
    for _ in range(min(n, len(sample))):
        at = int(best.argmax())
        if chosen and best[at] <= 0:
            break
        chosen.append(at)
        best = np.minimum(best if len(chosen) > 1 else np.inf, ((sample - sample[at]) ** 2).sum(axis=1))
    return sample[chosen]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dims)


def distances(v: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of vectors with their lifts to each pivot."""
    square = (v * v).sum(axis=1) + lift * lift
    return np.sqrt(np.maximum(square[:, None] + (pivots * pivots).sum(axis=1) - 2 * (v @ pivots[:, :-1].T + lift[:, None] * pivots[:, -1]), 0))


def nearest(pivots: np.ndarray, limit: float, dims: int):
    """Adds to (vec_id, v, copies): the nearest pivot and the distance to it in the lifted space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), dims).astype(np.float64)
            d = distances(v, np.sqrt(np.maximum(limit - (v * v).sum(axis=1), 0)), pivots)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(v)), at])], names=["vec_id", "v", "copies", "pivot", "dist"])

    return run


class Parts:
    """The table of parts: pivot, number, smallest and largest distance, and in how many pieces it is held."""

    def __init__(self, rows: list, pivots: np.ndarray):
        self.pivot, self.part, self.low, self.high, self.pieces = (np.array([r[i] for r in rows]) for i in range(5))
        self.pivots = pivots

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Least distance of anything in each part from each query."""
        d = distances(q, np.zeros(len(q)), self.pivots)[:, self.pivot]
        return np.maximum(np.maximum(self.low - d, d - self.high), 0)


ROUTE = pa.schema([("query_id", pa.int64()), ("qn", pa.int32()), ("q", pa.list_(pa.int64())), ("kth", pa.int64()), ("pivot", pa.int32()), ("part", pa.int32()), ("piece", pa.int32())])


def route(parts: Parts, dims: int, limit: float, first: bool, at_once: int = 256):
    """Sends queries (query_id, qn, q, kth) to their nearest part, or to all others that their k-th best score doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                some = batch.slice(a, at_once)
                q = matrix(some.column(2), dims).astype(np.float64)
                gap = parts.gaps(q)
                home = gap.argmin(axis=1)
                if first:
                    who, to = np.arange(len(q)), home
                else:
                    kth = np.asarray(some.column(3).fill_null(-(1 << 62))).astype(np.float64)
                    reach = np.where(kth < -(2**61), np.inf, np.sqrt(np.maximum((q * q).sum(axis=1) + limit - 2 * kth, 0)))
                    met = gap <= (reach + 1e-6 * (1 + reach))[:, None]
                    met[np.arange(len(q)), home] = False
                    who, to = np.nonzero(met)
                times = parts.pieces[to]
                who, to = np.repeat(who, times), np.repeat(to, times)
                piece = np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times)
                for b in range(0, len(who), 8192):
                    part = some.take(pa.array(who[b : b + 8192]))
                    cut = to[b : b + 8192]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(parts.pivot[cut], pa.int32()), pa.array(parts.part[cut], pa.int32()), pa.array(piece[b : b + 8192], pa.int32())], schema=ROUTE)

    return run


def search_part(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, dist: np.ndarray, pivot: np.ndarray, limit: float, k: int, ring: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of one part for each query: (place of the query, place of the row, score). `known`: scores that k rows elsewhere reach. `ids`, `v`, `dist` are sorted by distance to the pivot; annuli have `ring` rows."""
    n, m = len(ids), len(q_ids)
    lifted_pivot = np.concatenate([q.astype(np.float64), np.zeros((m, 1))], axis=1) - pivot
    at = np.sqrt((lifted_pivot**2).sum(axis=1))
    square = (q.astype(np.float64) ** 2).sum(axis=1)
    starts = np.arange(0, n, ring)
    inner, outer = dist[starts], dist[np.minimum(starts + ring, n) - 1]
    gap = np.maximum(np.maximum(inner[None, :] - at[:, None], at[:, None] - outer[None, :]), 0)  # least distance to a row of the annulus
    order = np.argsort(gap, axis=1, kind="stable")
    floor = -(1 << 62)
    best_s = np.full((m, k), floor)
    best_i = np.full((m, k), np.iinfo(np.int64).max)
    open_ = np.arange(m)
    known = np.full(m, floor) if known is None else known
    exact = v.astype(np.float64)  # sums of products of small integers are exact below 2**53
    for step in range(len(starts)):
        kth = np.maximum(best_s[open_, -1], known[open_])
        reach = np.where(kth == floor, np.inf, np.sqrt(np.maximum(square[open_] + limit - 2.0 * np.where(kth == floor, 0, kth), 0)))
        ringed = order[open_, step]
        open_ = open_[gap[open_, ringed] <= reach + 1e-6 * (1 + reach)]
        if not len(open_):
            break
        ringed = order[open_, step]
        for r in np.unique(ringed).tolist():
            who = open_[ringed == r]
            rows = np.arange(starts[r], min(starts[r] + ring, n))
            score = np.rint(q[who].astype(np.float64) @ exact[rows].T).astype(np.int64)
            score[q_ids[who][:, None] == ids[rows][None, :]] = floor
            score[score < known[who][:, None]] = floor
            s = np.concatenate([best_s[who], score], axis=1)
            i = np.concatenate([best_i[who], np.broadcast_to(rows, score.shape)], axis=1)
            ident = np.where(s == floor, np.iinfo(np.int64).max, ids[np.minimum(i, n - 1)])
            top = np.lexsort((ident, -s), axis=1)[:, :k]
            best_s[who], best_i[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    some = best_s != floor
    return np.repeat(np.arange(m), some.sum(axis=1)), best_i[some], best_s[some]


def search_block(dims: int, limit: float, pivots: np.ndarray, k: int, ring: int, at_once: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), *(np.zeros(0, np.int64),) * 3)]
        if left.num_rows and right.num_rows:
            q_ids, qn, q = np.asarray(left.column("query_id")), np.asarray(left.column("qn")), matrix(left.column("q"), dims)
            known = np.asarray(left.column("kth").fill_null(-(1 << 62)))
            ids, dist, v, copies = np.asarray(right.column("vec_id")), np.asarray(right.column("dist")), matrix(right.column("v"), dims), np.asarray(right.column("copies"))
            order = np.lexsort((ids, dist))
            ids, dist, v, copies = ids[order], dist[order], v[order], copies[order]
            pivot = pivots[int(right.column("own")[0].as_py())]
            for a in range(0, len(q_ids), at_once):
                who, row, score = search_part(q_ids[a : a + at_once], q[a : a + at_once], ids, v, dist, pivot, limit, k, ring, known[a : a + at_once])
                out.append((q_ids[a + who], qn[a + who], ids[row], score, copies[row]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), HITS)], schema=HITS)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = 16, pivot_rows: int = 1024, part_rows: int = 8192, query_rows: int = 4096, ring: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score; see the module. `is_query` is a condition on the id column, renamed vec_id."""
    spark = on_workers(vectors.sparkSession)
    rows = vectors.select(F.col(files.quoted(id_col)).cast("long").alias("vec_id"), F.col(files.quoted(vec_col)).alias("e")).filter(F.col("vec_id").isNotNull() & usable(F.col("e")))
    rows = rows.select("vec_id", quantised(F.col("e"), scale).alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_rows).select("v").collect()
    empty = "query_id long, rank int, vec_id long, score long"
    if not sample:
        return spark.createDataFrame([], empty)
    sizes = [len(r[0]) for r in sample]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d))
    rows = rows.filter(F.size("v") == dims)
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    limit = float(rows.agg(F.max(norm)).first()[0])
    got = np.array([r[0] for r in sample if len(r[0]) == dims], np.float64)
    got = np.concatenate([got, np.sqrt(np.maximum(limit - (got * got).sum(axis=1), 0))[:, None]], axis=1)
    pivots = choose_pivots(got, n_pivots)

    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    equal = Window.partitionBy("v").orderBy("vec_id")
    few = counted.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1).select("vec_id", "v", "copies")
    index = materialise(few.mapInArrow(nearest(pivots, limit, dims), "vec_id long, v array<long>, copies long, pivot int, dist double"), "vector-index")

    # Bins of equal width go together to parts; one bin beyond a part's size is held in pieces.
    width = max(2.0 * limit**0.5 / BINS, 1e-9)
    bin_ = F.least(F.floor(F.col("dist") / width), F.lit(BINS - 1)).cast("int")
    upto = Window.partitionBy("pivot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = index.groupBy("pivot", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    bins = bins.withColumn("part", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / part_rows).cast("int"))
    own = Window.partitionBy("pivot", "part")
    bins = materialise(bins.select("pivot", "bin", "part", F.min("low").over(own).alias("low"), F.max("high").over(own).alias("high"), F.ceil(F.sum("n").over(own) / (2 * part_rows)).cast("int").alias("pieces")), "vector-parts")
    parts = Parts(bins.select("pivot", "part", "low", "high", "pieces").distinct().orderBy("pivot", "part").collect(), pivots)  # at most pivots x BINS rows
    held = index.withColumn("bin", bin_).join(F.broadcast(bins.select("pivot", "bin", "part", "pieces")), ["pivot", "bin"])
    held = held.select("vec_id", "v", "copies", "dist", "pivot", "part", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int").alias("piece"))

    asked = rows.filter(is_query).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.withColumn("qn", F.row_number().over(Window.partitionBy("query_id").orderBy("q")))
    asked = materialise(asked.select("query_id", "qn", "q"), "vector-queries")
    n_blocks = max(1, -(-asked.count() // query_rows))
    kinds = "query_id long, qn int, q array<long>, kth long, pivot int, part int, piece int"
    place = ["pivot", "part", "piece"]

    def met(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.select("query_id", "qn", "q", "kth").mapInArrow(route(parts, dims, limit, first), kinds).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
        keys = [*place, "block"]
        there = sent.select(*(F.col(c).alias(f"to_{c}") for c in keys)).distinct()
        met_rows = held.join(there, [held[c] == there[f"to_{c}"] for c in place]).select("vec_id", "v", "copies", "dist", F.col("pivot").alias("own"), *(f"to_{c}" for c in keys))
        return sent.groupBy(*keys).cogroup(met_rows.groupBy(*(f"to_{c}" for c in keys))).applyInArrow(search_block(dims, limit, pivots, k, ring, 1024), "query_id long, qn int, vec_id long, score long, copies long")

    best = Window.partitionBy("query_id", "qn").orderBy(F.desc("score"), "vec_id")
    near = materialise(met(asked.withColumn("kth", F.lit(None).cast("long")), True), "vector-near")
    # A row that is there more than once counts so often.
    every = lambda hits: hits.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    kth = every(near).withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", "qn", F.col("score").alias("kth"))
    far = met(asked.join(kth, ["query_id", "qn"], "left"), False)
    return every(near.unionByName(far)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op10_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
