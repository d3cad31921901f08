"""Nearest neighbours by inner product on shifted space-filling curves.

Vectors are turned by a fixed rotation; each curve takes its own few coordinates, shifts them and orders all
rows by Hilbert key. Spark range-partitions each ordering and numbers the rows. A query looks at the rows whose
places are within a window of its own on any curve, and reranks them by the exact inner product. The window is
measured, not guessed: for a bounded sample of queries the true neighbours are found by brute force, and the
window is the least that reaches the recall asked for. (In data without any neighbourhoods that window is wide.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inciflow.llm.common import number_rows, stored

#: Orderings, coordinates of each, bits of a coordinate.
CURVES, AXES, BITS = 4, 8, 6
#: Rows of a block of an ordering, and queries that meet it at once.
BLOCK, QUERY_CHUNK = 4096, 4096
#: Queries that the window is measured on, and places on either side that it has at least (more than copies of a vector).
SAMPLE_QUERIES, LEAST_WIDTH = 200, 256
ROW = "uid long, vec_id long, v array<float>"


def hilbert_keys(coords: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows, axes) in [0, 2^bits): int64 keys.

    Works on the transposed form: bit planes from the top, undoing reflections and exchanges of axes, then Gray code.
    """
    x = coords.astype(np.int64).T.copy()
    axes = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(axes):
            set_ = (x[i] & plane) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        plane >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where((x[-1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


class Curves:
    """The fixed rotation and shifts. Inner products become distances with one more coordinate:
    a row x is put at (x, sqrt(M^2 - |x|^2)) and a query q at (q M / |q|, 0), M the largest norm."""

    def __init__(self, dim: int, largest: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim, self.largest = dim, largest
        self.axes = min(AXES, dim + 1)
        turns = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0] for _ in range(-(-CURVES * self.axes // (dim + 1)))]
        self.turn = np.concatenate(turns, axis=1)[:, : CURVES * self.axes]
        self.shift = rng.uniform(0, 1, CURVES * self.axes)
        self.mean, self.width = np.zeros(CURVES * self.axes), np.ones(CURVES * self.axes)

    def project(self, v: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        if query:
            placed = np.hstack([v * (self.largest / norm), np.zeros_like(norm)])
        else:
            placed = np.hstack([v, np.sqrt(np.maximum(self.largest**2 - norm**2, 0))])
        return placed @ self.turn

    def keys(self, v: np.ndarray, query: bool) -> list[np.ndarray]:
        cells = (1 << BITS) - 1
        # three deviations on either side; the shift moves the grid of each curve by up to one cell
        at = ((self.project(v, query) - self.mean) / np.maximum(self.width, 1e-12) + 3) / 6 * (cells - 1) + self.shift
        at = np.clip(np.floor(at), 0, cells).astype(np.int64)
        return [hilbert_keys(at[:, c * self.axes : (c + 1) * self.axes], BITS) for c in range(CURVES)]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(uid, vec_id, v) of vectors that are not null or zero and have no null or non-finite component, and their length.

    Vectors of another length than most, and rows without vec_id, take no part either.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(~bad & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    rows = stored(rows, "ann-vectors")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return (rows.filter(F.size("v") == size["d"]), size["d"]) if size else (rows, 0)


def best_of(scores: np.ndarray, exact, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the k best of one query, ties to smaller ids. Masked scores are -inf."""
    n = min(k, int(np.isfinite(scores).sum()))
    if not n:
        return np.array([], dtype=int), np.array([])
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    some = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    value = exact(some)
    order = np.lexsort((ids[some], -value))[:n]
    return some[order], value[order]


def nearest_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, outside=None, least=None):
    """(query position, row position, score) of the k best rows per query, never one with the query's id.

    Rows that are `outside`, or clearly below the score that a query asks for at `least`, are left out.
    """
    out = []
    for at in range(0, len(queries), 256):
        s = queries[at : at + 256] @ rows.T
        if outside is not None:
            s[outside(slice(at, at + 256))] = -np.inf
        if least is not None:
            s[s < least[at : at + 256, None] - 1e-9 * np.maximum(1.0, np.abs(least[at : at + 256, None]))] = -np.inf
        s[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        for i in range(len(s)):
            pos, value = best_of(s[i], lambda some, q=queries[at + i]: (rows[some] * q).sum(axis=1), ids, k)
            out.append((np.full(len(pos), at + i), pos, value))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.array([], dtype=int), np.array([], dtype=int), np.array([])]


FOUND = "query_id long, query_uid long, vec_id long, uid long, score double"


def found_batch(hit, query_ids, query_uids, ids, uids):
    q, r, value = hit
    return pa.table({"query_id": pa.array(query_ids[q], pa.int64()), "query_uid": pa.array(query_uids[q], pa.int64()), "vec_id": pa.array(ids[r], pa.int64()), "uid": pa.array(uids[r], pa.int64()), "score": pa.array(value, pa.float64())})


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def brute_force(queries: list, rows: DataFrame, dim: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of query rows, in one pass over all rows."""
    q = np.array([r["v"] for r in queries], dtype=np.float64).reshape(-1, dim)
    ids, uids = (np.array([r[c] for r in queries], dtype=np.int64) for c in ("vec_id", "uid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = nearest_of(q, ids, matrix(b.column("v"), dim), b.column("vec_id").to_numpy(), k)
            yield from found_batch(hit, ids, uids, b.column("vec_id").to_numpy(), b.column("uid").to_numpy()).to_batches()

    return top(rows.mapInArrow(run, FOUND), k)


def orderings(rows: DataFrame, curves: Curves) -> DataFrame:
    """A row per curve of each row: curve, key, query (as which it is placed) and the row itself."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = curves.project(matrix(b.column("v"), curves.dim), False)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.shape[1]), pa.int32()), pa.array(np.full(p.shape[1], float(len(p)))), pa.array(p.sum(axis=0)), pa.array((p * p).sum(axis=0))], ["i", "n", "s", "ss"])

    sums = rows.filter("NOT query").select("v").mapInArrow(moments, "i int, n double, s double, ss double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("i").collect()
    n, s, ss = (np.array([r[c] for r in sums]) for c in ("n", "s", "ss"))
    curves.mean, curves.width = s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, query = matrix(b.column("v"), curves.dim), b.column("query").to_numpy(zero_copy_only=False)
            for c, (as_row, as_query) in enumerate(zip(curves.keys(v, False), curves.keys(v, True), strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c), pa.int32()), pa.array(np.where(query, as_query, as_row)), *b.columns], ["curve", "key", *b.schema.names])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("query", "uid", "vec_id", "v").mapInArrow(run, f"curve int, key long, query boolean, {ROW}")
    ranged = keyed.repartitionByRange(parts, "curve", "key", "vec_id").withColumn("cell", F.spark_partition_id())
    return stored(ranged, "ann-ranges")


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found of each row whose vec_id is divisible by `every`.

    Of equal vectors only k rows of an id, and of these the first 2 k by id, can ever be among the nearest (a query
    passes over the at most k rows of its own id), so further copies are not indexed, which loses nothing. Repeated rows of a vec_id are rows of their own, but no row with the id of a
    query is its neighbour. Without usable vectors there are no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors.select("vec_id", "embedding"))
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    repeat = F.row_number().over(Window.partitionBy("same", "vec_id").orderBy("uid"))
    copy = F.row_number().over(Window.partitionBy("same").orderBy("vec_id", "uid"))
    base = rows.withColumn("same", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))))
    base = base.withColumn("repeat", repeat).filter(F.col("repeat") <= k).withColumn("copy", copy).filter(F.col("copy") <= 2 * k).select("uid", "vec_id", "v", F.lit(False).alias("query"))
    queries = rows.filter(F.col("vec_id") % every == 0).select("uid", "vec_id", "v", F.lit(True).alias("query"))
    both = stored(base.unionByName(queries), "ann-rows")
    largest = both.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    placed = number_rows(orderings(both, Curves(dim, largest)), ["cell"], [F.col("key"), F.col("vec_id"), F.col("uid"), F.col("query")], "pos", ["curve"], F.when(F.col("query"), 0).otherwise(1).cast("long"))
    placed = stored(placed.drop("cell", "key"), "ann-places")
    width = window_width(both, placed, dim, k, recall)
    chunks = max(1, -(-(2 * width + BLOCK) // QUERY_CHUNK // every))
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int")
    blocks = F.sequence(F.floor(F.greatest(F.lit(0), F.col("pos") - width) / BLOCK), F.floor((F.col("pos") + width) / BLOCK))
    own = F.floor(F.col("pos") / BLOCK).cast("long")
    asked = placed.filter("query").select("curve", F.explode(blocks).alias("block"), own.alias("own"), chunk.alias("chunk"), "uid", "vec_id", "v", "pos")
    held = placed.filter("NOT query").select("curve", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "uid", "vec_id", "v", "pos")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = [t.column(c).to_numpy() for t in (left, right) for c in ("vec_id", "uid", "pos")]
        if not left.num_rows or not right.num_rows:
            empty = np.array([], dtype=int)
            return found_batch((empty, empty, np.array([])), ids[0], ids[1], ids[3], ids[4])
        far = lambda part: np.abs(ids[2][part, None] - ids[5][None, :]) > width
        hit = nearest_of(matrix(left.column("v"), dim), ids[0], matrix(right.column("v"), dim), ids[3], k, far, left.column("least").to_numpy())
        return found_batch(hit, ids[0], ids[1], ids[3], ids[4])

    def met(queries: DataFrame) -> DataFrame:
        keys = ["curve", "block", "chunk"]
        fresh = queries.toDF(*queries.columns)  # columns of its own: both sides come from one table
        return fresh.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, FOUND)

    def once(found: DataFrame) -> DataFrame:
        return found.groupBy("query_uid", "uid").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))

    # the blocks of the query's own places first: other blocks give only rows that are not below the k-th best of these
    asked = asked.withColumn("block", F.col("block").cast("long"))
    near = stored(met(asked.filter("block = own").withColumn("least", F.lit(float("-inf"))).drop("own")), "ann-near")
    worst = top(once(near), k).filter(F.col("rank") == k).select(F.col("query_uid").alias("uid"), F.col("score").alias("least"))
    others = asked.filter("block <> own").join(worst, "uid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = near.unionByName(met(others.select("curve", "block", "chunk", "uid", "vec_id", "v", "pos", "least")))
    return top(once(found), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def window_width(both: DataFrame, placed: DataFrame, dim: int, k: int, recall: float) -> int:
    """The least window that finds `recall` of the true neighbours of the sampled queries on any curve."""
    sample = both.filter("query").orderBy(F.xxhash64("vec_id"), "uid").limit(SAMPLE_QUERIES).collect()
    if not sample:
        return LEAST_WIDTH
    true = brute_force(sample, both.filter("NOT query"), dim, k).select("query_uid", "uid")
    places = placed.select("curve", "query", "uid", "pos")
    q = places.filter("query").select("curve", F.col("uid").alias("query_uid"), F.col("pos").alias("query_pos"))
    r = places.filter("NOT query").drop("query")
    true = stored(true, "ann-true")  # at most k rows for each sampled query: it can be broadcast
    met = q.join(F.broadcast(true), "query_uid")
    met = r.join(F.broadcast(met), ["curve", "uid"])
    apart = met.groupBy("query_uid", "uid").agg(F.min(F.abs(F.col("pos") - F.col("query_pos"))).alias("d")).select("d").collect()
    apart = sorted(r["d"] for r in apart)
    return max(LEAST_WIDTH, int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) if apart else 0)
