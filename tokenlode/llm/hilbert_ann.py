"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected to a few dimensions, shifted and ordered along a
Hilbert curve, again and again with other projections and shifts. Spark
range-partitions and sorts each order; it is cut into blocks, and each block
gets the ends of its two neighbours as well. Within such a window queries
are compared with every row. Over all curves a query's best are merged and
reranked by exact similarity.

Queries are the rows whose id is divisible by `every`, against all rows: within
a window the queries of its block are compared with every row of it, whatever
their number. A curve finds a true neighbour if it lies in the same
window; more curves or wider windows find more. How many are needed depends on
the data: among vectors without structure in many dimensions recall follows
the share of the table that the windows span. So windows grow with the table,
and with them the comparisons, by the square of the rows over `every`; the README has the
recall. A worker takes a window of 1 / 32 of a large table in portions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, named, scratch

#: Neighbours, curves, dimensions of a projection, bits of each, rows of a block and of what it gets from either side.
K, CURVES, DIMS, BITS, BLOCK, HALO = 10, 24, 8, 7, 1024, 512
#: Curves whose orders are on disk at once.
AT_ONCE = 6
#: Least share of the rows that a block has: windows of fixed size lose neighbours as the table grows.
SHARE = 1 / 64
#: Similarities that a window's comparison holds at once.
CELLS = 1 << 21
SEED, DIGITS = 5, 5
#: Queries are the rows with an id divisible by this.
EVERY = 100


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), after Skilling's transposition."""
    x, n = x.astype(np.uint64).T.copy(), x.shape[1]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << one | (x[i] >> np.uint64(b)) & one
    return out.astype(np.int64)


def projection(curve: int, dim: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions and shift of a curve."""
    g = np.random.default_rng([seed, curve])
    a = np.linalg.qr(g.standard_normal((dim, max(dim, dims))))[0] if dim >= dims else g.standard_normal((dim, dims))
    return a[:, :dims].astype(np.float64), g.uniform(-0.15, 0.15, dims)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of rows with an id and a vector of the most frequent length, of finite numbers that aren't all 0."""
    d = vectors.select(named(vectors, id_col).cast("bigint").alias("id"), named(vectors, vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    good = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    d = d.where(good)
    top = d.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = top["n"] if top else 0
    return d.where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec")), dim


def neighbours(vectors: DataFrame, k: int = K, curves: int = CURVES, block: int = BLOCK, halo: int = HALO, dims: int = DIMS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour, similarity): the k most similar others of each row whose id is divisible by every, by cosine.

    A block has `block` rows or `share` of all, if that is more; the halo grows
    along. Similarities are rounded to DIGITS; ties go to the lesser id of those
    that share a window with the row. Rows with a
    null id or vector, with nulls, infinities or NaN in it, of another length
    than most, or of zeros only, are left out. Of rows that share an id the one
    with the least vector counts.
    With k or fewer other rows each gets them all; an empty table, or a single
    row, gives none. Other columns don't matter.
    """
    spark = vectors.sparkSession
    d, dim = usable(vectors, id_col, vec_col)
    schema = "vec_id long, rank int, neighbour long, similarity double"
    if not dim:
        return spark.createDataFrame([], schema)
    at = [projection(c, dim, dims, seed) for c in range(curves)]

    def unit(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(1), dim)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, s2 = 0, np.zeros((curves, dims)), np.zeros((curves, dims))
        for b in batches:
            x = unit(b)
            n += len(x)
            for c, (a, _) in enumerate(at):
                y = x @ a
                s[c] += y.sum(0)
                s2[c] += (y * y).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.ravel().tolist()]), pa.array([s2.ravel().tolist()])], ["n", "s", "s2"])

    got = d.mapInArrow(measure, "n long, s array<double>, s2 array<double>")
    i = F.posexplode(F.arrays_zip("s", "s2")).alias("i", "v")
    sums = got.select("n", i).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v.s").alias("s"), F.sum("v.s2").alias("s2")).orderBy("i").collect()
    n = np.array([r["n"] for r in sums]).reshape(curves, dims)
    mean = np.array([r["s"] for r in sums]).reshape(curves, dims) / n
    dev = np.sqrt((np.array([r["s2"] for r in sums]).reshape(curves, dims) / n - mean**2).clip(1e-18))
    total = int(n[0, 0])
    if (wide := math.ceil(total * share)) > block:
        block, halo = wide, math.ceil(halo * wide / block)

    parts = []
    for first in range(0, curves, AT_ONCE):
        some = range(first, min(curves, first + AT_ONCE))

        def order(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = unit(b)
                raw = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                for c in some:
                    a, shift = at[c]
                    y = ((x @ a - mean[c]) / dev[c] / 6 + 0.5 + shift).clip(0, 1 - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert((y * (1 << BITS)).astype(np.int64), BITS)), b.column(0), raw], ["curve", "key", "id", "vec"])

        size = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * len(some) // 200_000 + 1)
        path = scratch(spark, "curve")
        sent = d.mapInArrow(order, "curve int, key long, id long, vec binary").repartitionByRange(size, "curve", "key", "id").sortWithinPartitions("curve", "key", "id", "vec")
        sent.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("key").write.parquet(path)
        rows = spark.read.parquet(path)
        sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
        before, ends = 0, {}
        for p in sorted(sizes):
            ends[p], before = before, before + sizes[p]
        offsets = spark.createDataFrame(list(ends.items()), "part int, before long")
        place = F.col("before") + F.col("at") - (F.col("curve") - first) * total  # each curve has all rows
        blocks = F.array(
            F.when(place % block < halo, F.floor(place / block) - 1), F.floor(place / block), F.when(place % block >= block - halo, F.floor(place / block) + 1)
        )
        windows = rows.join(offsets, "part").select("curve", "id", "vec", place.alias("place"), F.explode(F.array_compact(blocks)).alias("block"))

        def compare(key: tuple, t: pa.Table) -> pa.Table:
            ids, place_ = t["id"].to_numpy(), t["place"].to_numpy()
            by = np.lexsort((place_,))
            ids, place_ = ids[by], place_[by]
            x = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(-1, dim)[by]
            own = np.flatnonzero((place_ // block == key[1].as_py()) & (ids % every == 0))
            out_q, out_n, out_s = [], [], []
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            step = max(1, CELLS // len(ids))
            for mine in (own[j : j + step] for j in range(0, len(own) if len(ids) > 1 else 0, step)):
                s = x[mine] @ x.T
                s[np.arange(len(mine)), mine] = -9
                m = len(ids) - min(k, len(ids) - 1)
                # all that may tie with the k-th: by rounding to DIGITS, and by that of two 32-bit products
                r, c = np.nonzero(s >= np.partition(s, m, axis=1)[:, m, None] - (10.0**-DIGITS + (dim + 4) * 2.0**-23))
                exact = np.zeros(len(r))
                for e in range(dim):  # in the same order in every window
                    exact += (x[mine[r], e] / norm[mine[r]]) * (x[c, e] / norm[c])
                exact = np.round(exact, DIGITS)
                by = np.lexsort((ids[c], -exact, r))
                near, exact = ids[c[by]], exact[by]
                ends = np.searchsorted(r, np.arange(len(mine) + 1))
                for q, lo, hi in zip(mine, ends, ends[1:]):
                    some = slice(lo, min(hi, lo + k))
                    out_q.append(ids[q])
                    out_n.append(near[some])
                    out_s.append(exact[some])
            return pa.table([pa.array(out_q, pa.int64()), pa.array(out_n, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64()))], names=["q", "n", "s"])

        best = scratch(spark, "neighbours")
        windows.groupBy("curve", "block").applyInArrow(compare, "q long, n array<long>, s array<double>").write.parquet(best)
        delete(spark, path)
        parts.append(best)
    found = spark.read.parquet(*parts).withColumn("d", F.transform("s", lambda v: -v))
    merged = found.groupBy("q").agg(F.flatten(F.collect_list(F.arrays_zip("d", "n"))).alias("all"))
    best = F.slice(F.sort_array(F.array_distinct("all")), 1, k)
    return merged.select(F.col("q").alias("vec_id"), F.posexplode(best).alias("rank", "v")).select(
        "vec_id", (F.col("rank") + 1).alias("rank"), F.col("v")["n"].alias("neighbour"), (-F.col("v")["d"]).alias("similarity")
    )


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)


#: Exact, as the curves are where a window holds the whole table, as at the size where the two are compared.
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), p AS (
  SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), {DIGITS}) AS similarity
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
)
SELECT vec_id, rank::INT AS rank, neighbour, similarity
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM p) WHERE rank <= {K}
"""
