"""A uniform shuffle into shards of exact sizes.

Input is cut into parts: runs of rows of one file. How many rows each part
sends to each shard is a row of a random matrix with the parts' sizes and the
shards' sizes as margins, which has the multivariate hypergeometric law of a
uniform shuffle. It is never held whole: halving the list of parts again and
again, the left half's share of each shard's places is drawn from a generator
seeded by the half, so a task draws only the rows of its own parts, each in
log(parts) steps. A part permutes its rows and deals them out along its row
of the matrix; after the exchange each shard is put in the order of random
keys: rows are range-partitioned by shard and key, so a shard can be larger than a task, and the
sizes of the ranges before it give a row's place.

A row's part and place come from its file and its index there, not from how
Spark splits files, so a task that is run again sends every row where the
first run did.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import cleaned
from .common import fresh, named, scratch

#: Rows of a part, and the largest population that numpy's sampler takes.
PART, NUMPY_MOST = 65_536, 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; exact for any size.

    Beyond what numpy takes, by rejection from the ratio of uniforms.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    return _ratio_of_uniforms(rng, good, bad, n)


def _ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Sampling by table-mountain rejection after Stadlober, with log-gamma."""
    total = good + bad
    small, large, m = min(good, bad), max(good, bad), min(n, total - n)
    mean = m * small / total
    var = (total - m) * m * small / total * (large / total) / (total - 1)
    centre, width = mean + 0.5, 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    mode = (m + 1) * (small + 1) // (total + 2)
    lg = math.lgamma

    def log_p(k: int) -> float:
        return -(lg(k + 1) + lg(small - k + 1) + lg(m - k + 1) + lg(large - m + k + 1))

    top, most = log_p(mode), min(min(m, small) + 1.0, math.floor(centre + 16 * math.sqrt(var + 0.5)))
    while True:
        u, v = rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u if u > 0 else -1.0
        if x < 0 or x >= most:
            continue
        k = int(x)
        if large - m + k >= 0 and 2 * math.log(u) <= log_p(k) - top:
            break
    if good > bad:
        k = m - k
    return k if m == n else good - k


def draw(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """n of the places, uniformly: how many of each shard."""
    out, left = np.zeros(len(places), np.int64), int(places.sum())
    if left < NUMPY_MOST:
        return rng.multivariate_hypergeometric(places, n, method="marginals") if n else out
    for s, p in enumerate(places):
        out[s] = hypergeometric(rng, int(p), left - int(p), n)
        n, left = n - int(out[s]), left - int(p)
    return out


class Matrix:
    """The communication matrix, row by row. sizes: rows of each part; shards: places of each shard."""

    def __init__(self, sizes: np.ndarray, shards: np.ndarray, seed: int):
        self.ends, self.shards, self.seed = np.concatenate([[0], np.cumsum(sizes)]), shards, seed
        self.memo: dict[tuple[int, int], np.ndarray] = {}

    def _node(self, lo: int, hi: int, at: int) -> np.ndarray:
        places = self.shards
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self.memo.get((lo, mid))
            if left is None:
                left = draw(np.random.default_rng([self.seed, lo, mid]), places, int(self.ends[mid] - self.ends[lo]))
                if len(self.memo) > 256:
                    self.memo.clear()
                self.memo[lo, mid] = left
            if at < mid:
                places, hi = left, mid
            else:
                places, lo = places - left, mid
        return places

    def row(self, part: int) -> np.ndarray:
        return self._node(0, len(self.ends) - 1, part)


def sizes_of(n: int, shards: int) -> np.ndarray:
    """n rows over the shards; the first ones get one more where it doesn't divide."""
    return np.full(shards, n // shards, np.int64) + (np.arange(shards) < n % shards)


def shard_paths(spark: SparkSession, path: str, shards: int, seed: int = 0, part: int = PART) -> DataFrame:
    """The rows of a Parquet table with their columns, and ``shard`` and ``place``
    (0 up, in its shard) in front; of columns so named, the table's get an
    underscore in front.

    Every row is placed, whatever it holds: nulls, empty and long texts,
    and repeated rows, each one on its own. Sizes differ by one at most; with
    fewer rows than shards some shards are empty; an empty table gives an
    empty one. The same files and seed give the same result.
    """
    rows = spark.read.parquet(path)
    for c in list(rows.columns):
        if c.lower() in ("shard", "place"):
            rows = rows.withColumnRenamed(c, fresh(rows, "_" + c)[0])
    cols = rows.columns
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).orderBy("f").collect()
    files, held = [r["f"] for r in counts], [r["n"] for r in counts]
    first, sizes = [], []
    for n in held:
        first.append(len(sizes))
        sizes += [min(part, n - a) for a in range(0, n, part)]
    total = sum(held)
    given = spark.sparkContext.broadcast(({f: k for k, f in enumerate(files)}, first, np.array(sizes, np.int64), sizes_of(total, shards)))

    @F.pandas_udf("shard int, key long")
    def dealt(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names, starts, parts, places = given.value
        m, now, to = Matrix(parts, places, seed), -1, None
        for f, i in batches:
            i = i.to_numpy()
            file = np.array([names[x] for x in f], np.int64)
            p = np.array(starts, np.int64)[file] + i // part if len(i) else np.zeros(0, np.int64)
            out = np.zeros((len(i), 2), np.int64)
            for q in np.unique(p):
                if q != now:
                    rng = np.random.default_rng([seed, 1, int(q)])
                    to = np.repeat(np.arange(len(places)), m.row(int(q)))[rng.permutation(int(parts[q]))]
                    keys, now = rng.integers(0, 2**63, int(parts[q])), q
                at = p == q
                out[at, 0], out[at, 1] = to[i[at] % part], keys[i[at] % part]
            yield pd.DataFrame({"shard": out[:, 0].astype(np.int32), "key": out[:, 1]})

    d, f, i = fresh(rows, "dealt__", "file__", "index__")
    sent = rows.withColumns({f: F.col("_metadata.file_path"), i: F.col("_metadata.row_index")}).withColumn(d, dealt(F.col(f), F.col(i)))
    # a range of (shard, key) a task: what comes before it in its shard is known from the ranges' sizes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    order = [F.col(d + ".shard"), F.col(d + ".key"), F.col(f), F.col(i)]
    out = scratch(spark, "dealt")
    sorted_ = sent.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    with cleaned(spark):
        sorted_.withColumns({f + "part": F.spark_partition_id(), f + "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(out)
    out = spark.read.parquet(out)
    held = out.groupBy(F.col(d + ".shard").alias("s"), F.col(f + "part").alias("p")).agg(F.min(f + "at").alias("least"), F.count("*").alias("n"))
    # a row for each range, and one more for each shard
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("p")) - F.col("n") - F.col("least")).select(F.struct("s", "p").alias(f + "in"), F.col("before").alias(f + "before"))
    out = out.withColumn(f + "in", F.struct(F.col(d + ".shard").alias("s"), F.col(f + "part").alias("p"))).join(F.broadcast(before), f + "in")  # as many rows as tasks and shards, whatever the table
    return out.select(F.col(d + ".shard").alias("shard"), (F.col(f + "at") + F.col(f + "before")).cast("int").alias("place"), *[named(out, c) for c in cols])


def shard(df: DataFrame, shards: int, seed: int = 0, part: int = PART) -> DataFrame:
    """`shard_paths` for any DataFrame, which is first written to the shared folder."""
    path = scratch(df.sparkSession, "to-shard")
    df.write.parquet(path)
    return shard_paths(df.sparkSession, path, shards, seed, part)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 64 shards of equal size."""
    return shard_paths(spark, f"{sf_dir}/documents.parquet", 64)
