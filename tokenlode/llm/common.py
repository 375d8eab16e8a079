"""What the operators of this subpackage share: tables, scratch folders and names."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cleaned, shared_dir

#: Bits of `bloom`; beyond some tens of millions of values it lets more pass, which costs time but changes no result.
BITS = 1 << 26
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


class Scope:
    """Deletes on leaving all that `scratch` gave within, but for what is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def keep(self, path: str) -> None:
        self.kept.add(path)

    def __enter__(self) -> Scope:
        self.first = len(_made)
        return self

    def __exit__(self, *_) -> None:
        for path in _made[self.first :]:
            if path not in self.kept:
                delete(self.spark, path)
        _made[self.first :] = [p for p in _made[self.first :] if p in self.kept]


class Tables:
    """Tables in the shared folder that can be deleted one by one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """As `materialise`."""
        path = scratch(self.spark, label)
        with cleaned(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def delete(self, df: DataFrame) -> None:
        for k, (x, path) in enumerate(self.paths):
            if x is df:
                delete(self.spark, path)
                del self.paths[k]
                return


class Bloom:
    """A bit set of fixed size on every executor; `holds` is true for all values that are in it, and for a few others."""

    def __init__(self, spark: SparkSession, bits: np.ndarray):
        self.bits = spark.sparkContext.broadcast(bits)

    @staticmethod
    def places(value: Column) -> list[Column]:
        """Two parts of the value's 64-bit hash."""
        h = F.xxhash64(value)
        return [p.bitwiseAND(F.lit(BITS - 1)).cast("int").alias(f"p{k}") for k, p in enumerate((h, F.shiftrightunsigned(h, 32)))]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """`holds` for hashes made elsewhere."""
        h = hashes.view(np.uint64)
        return self.holds(h & np.uint64(BITS - 1), h >> np.uint64(32) & np.uint64(BITS - 1))

    def holds(self, *places) -> np.ndarray:
        out = True
        for p in (np.asarray(x).astype(np.int64) for x in places):
            out = out & (self.bits.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def bloom(values: DataFrame, hashed: bool = False) -> Bloom:
    """Of a table of one column, or of 64-bit hashes of values. Executors set the bits; the driver gets words that aren't 0, 16 MB at most."""
    spark = values.sparkSession
    v = F.col(values.columns[0])
    two = [x.bitwiseAND(F.lit(BITS - 1)).cast("int") for x in (v, F.shiftrightunsigned(v, 32))] if hashed else Bloom.places(v)
    p = values.select(F.explode(F.array(*two)).alias("p"))
    with cleaned(spark):
        w = p.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("b")).toArrow()
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[w["w"].to_numpy()] = w["b"].to_numpy().view(np.uint64)
    return Bloom(spark, bits)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage, and
    what was computed survives the loss of any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Give back to the system what tasks before in this Python worker have freed; it stays with the allocators otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def named(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def row_hash(df: DataFrame, *skip: str) -> Column:
    """64 bits of all columns but those skipped; equal rows hash alike."""
    rest = [named(df, c).cast("string") if t.startswith("map") else named(df, c) for c, t in df.dtypes if c not in skip]
    return F.xxhash64(F.lit(0), *rest)
