"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a folder of generations. Each is a Parquet table of digests,
bucketed by digest into one sorted file a bucket; all have the number of
buckets with which the index was made. New digests are exchanged once into
the same buckets, then sort-merge anti-joined with one generation after the
other, whose files need no exchange. The rest becomes the next generation.
A generation counts once its _SUCCESS file is there, so an append that
breaks off leaves the index as it was; `compact` merges all generations.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, named, row_hash, scratch


class DigestIndex:
    """Digests seen so far, each with the row that first had it.

    The columns of a generation are ``digest`` (16 bytes), ``id`` (BIGINT) and
    ``tie`` (BIGINT, a hash of the other columns of that row).
    """

    SCHEMA = "digest BINARY, id BIGINT, tie BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [x for x in self._list(self.path) if x.startswith("buckets=")]
        if there:
            buckets = int(there[0].split("=")[1])
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{self.path}/buckets={self.buckets}"

    def _hpath(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list[str]:
        p = self._hpath(path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def generations(self) -> list[str]:
        """Complete generations, oldest first; a compacted one replaces those before it."""
        done = [g for g in self._list(self.root) if g.startswith("gen=") and "_SUCCESS" in self._list(f"{self.root}/{g}")]
        whole = [i for i, g in enumerate(done) if g.endswith("-all")]
        return done[whole[-1] :] if whole else done

    def _name(self, gen: str) -> str:
        return "digests_" + hashlib.md5(f"{self.root}/{gen}".encode()).hexdigest()

    def read(self, gen: str) -> DataFrame:
        """A generation as the bucketed table that it is."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(gen)} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{gen}'"
        )
        return self.spark.table(self._name(gen))

    def all(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.SCHEMA)
        for g in self.generations():
            out = out.unionByName(self.read(g))
        return out

    def _write(self, rows: DataFrame, gen: str) -> DataFrame:
        path = f"{self.root}/{gen}"
        if self._fs.exists(self._hpath(path)):  # of a run that broke off
            self._fs.delete(self._hpath(path), True)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(gen)}")
        (
            rows.select("digest", "id", "tie").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(self._name(gen))
        )
        return self.read(gen)

    def _next(self, end: str = "") -> str:
        last = [int(g.split("=")[1].split("-")[0]) for g in self._list(self.root) if g.startswith("gen=")]
        return f"gen={max(last, default=-1) + 1:06d}{end}"

    def unseen(self, new: DataFrame) -> DataFrame:
        """Of each digest that no generation has, the least (id, tie); an id of null comes last."""
        first = new.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "tie")).alias("r"))
        out = first.select("digest", "r.id", "r.tie").repartition(self.buckets, "digest")
        for g in self.generations():
            out = out.join(self.read(g).select("digest").hint("merge"), "digest", "left_anti")
        return out

    def add(self, new: DataFrame) -> DataFrame:
        """Append the digests not seen before; returns them."""
        return self._write(self.unseen(new), self._next())

    def compact(self) -> None:
        """Merge all generations into one, which replaces them at once."""
        old = self.generations()
        self._write(self.all(), self._next("-all"))
        for g in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(g)}")
            self._fs.delete(self._hpath(f"{self.root}/{g}"), True)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, id, tie) of each row with a text."""
    return docs.where(named(docs, text_col).isNotNull()).select(
        F.unhex(F.md5(named(docs, text_col).cast("binary"))).alias("digest"), named(docs, id_col).cast("bigint").alias("id"), row_hash(docs, id_col, text_col).alias("tie")
    )


def exact_dedup_ids(docs: DataFrame, index: DigestIndex, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Feed docs to the index in batches by id; (doc_id, digest) of the rows that stay.

    Of rows with the same text the one with the least id stays, also over
    batches, as they come in the order of ids; it shows once, even where its
    row repeats. A null id counts as the largest. Texts are equal if
    their bytes are; the empty text is a text. Rows with a null text have no
    digest and don't show here (`exact_dedup` keeps them). An empty table
    gives an empty result. Other columns don't matter.
    """
    seen = materialise(digests(docs.select(named(docs, id_col), named(docs, text_col)), id_col, text_col), "digests")
    low, high = seen.agg(F.min("id"), F.max("id")).first()
    cuts = [None] if low is None else [low + (high - low + 1) * i // batches for i in range(1, batches)] + [None]
    out, since = None, None
    for cut in cuts:
        part = seen
        if since is not None:
            part = part.where((F.col("id") >= since) | F.col("id").isNull())
        if cut is not None:
            part = part.where(F.col("id") < cut)
        got = index.add(part)
        out, since = got if out is None else out.unionByName(got), cut
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("digest")).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    As `exact_dedup_ids`, and: rows with a null text equal no other and stay;
    of rows alike in every column one stays; of rows that share text and id
    but differ elsewhere, the one with the least hash of the rest. Columns
    may have any names.
    """
    d, i, t = fresh(docs, "digest__", "id__", "tie__")
    keys = [d, i, t]
    keep = index.add(digests(docs, id_col, text_col)).select(F.col("digest").alias(d), F.coalesce("id", F.lit(-(2**63))).alias(i), F.col("tie").alias(t))
    rows = docs.where(named(docs, text_col).isNotNull()).withColumns(
        {d: F.unhex(F.md5(named(docs, text_col).cast("binary"))), i: F.coalesce(named(docs, id_col).cast("bigint"), F.lit(-(2**63))), t: row_hash(docs, id_col, text_col)}
    )
    kept = rows.join(keep, keys, "left_semi").dropDuplicates(keys).select(*[named(rows, c) for c in docs.columns])
    return kept.unionByName(docs.where(named(docs, text_col).isNull()))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup_ids(docs, DigestIndex(spark, scratch(spark, "digest-index")))


SQL = "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text"

