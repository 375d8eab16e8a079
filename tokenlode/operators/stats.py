"""Counts over a whole corpus, and the order of its suffixes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import byte_order, count_bucket
from ..sources.corpus import Corpus
from ..sources.shared import running, written
from . import scan
from .match import count, find, windows
from .suffix import suffixes


def shard_stats(corpus: Corpus) -> DataFrame:
    """(shard, doc_cnt, tok_cnt, ds_size): tok_cnt has the separators, ds_size is in bytes."""
    n = F.sum(F.size("tokens").cast("bigint") + 1)
    return corpus.docs.groupBy("shard").agg(F.count("*").alias("doc_cnt"), n.alias("tok_cnt"), (n * corpus.width).alias("ds_size"))


def totals(corpus: Corpus) -> DataFrame:
    """(num_shards, total_doc_cnt, total_tok_cnt)."""
    return shard_stats(corpus).agg(F.count("*").alias("num_shards"), F.sum("doc_cnt").alias("total_doc_cnt"), F.sum("tok_cnt").alias("total_tok_cnt"))


def unigram_counts(corpus: Corpus) -> DataFrame:
    """(shard, token, cnt), with the separator as a token."""
    words = corpus.docs.select("shard", F.explode("tokens").alias("token"))
    seps = corpus.docs.groupBy("shard").agg(F.count("*").alias("cnt")).select("shard", F.lit(corpus.sep).cast(words.schema["token"].dataType).alias("token"), "cnt")
    return words.groupBy("shard", "token").agg(F.count("*").alias("cnt")).unionByName(seps).groupBy("shard", "token").agg(F.sum("cnt").alias("cnt"))


def unigram_logprob(corpus: Corpus) -> DataFrame:
    """(token, cnt, logprob) over all shards; the total has the separators."""
    c = unigram_counts(corpus).groupBy("token").agg(F.sum("cnt").alias("cnt"))
    total = totals(corpus).select(F.col("total_tok_cnt").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("token", "cnt", (F.log("cnt") - F.log("total")).alias("logprob"))  # one row is broadcast


def unigram_ranges(corpus: Corpus) -> DataFrame:
    """(shard, token, start_rank, end_rank): the range of a token in the suffix order, from sums of counts.

    Strings order by their bytes and the separator last, ids by their little-endian bytes.
    """
    c = unigram_counts(corpus)
    if isinstance(corpus.sep, str):
        c = c.withColumns({"k1": F.col("token") == F.lit(corpus.sep), "k2": F.col("token")})
    else:
        c = c.withColumns({"k1": F.lit(False), "k2": byte_order(F.col("token"), corpus.width)})
    c = running(c, ["shard"], ["k1", "k2"], "cnt")
    return c.select("shard", "token", (F.col("upto_cnt") - F.col("cnt")).alias("start_rank"), F.col("upto_cnt").alias("end_rank"))


def segments(corpus: Corpus, queries: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(qid, shard, start, end) of queries in the suffix order; what doesn't occur has no row."""
    table = suffixes(corpus) if table is None else table
    got = find(corpus, queries, sep=True).join(table, ["shard", "doc_id", "pos"])
    return got.groupBy("qid", "shard").agg(F.min("rank").alias("start"), (F.max("rank") + 1).alias("end"))


def segment(corpus: Corpus, ids: list) -> DataFrame:
    """(shard, start, end) of one query in the suffix order, also where it doesn't occur: start is how many suffixes come before it. One scan, no sort."""
    whole = corpus.stream(len(ids)) if len(ids) else corpus.docs.withColumn("tokens", F.concat(F.array(F.lit(corpus.sep)), "tokens"))
    if isinstance(corpus.sep, str):
        key = lambda t: F.when(t == F.lit(corpus.sep), F.lit("\U0010ffff")).otherwise(t)
        want = F.array(*[key(F.lit(t)) for t in ids]).cast("array<string>")
    else:
        key = lambda t: byte_order(t, corpus.width)
        want = F.array(*[key(F.lit(t)) for t in ids]).cast("array<bigint>")
    w = windows(whole.withColumn("tokens", F.transform("tokens", key)), len(ids)).withColumn("want", want)
    got = w.groupBy("shard").agg(F.count_if(F.col("w") < F.col("want")).alias("start"), F.count_if(F.col("w") == F.col("want")).alias("n"))
    return got.select("shard", "start", (F.col("start") + F.col("n")).alias("end"))


LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16)
#: The classes of `count_bucket`, with their least and most.
BUCKETS = (("ultra_rare", 0, 1), ("rare", 2, 5), ("low", 6, 20), ("mid", 21, 100), ("high", 101, 1000), ("very_high", 1001, 1 << 62))


#: Positions whose n-grams are counted first, in turn; documents that are asked for their sizes; bits that tell frequent n-grams.
HEAD, HEAD_DOCS, BITS = (1 << 15, 1 << 18), 4096, 1 << 28


def query_suite(corpus: Corpus, per_bucket: int = 20, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(bucket, len, cnt, ids): n-grams of each length and class of count, the first per_bucket in the order in which they first occur.

    That order is by document, then by offset. The n-grams of the corpus's first positions are counted in all of it, so a class with enough of them
    is known. For the other classes n-grams are counted from everywhere, but only those whose parts occur as often as such a class asks for (`_frequent`).
    """
    spark, docs = corpus.docs.sparkSession, corpus.docs.select("doc_id", "tokens")
    kind, most = docs.schema["tokens"].dataType.simpleString(), max(lengths)
    sizes_ = docs.select("doc_id", F.size("tokens").alias("n")).where("n > 0").orderBy("doc_id").limit(HEAD_DOCS).toArrow()
    upto, cells, whole = np.cumsum(sizes_["n"].to_numpy()), {}, False
    for head in HEAD:
        if not len(upto):
            break
        last = min(int(np.searchsorted(upto, head)), len(upto) - 1)
        some = docs.where(F.col("doc_id") <= F.lit(sizes_["doc_id"][last].as_py())).select("doc_id", F.size("tokens").alias("n"), F.slice("tokens", 1, head + most).alias("tokens")).orderBy("doc_id").toArrow().combine_chunks()
        whole = len(sizes_) < HEAD_DOCS and upto[-1] <= head
        lists = some["tokens"].combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())
        n = np.minimum(left, most)[:head]
        at = pa.array(scan._ranges(np.arange(len(n)), n))
        windows_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), lists.flatten().take(at))
        trie = scan.Trie(windows_)
        got = docs.mapInArrow(scan.node_counts(spark.sparkContext.broadcast(trie)), "node long, cnt long").groupBy("node").agg(F.sum("cnt").alias("cnt")).toArrow()
        cnt = np.zeros(trie.size, np.int64)
        cnt[got["node"].to_numpy()] = got["cnt"].to_numpy()
        cells = {}
        for k in lengths:
            seq, node = trie.paths[k - 1] if k <= len(trie.paths) else (np.zeros(0, np.int64),) * 2
            node, first = np.unique(node, return_index=True)
            node = node[np.argsort(first)]
            first = np.sort(first)
            for name, lo, hi in BUCKETS:
                of = np.flatnonzero((cnt[node] >= lo) & (cnt[node] <= hi))[:per_bucket]
                cells[k, name] = [(name, k, int(cnt[node[x]]), windows_[int(seq[first[x]])].as_py()[:k]) for x in of]
        if whole or all(len(x) == per_bucket for x in cells.values()):
            break
    open_ = [] if whole else [c for c, x in cells.items() if len(x) < per_bucket]
    out = spark.createDataFrame([r for c, x in cells.items() if c not in open_ for r in x], f"bucket string, len int, cnt long, ids {kind}")
    return out.unionByName(_frequent(corpus, per_bucket, open_, lengths)) if open_ else out


def _frequent(corpus: Corpus, per_bucket: int, cells: list[tuple[int, str]], lengths: tuple[int, ...]) -> DataFrame:
    """`query_suite` for these classes, of n-grams of any place. An n-gram that occurs so often has no part that occurs less often."""
    docs = corpus.docs.select("doc_id", "tokens")
    least = min(lo for name, lo, _ in BUCKETS if any(c[1] == name for c in cells))
    far = max(n for n, _ in cells)
    levels = [1, 2, *sorted({*(n for n in lengths if n > 2), 6} - {n for n in lengths if n > far})]
    steps = [(n,) for n in levels] if least <= 100 else [(1,), (2,), tuple(n for n in levels if 2 < n <= 6), tuple(n for n in levels if n > 6)]
    known, bits, out = 0, None, None
    for step in [s for s in steps if s and s[0] <= far]:
        g = docs.mapInArrow(scan.frequent(step, known, bits), "n int, h1 long, h2 long, cnt long, first struct<doc_id:bigint,pos:int>")
        g = g.groupBy("n", "h1", "h2").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
        g = written(g.where(F.col("cnt") >= least), "n-grams")
        own = g.select(F.col("n").alias("len"), "cnt", "first", count_bucket(F.col("cnt")).alias("bucket"))
        wanted = [(F.col("len") == n) & (F.col("bucket") == name) for n, name in cells if n in step]
        if wanted:
            order = Window.partitionBy("len", "bucket").orderBy("first")
            own = own.where(reduce(lambda a, b: a | b, wanted)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_bucket).drop("k")
            own = written(own, "classes")
            out = own if out is None else out.unionByName(own)
        known = step[-1]
        h = g.where(F.col("n") == known).select("h1")
        words = h.select(F.shiftrightunsigned(F.col("h1").bitwiseAND(F.lit(BITS - 1)), 6).alias("w"), F.expr("shiftleft(1L, cast(h1 & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        mine = np.zeros(BITS >> 6, np.uint64)
        mine[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
        bits = docs.sparkSession.sparkContext.broadcast(mine)
    d = out.withColumn("doc_id", F.col("first.doc_id"))
    d = corpus.docs.select("doc_id", "tokens").join(F.broadcast(d), "doc_id").where(F.size("tokens") >= F.col("first.pos") + F.col("len"))
    return d.select("bucket", "len", "cnt", F.slice("tokens", F.col("first.pos") + 1, F.col("len")).alias("ids"))


def mismatches(left: Corpus, right: Corpus, queries: DataFrame) -> DataFrame:
    """Queries whose counts differ between two corpora: (qid, left_cnt, right_cnt)."""
    a, b = count(left, queries), count(right, queries)
    both = a.select("qid", F.col("count").alias("left_cnt")).join(b.select("qid", F.col("count").alias("right_cnt")), "qid")
    return both.where("left_cnt <> right_cnt")
