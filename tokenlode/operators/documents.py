"""Documents around occurrences, by pointer, rank, number or search."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import display
from ..sources.corpus import Corpus
from ..sources.shared import written

#: Tokens of a stretch in which pointers look for their document.
SPAN = 1 << 16
#: Bytes of a shard in which a query's occurrences are counted together, and numbers by which wanted documents are told.
BLOCK, HASHES = 1 << 22, 1 << 21


def locate(corpus: Corpus, requests: DataFrame) -> DataFrame:
    """requests(.., shard, ptr) with doc_id, doc_ix, doc_len and pos of the token there.

    A range join by stretches of SPAN tokens, in each of which a document that reaches into it is listed. A separator is at no token: pos is -1.
    """
    end = F.col("doc_start") + F.col("doc_len")
    lay = corpus.layout().withColumn("span", F.explode(F.sequence(F.expr(f"doc_start div {SPAN}"), F.expr(f"(doc_start + doc_len) div {SPAN}"))))
    req = requests.withColumn("o__", F.expr(f"ptr div {corpus.width}")).withColumn("span", F.expr(f"o__ div {SPAN}"))
    got = req.join(lay, ["shard", "span"]).where((F.col("o__") >= F.col("doc_start")) & (F.col("o__") <= end))
    return got.withColumn("pos", F.col("o__") - F.col("doc_start") - 1).drop("o__", "span")


def shown(corpus: Corpus, at: DataFrame, before: Column, after: Column, every: bool = False) -> DataFrame:
    """at(.., shard, doc_id, pos) with token_ids, disp_len, needle_offset and metadata: before tokens in front of pos, after from it on.

    Only documents that at asks for, and a few others, are exchanged, unless it asks for every one: a hash of HASHES values tells them.
    """
    docs = corpus.docs.select("shard", "doc_id", "tokens", "metadata")
    if not every:
        at = written(at, "requests")
        key = F.pmod(F.xxhash64("shard", "doc_id"), F.lit(HASHES)).alias("key__")
        docs = docs.withColumn("key__", key).join(F.broadcast(at.select(key).distinct()), "key__", "left_semi").drop("key__")
    d = at.join(docs, ["shard", "doc_id"])
    start = F.greatest(F.col("pos") - before, F.lit(0))
    d = d.withColumn("token_ids", display(F.col("tokens"), start, F.col("pos") + after)).withColumn("disp_len", F.size("token_ids").cast("bigint"))
    return d.withColumn("needle_offset", F.when(F.col("pos") >= 0, F.col("pos") - start).cast("bigint")).drop("tokens")


def by_ptr(corpus: Corpus, requests: DataFrame, max_disp_len: int) -> DataFrame:
    """Half of max_disp_len in front of the pointer, the other half, rounded up, from it on."""
    return shown(corpus, locate(corpus, requests), F.lit(max_disp_len // 2), F.lit(max_disp_len - max_disp_len // 2))


def by_ptr_context(corpus: Corpus, requests: DataFrame) -> DataFrame:
    """requests(.., shard, ptr, needle_len, max_ctx_len): the needle with so many tokens on either side."""
    return shown(corpus, locate(corpus, requests), F.col("max_ctx_len"), F.col("needle_len") + F.col("max_ctx_len"))


def by_rank(corpus: Corpus, requests: DataFrame, max_disp_len: int, table: DataFrame) -> DataFrame:
    """requests(.., shard, rank) by the suffix table that `stats.suffixes` makes."""
    at = requests.join(table, ["shard", "rank"]).join(corpus.layout(), ["shard", "doc_id"])
    return shown(corpus, at, F.lit(max_disp_len // 2), F.lit(max_disp_len - max_disp_len // 2))


def by_rank_context(corpus: Corpus, requests: DataFrame, table: DataFrame) -> DataFrame:
    """As `by_ptr_context`, with shard and rank."""
    at = requests.join(table, ["shard", "rank"]).join(corpus.layout(), ["shard", "doc_id"])
    return shown(corpus, at, F.col("max_ctx_len"), F.col("needle_len") + F.col("max_ctx_len"))


def by_ix(corpus: Corpus, requests: DataFrame | None, max_disp_len: int) -> DataFrame:
    """requests(doc_ix), or all documents: the first max_disp_len tokens."""
    at = corpus.layout()
    if requests is not None:
        at = at.join(requests, "doc_ix")
    return shown(corpus, at.withColumn("pos", F.lit(0)), F.lit(0), F.lit(max_disp_len), every=requests is None)


def picked(found: DataFrame, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of found(qid, shard, ptr, ..) the rows that wanted, given (qid, cnt), asks for as (qid, idx, ..), with cnt and idx, their number in the order of shard and pointer.

    Occurrences are counted by BLOCK bytes of a shard; only those in the blocks that hold a wanted one are put in order, each block by itself.
    """
    blocks = found.select("qid", "shard", F.floor(F.col("ptr") / BLOCK).alias("block__")).groupBy("qid", "shard", "block__").agg(F.count("*").alias("n__"))
    blocks = written(blocks, "blocks")
    upto = F.sum("n__").over(Window.partitionBy("qid").orderBy("shard", "block__"))
    blocks = blocks.withColumn("before__", upto - F.col("n__"))
    ask = wanted(blocks.groupBy("qid").agg(F.sum("n__").alias("cnt")))
    ask = blocks.join(ask, "qid").where((F.col("idx") >= F.col("before__")) & (F.col("idx") < F.col("before__") + F.col("n__")))
    ask = written(ask.withColumn("k__", F.col("idx") - F.col("before__")).drop("n__", "before__"), "wanted")
    some = found.withColumn("block__", F.floor(F.col("ptr") / BLOCK)).join(F.broadcast(ask.select("qid", "shard", "block__").distinct()), ["qid", "shard", "block__"], "left_semi")
    some = some.withColumn("k__", F.row_number().over(Window.partitionBy("qid", "shard", "block__").orderBy("ptr")).cast("bigint") - 1)
    return some.join(ask, ["qid", "shard", "block__", "k__"]).drop("block__", "k__")


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The first k occurrences of each query by shard and pointer, with idx and cnt, how many there are."""
    every = F.sequence(F.lit(0).cast("bigint"), F.least("cnt", F.lit(k)) - 1)
    return picked(found, lambda cnt: cnt.select("qid", "cnt", F.explode(every).alias("idx")))


def random_draws(found: DataFrame, maxnum: int, seed: int) -> DataFrame:
    """maxnum occurrences of each query, drawn with replacement: the row of each draw, with idx, cnt and draw.

    A draw's number is 48 bits of a hash of the seed, the query's id and the draw, modulo the occurrences.
    """
    if maxnum <= 0:
        raise ValueError("maxnum must be > 0")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid").cast("string"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("bigint")
    draws = F.explode(F.sequence(F.lit(0), F.lit(maxnum - 1))).alias("draw")
    return picked(found, lambda cnt: cnt.select("qid", "cnt", draws).withColumn("idx", number % F.col("cnt")))


def local_draws(cnt: int, maxnum: int, seed: int | None) -> list[int]:
    """Numbers of occurrences for a single query."""
    r = random.Random(seed)
    return [r.randrange(cnt) for _ in range(maxnum)] if cnt else []
