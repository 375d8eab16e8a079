"""Which parts of a text occur in the corpus word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from ..sources.shared import written
from .documents import shown
from .match import find, placed, text_counts
from .stats import unigram_logprob


def longest(corpus: Corpus, texts: DataFrame, delims: list | None = None, bow: list | None = None) -> DataFrame:
    """(qid, l, n): the longest match from each position, 0 where the token doesn't occur.

    With delims it ends behind the first delimiter before its last token; with
    bow, ids that begin words, it shrinks until such a one, or the text's end, comes next.
    """
    return cut(texts, text_counts(corpus, texts), delims, bow)


def cut(texts: DataFrame, counts: DataFrame, delims: list | None, bow: list | None) -> DataFrame:
    """(qid, l, n) of the longest of counts(qid, l, n, ..), made shorter by delims and bow. The matched part is cut
    out of the text only where they ask for it."""
    n = counts.groupBy("qid", "l").agg(F.max("n").alias("n"))
    t = texts.where(F.size("ids") > 0)
    d = t.select("qid", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("l")).join(n, ["qid", "l"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    if not delims and bow is None:
        return d
    d = d.join(t.select("qid", "ids"), "qid").withColumn("seq", F.slice("ids", F.col("l") + 1, F.col("n") + 1)).withColumn("size", F.size("ids") - F.col("l"))
    if delims:
        at = F.filter(F.transform("seq", lambda t, i: F.when(t.isin(delims) & (i + 1 < F.col("n")), i + 1)), lambda i: i.isNotNull())
        d = d.withColumn("n", F.coalesce(F.get(at, F.lit(0)), F.col("n")))
    if bow is not None:
        ends = F.filter(F.sequence(F.lit(1), F.size("seq")), lambda i: (i <= F.col("n")) & ((i == F.col("size")) | F.coalesce(F.get("seq", i).isin(bow), F.lit(False))))
        d = d.withColumn("n", F.coalesce(F.array_max(ends), F.lit(0)))
    return d.select("qid", "l", "n")


def creativity(corpus: Corpus, texts: DataFrame) -> DataFrame:
    """(qid, l, r): where the longest match from l on ends."""
    return longest(corpus, texts).select("qid", "l", (F.col("l") + F.col("n")).alias("r"))


def spans(texts: DataFrame, d: DataFrame, counts: DataFrame, min_len: int, max_cnt: int, bow: list | None = None) -> DataFrame:
    """Of (qid, l, n) those long and rare enough that no earlier one holds: (qid, l, r, length, count, ids)."""
    d = d.where((F.col("n") >= min_len) & (F.col("n") > 0)).join(counts.withColumnRenamed("cnt", "count"), ["qid", "l", "n"]).where(F.col("count") <= max_cnt)
    if bow is not None:
        d = d.join(texts.select("qid", F.posexplode("ids").alias("l", "t")).where(F.col("t").isin(bow)).drop("t"), ["qid", "l"])
    d = d.withColumn("r", F.col("l") + F.col("n"))
    before = Window.partitionBy("qid").orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("had", F.coalesce(F.max("r").over(before), F.lit(0))).where("r > had").join(texts.select("qid", "ids"), "qid")
    return d.select("qid", "l", "r", F.col("n").alias("length"), "count", F.slice("ids", F.col("l") + 1, F.col("n")).alias("ids"))


def attribute(corpus: Corpus, texts: DataFrame, delims: list | None = None, min_len: int = 1, max_cnt: int = 10, bow: list | None = None, logprobs: bool = True) -> DataFrame:
    """(qid, l, r, length, count, unigram_logprob_sum, docs ARRAY<STRUCT<s, ptr>>) of the spans found in the corpus.

    A token without a log probability, or each where logprobs is off, counts -10000.
    """
    counts = text_counts(corpus, texts)
    s = written(spans(texts, cut(texts, counts, delims, bow), counts, min_len, max_cnt, bow), "spans")
    at = placed(corpus, s.select(F.struct("qid", "l").alias("qid"), "ids"))
    at = at.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.col("shard").alias("s"), "ptr"))).alias("docs")).select("qid.*", "docs")  # count of them, max_cnt at most
    t = s.select("qid", "l", F.explode("ids").alias("token"))
    if logprobs:
        t = t.join(unigram_logprob(corpus), "token", "left").withColumn("logprob", F.coalesce("logprob", F.lit(-10000.0)))
    else:
        t = t.withColumn("logprob", F.lit(-10000.0))
    t = t.groupBy("qid", "l").agg(F.sum("logprob").alias("unigram_logprob_sum"))
    return s.drop("ids").join(t, ["qid", "l"]).join(at, ["qid", "l"])


def diff_longest(main: Corpus, other: Corpus, texts: DataFrame, delims: list | None = None, bow: list | None = None) -> DataFrame:
    """(qid, l, n): the longest match, shrunk until the main corpus has it more often than the other."""
    a, b = text_counts(main, texts), text_counts(other, texts).withColumnRenamed("cnt", "other")
    base = cut(texts, a, delims, bow).withColumnRenamed("n", "most")
    more = a.join(b, ["qid", "l", "n"], "left").where(F.col("cnt") > F.coalesce("other", F.lit(0))).join(base, ["qid", "l"]).where("n <= most").groupBy("qid", "l").agg(F.max("n").alias("n"))
    return base.join(more, ["qid", "l"], "left").select("qid", "l", F.coalesce("n", F.lit(0)).cast("int").alias("n"))


def blocked(main: Corpus, other: Corpus, needles: DataFrame, ctx: int) -> DataFrame:
    """(qid, shard, ptr, doc_ix, token_ids, blocked): each occurrence of needles(qid, ids) in the main corpus in its context.

    Where the other corpus has the same needle in the same context it is blocked and shows no tokens.
    """
    a = shown(main, placed(main, needles), F.lit(ctx), F.col("n") + ctx)
    b = shown(other, find(other, needles, after=0), F.lit(ctx), F.col("n") + ctx).select("qid", "token_ids", F.lit(True).alias("hit")).distinct()
    both = a.join(b, ["qid", "token_ids"], "left").withColumn("blocked", F.coalesce("hit", F.lit(False)))
    return both.withColumn("token_ids", F.when(F.col("blocked"), F.slice("token_ids", 1, 0)).otherwise(F.col("token_ids"))).select("qid", "shard", "ptr", "doc_ix", "token_ids", "blocked")
