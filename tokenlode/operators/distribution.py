"""Probabilities and next-token distributions, with and without backoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from ..sources.shared import written
from .match import find, next_counts, prefix_counts, sizes


def shares(counts: DataFrame, *by: str) -> DataFrame:
    """prompt_cnt and prob to rows with cont_cnt."""
    total = F.sum("cont_cnt").over(Window.partitionBy(*by))
    return counts.withColumn("prompt_cnt", total).withColumn("prob", F.col("cont_cnt") / F.col("prompt_cnt"))


def ntd(corpus: Corpus, prompts: DataFrame, sep: bool = False) -> DataFrame:
    """(qid, token, cont_cnt, prompt_cnt, prob), exact. The end of a document is the token eos; a prompt that doesn't occur has no rows.

    The empty prompt goes on with every token of the corpus, a separator being eos; such prompts share one aggregation.
    """
    nxt = F.coalesce("token", F.lit(corpus.eos))
    if sep:
        nxt = F.when(nxt == F.lit(corpus.sep), F.lit(corpus.eos)).otherwise(nxt)
    docs = _read(corpus, prompts, sep)
    some = [c.select("u", nxt.alias("token"), "cnt").groupBy("u", "token").agg(F.sum("cnt").alias("cont_cnt")).join(F.broadcast(keyed), "u").select("qid", "token", "cont_cnt") for keyed, c in next_counts(docs, prompts.where(F.size("ids") > 0).select("qid", "ids"))]
    some = reduce(DataFrame.unionByName, some)
    return shares(some.unionByName(prompts.where(F.size("ids") == 0).select("qid").crossJoin(_every(corpus))), "qid")  # the result has each token for each


def _read(corpus: Corpus, prompts: DataFrame, sep: bool) -> DataFrame:
    """Documents, with sep with as much of the stream behind them as the prompts and the token behind them take."""
    return corpus.stream(max(sizes(prompts, "ids"), default=0) + 1) if sep else corpus.docs


def behind(corpus: Corpus, at: DataFrame, n: int) -> DataFrame:
    """`ntd` of positions: at(qid, shard, doc_id, pos), pos -1 at a separator, and the tokens n behind them. A separator there is eos, so is the end of the shard."""
    d = corpus.stream(n + 1).join(at, ["shard", "doc_id"]).where((F.col("pos") >= -1) & (F.col("pos") + 1 < F.col("own")))
    t = F.coalesce(F.get("tokens", (F.col("pos") + 1 + n).cast("int")), F.lit(corpus.eos))
    t = F.when(t == F.lit(corpus.sep), F.lit(corpus.eos)).otherwise(t)
    return shares(d.groupBy("qid", t.alias("token")).agg(F.count("*").alias("cont_cnt")), "qid")


def _every(corpus: Corpus) -> DataFrame:
    """(token, cont_cnt) over all positions."""
    kind = corpus.docs.schema["tokens"].dataType.elementType
    words = corpus.docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("cont_cnt"))
    ends = corpus.docs.agg(F.count("*").alias("cont_cnt")).where("cont_cnt > 0").select(F.lit(corpus.eos).cast(kind).alias("token"), "cont_cnt")
    return words.unionByName(ends).groupBy("token").agg(F.sum("cont_cnt").alias("cont_cnt"))


def approximate(dist: DataFrame, max_support: int) -> DataFrame:
    """(qid, token, cont_cnt, prompt_cnt, prob, approx): a systematic sample of each distribution.

    The continuations, in the order of their tokens, are cut into units of the least
    power of two that leaves at most max_support of them; each counts for the
    token at its middle, the last one for what it holds. Totals stay.
    """
    if max_support <= 0:
        raise ValueError("max_support must be > 0")
    total = F.col("prompt_cnt")
    unit = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(total / F.lit(float(max_support)))), F.lit(0))).cast("bigint")
    d = dist.withColumn("unit", unit).withColumn("unit", F.when(F.col("unit") * max_support < total, F.col("unit") * 2).otherwise(F.col("unit")))
    upto = F.sum("cont_cnt").over(Window.partitionBy("qid").orderBy("token"))
    d = d.withColumn("e", upto).withColumn("s", F.col("e") - F.col("cont_cnt"))
    # middles of units at or after x; the last, partial unit has its middle at half of what it holds
    whole, part = F.expr("prompt_cnt div unit"), F.expr("prompt_cnt % unit")
    last = F.expr("(prompt_cnt div unit) * unit + (prompt_cnt % unit) div 2")

    def before(x: str):
        return F.least(F.greatest(F.expr(f"({x} + unit - 1 - unit div 2) div unit"), F.lit(0)), whole)

    n = (before("e") - before("s")) * F.col("unit") + F.when((part > 0) & (last >= F.col("s")) & (last < F.col("e")), part).otherwise(0)
    d = d.withColumn("approx", F.col("unit") > 1).withColumn("cont_cnt", n.cast("bigint")).where("cont_cnt > 0")
    return d.select("qid", "token", "cont_cnt", "prompt_cnt", (F.col("cont_cnt") / F.col("prompt_cnt")).alias("prob"), "approx")


def prob(corpus: Corpus, prompts: DataFrame, eos_as_doc_end: bool = False, sep: bool = False) -> DataFrame:
    """prompts(qid, ids, cont) -> (qid, prompt_cnt, cont_cnt, prob); prob is -1 where the prompt doesn't occur.

    cont is taken literally; with eos_as_doc_end the token eos is the end of a document as well. sep lets ids
    and cont hold the separator, which is the token behind each document's last but the shard's.
    """
    kind = corpus.docs.schema["tokens"].dataType.elementType
    got = []
    for keyed, c in next_counts(_read(corpus, prompts, sep), prompts.where(F.size("ids") > 0).select("qid", "ids", F.col("cont").cast(kind).alias("cont"))):
        c = written(c, "next-counts")
        end = F.col("token").isNull() | ((F.col("token") == F.lit(corpus.sep)) & (F.col("token") != F.lit(corpus.eos)))
        every = c.groupBy("u").agg(F.sum("cnt").alias("prompt_cnt"), F.coalesce(F.sum(F.when(end, F.col("cnt"))), F.lit(0)).alias("ends"))
        # a prompt's row meets the one count of its continuation, not all that follows the prompt
        own = F.coalesce("cnt", F.lit(0))
        if eos_as_doc_end:
            own = own + F.when(F.col("cont") == F.lit(corpus.eos), F.col("ends")).otherwise(0)
        mine = c.join(F.broadcast(keyed.select("u", F.col("cont").alias("token")).distinct()), ["u", "token"], "left_semi").withColumnRenamed("token", "cont")
        got.append(keyed.join(every, "u").join(mine, ["u", "cont"], "left").select("qid", "prompt_cnt", own.alias("cont_cnt")))
    got = reduce(DataFrame.unionByName, got)
    # the empty prompt: what goes on is the token at each position
    empty = prompts.where(F.size("ids") == 0).select("qid", "cont")
    tokens = corpus.docs.select(F.explode("tokens").alias("cont")).join(F.broadcast(empty.select("cont").distinct()), "cont", "left_semi").groupBy("cont").agg(F.count("*").alias("n"))
    docs = corpus.docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("tokens").cast("bigint")), F.lit(0)).alias("tokens"))
    ends = F.col("cont") == F.lit(corpus.sep) if sep else F.lit(False)
    if eos_as_doc_end:
        ends = ends | (F.col("cont") == F.lit(corpus.eos))
    empty = empty.join(tokens, "cont", "left").crossJoin(docs)  # one row
    empty = empty.select("qid", (F.col("tokens") + F.col("docs")).alias("prompt_cnt"), (F.coalesce("n", F.lit(0)) + F.when(ends, F.col("docs")).otherwise(0)).alias("cont_cnt"))
    got = got.unionByName(empty)
    zero = F.lit(0).cast("bigint")
    out = prompts.select("qid").join(got, "qid", "left").select("qid", F.coalesce("prompt_cnt", zero).alias("prompt_cnt"), F.coalesce("cont_cnt", zero).alias("cont_cnt"))
    return out.withColumn("prob", F.when(F.col("prompt_cnt") > 0, F.col("cont_cnt") / F.col("prompt_cnt")).otherwise(-1.0))


def backoff(corpus: Corpus, prompts: DataFrame, sep: bool = False) -> DataFrame:
    """prompts(qid, ids, ..) with ids cut to its longest suffix that occurs, and suffix_len.

    Prompt and corpus are read backwards, so it is a longest prefix. sep lets ids hold separators: the corpus is
    then the stream, each document behind as much of the one before as the longest prompt.
    """
    if sep:
        most = prompts.agg(F.max(F.size("ids"))).first()[0] or 0
        d = corpus.stream(most, before=True)
    else:
        d = corpus.docs
    back = Corpus(d.withColumn("tokens", F.reverse("tokens")), corpus.sep, corpus.eos, corpus.width)
    n = prefix_counts(back, prompts.select(F.col("qid").alias("key"), F.reverse("ids").alias("seq"))).groupBy("key").agg(F.max("n").alias("suffix_len"))
    out = prompts.join(n, prompts["qid"] == n["key"], "left").drop("key").withColumn("suffix_len", F.coalesce("suffix_len", F.lit(0)))
    return written(out.withColumn("ids", F.slice("ids", F.size("ids") - F.col("suffix_len") + 1, F.col("suffix_len"))), "backoff")


def infgram_ntd(corpus: Corpus, prompts: DataFrame, sep: bool = False) -> DataFrame:
    """`ntd` of each prompt's longest suffix that occurs, with suffix_len."""
    b = backoff(corpus, prompts, sep)
    return ntd(corpus, b.select("qid", "ids"), sep).join(b.select("qid", "suffix_len"), "qid")


def infgram_prob(corpus: Corpus, prompts: DataFrame, eos_as_doc_end: bool = False, sep: bool = False) -> DataFrame:
    """`prob` of each prompt's longest suffix that occurs, with suffix_len."""
    b = backoff(corpus, prompts, sep)
    return prob(corpus, b.select("qid", "ids", "cont"), eos_as_doc_end, sep).join(b.select("qid", "suffix_len"), "qid")


def topk(dist: DataFrame, k: int) -> DataFrame:
    """The k most probable tokens of each distribution, with rank; ties go by token."""
    order = Window.partitionBy("qid").orderBy(F.desc("cont_cnt"), "token")
    return dist.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def continuations(corpus: Corpus, prompts: DataFrame, n: int) -> DataFrame:
    """(qid, next) of each occurrence: the next n tokens at most."""
    return find(corpus, prompts, after=n).select("qid", "next")


def greedy(corpus: Corpus, prompts: DataFrame, n: int) -> DataFrame:
    """(qid, step, token, cont_cnt): each step takes the most frequent next token and keeps the occurrences that go on with it.

    Ties go by token. It ends after n tokens, or with eos at the end of a document. One scan
    of the corpus finds what follows; a step then takes one aggregation.
    """
    alive = written(continuations(corpus, prompts, n).groupBy("qid", "next").agg(F.count("*").alias("w")), "continuations")
    out = None
    order = Window.partitionBy("qid").orderBy(F.desc("cont_cnt"), "token")
    for k in range(n):
        tok = F.coalesce(F.get("next", F.lit(k)), F.lit(corpus.eos))
        best = alive.groupBy("qid", tok.alias("token")).agg(F.sum("w").alias("cont_cnt")).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
        best = written(best.withColumn("step", F.lit(k + 1)), "step")
        out = best if out is None else out.unionByName(best)
        alive = alive.join(best.select("qid", "token"), "qid").where((F.get("next", F.lit(k)) == F.col("token")) & (F.col("token") != F.lit(corpus.eos))).drop("token")
    return out.select("qid", "step", "token", "cont_cnt")
