"""The queries over the given tables, and their SQL.

The corpus is the table documents in two shards; prompts and needles are
made from the table benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import tokenize
from ..operators import cnf, distribution, documents, overlap, stats
from ..operators.match import count, find, placed, refine, with_pointers
from ..sources.corpus import Corpus

GRAMS, CNF_D, MAX_DISP, CTX, K, STEPS, MIN_LEN, MAX_CNT = (1, 2, 3, 5), 10, 1000, 8, 3, 5, 5, 1000
#: Low, so that distributions of small tables are sampled as well.
SUPPORT = 20
BUDGET_DOCS, BUDGET_TOKENS = 500, 100_000
#: Tokens that end a match, and such as begin words.
DELIMS, BOW = ["the", "der", "de", "of", "und", "que"], ["a", "in", "the", "to", "die", "la", "y"]


def corpus(spark: SparkSession, d: str) -> Corpus:
    return Corpus.from_texts(spark.read.parquet(f"{d}/documents.parquet"), shards=2)


def toxic(spark: SparkSession, d: str) -> Corpus:
    """The documents labelled toxic."""
    bad = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    return Corpus.from_texts(spark.read.parquet(f"{d}/documents.parquet").join(bad, "doc_id", "left_semi"), shards=2)


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("bigint").alias("qid"), tokenize(F.col("text")).alias("ids"))


def grams(spark: SparkSession, d: str, *lengths: int) -> DataFrame:
    """The different n-grams of the passages, of each length and from every position; qid is the least (item_id * 10,000 + position) * 10 + length."""
    t = texts(spark, d).withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths or GRAMS]))).where("size(ids) >= n")
    t = t.withColumn("l", F.explode(F.sequence(F.lit(0), F.size("ids") - F.col("n"))))
    t = t.select(((F.col("qid") * 10_000 + F.col("l")) * 10 + F.col("n")).alias("qid"), F.slice("ids", F.col("l") + 1, F.col("n")).alias("ids"))
    return t.groupBy("ids").agg(F.min("qid").alias("qid")).select("qid", "ids")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Passages without their last token, which is cont."""
    t = texts(spark, d).where("size(ids) > 0")
    return t.select("qid", F.slice("ids", 1, F.size("ids") - 1).alias("ids"), F.element_at("ids", -1).alias("cont"))


def gram_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = grams(spark, d, 2, 3, 4)  # each continuation is a query of its own
    return t.select("qid", F.slice("ids", 1, F.size("ids") - 1).alias("ids"), F.element_at("ids", -1).alias("cont"))


def clauses(spark: SparkSession, d: str, three: bool = False) -> DataFrame:
    """(tokens 1-2 OR tokens 3-4) AND token 6, and with three AND token 8, of each window of 8 tokens that starts at a passage's token 1, 9, 17 .."""
    t = texts(spark, d).where("size(ids) >= 8").withColumn("l", F.explode(F.sequence(F.lit(0), F.size("ids") - 8, F.lit(8))))
    parts = ((0, 0, 1, 2), (0, 1, 3, 2), (1, 0, 6, 1), (2, 0, 8, 1))[: 4 if three else 3]
    each = F.array(*[F.struct(F.lit(c).alias("clause"), F.lit(i).alias("term"), F.slice("ids", F.col("l") + a, n).alias("ids")) for c, i, a, n in parts])
    return t.select((F.col("qid") * 10_000 + F.col("l")).alias("qid"), F.explode(each).alias("x")).select("qid", "x.*")


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _rounded(df: DataFrame) -> DataFrame:
    return _longs(df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def _line(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", F.array_join("token_ids", " ")).drop("token_ids")


def _corpus_stats(s, d):
    c = corpus(s, d)
    return _longs(stats.shard_stats(c).crossJoin(F.broadcast(stats.totals(c))))  # one row


def _hits(s, d, *n):
    c = corpus(s, d)
    return c, placed(c, grams(s, d, *n))


def _find_by_shard(s, d):
    c = corpus(s, d)
    return _longs(find(c, grams(s, d)).groupBy("qid", "shard").agg(F.count("*").alias("cnt")))


def _find_with_hint(s, d):
    """Occurrences of the first 2 tokens, refined to those of the first 5."""
    c = corpus(s, d)
    t = texts(s, d).where("size(ids) >= 5")
    got = refine(find(c, t.select("qid", F.slice("ids", 1, 2).alias("ids")), after=3), t.select("qid", F.slice("ids", 3, 3).alias("more")))
    return _longs(with_pointers(c, got).select("qid", "shard", "ptr"))


def _cursor_advance(s, d):
    """The passage's tokens one after the other: how many occurrences are left after each."""
    from ..operators.match import prefix_counts

    got = prefix_counts(corpus(s, d), texts(s, d).select(F.col("qid").alias("key"), F.col("ids").alias("seq")))
    return _longs(got.select(F.col("key").alias("qid"), F.col("n").alias("step"), "cnt"))


def _doc_requests(c, hits):
    return hits.select("qid", "n", "shard", "ptr")


def _doc_by_ptr(s, d):
    c, h = _hits(s, d, 5)
    got = documents.by_ptr(c, _doc_requests(c, h), MAX_DISP)
    return _longs(_line(got.select("qid", "shard", "ptr", "doc_ix", "doc_len", "disp_len", "needle_offset", "token_ids")))


def _doc_context2(s, d):
    c, h = _hits(s, d, 5)
    req = _doc_requests(c, h).withColumn("needle_len", F.col("n")).withColumn("max_ctx_len", F.lit(CTX)).drop("n")
    return _longs(_line(documents.by_ptr_context(c, req).select("qid", "shard", "ptr", "doc_ix", "doc_len", "disp_len", "needle_offset", "token_ids")))


def _search(s, d, pick):
    c, h = _hits(s, d)
    got = documents.shown(c, pick(h), F.lit(MAX_DISP // 2), F.lit(MAX_DISP - MAX_DISP // 2))
    return _longs(_line(got.select("qid", "idx", "cnt", "shard", "ptr", "doc_ix", "doc_len", "disp_len", "needle_offset", "token_ids")))


def _strict(s, d):
    return _longs(cnf.strict(corpus(s, d), clauses(s, d), CNF_D).select("qid", "shard", "doc_id", "p"))


def _attribution(s, d):
    got = overlap.attribute(corpus(s, d), texts(s, d), min_len=MIN_LEN, max_cnt=MAX_CNT)
    ptrs = F.array_join(F.array_sort(F.transform("docs", lambda x: F.concat_ws(":", x["s"], x["ptr"]))), ",")
    return _longs(got.select("qid", "l", "r", "length", "count", F.round("unigram_logprob_sum", 4).alias("unigram_logprob_sum"), ptrs.alias("ptrs")))


def _infgram_ntd(s, d):
    return _longs(distribution.infgram_ntd(corpus(s, d), prompts(s, d)))


def _slice_docs(s, d):
    c = corpus(s, d).head(BUDGET_DOCS, BUDGET_TOKENS)
    return _longs(c.docs.select("shard", "doc_id", F.size("tokens").alias("doc_len")))


def _verify(s, d):
    """Counts that a corpus and the same without the documents labelled toxic don't share."""
    bad = s.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    rest = Corpus.from_texts(s.read.parquet(f"{d}/documents.parquet").join(bad, "doc_id", "left_anti"), shards=2)
    return _longs(stats.mismatches(corpus(s, d), rest, grams(s, d)))


_Q = {
    "corpus_stats": _corpus_stats,
    "unigram_counts": lambda s, d: _longs(stats.unigram_counts(corpus(s, d))),
    "unigram_logprob": lambda s, d: _rounded(stats.unigram_logprob(corpus(s, d))),
    "unigram_ranges": lambda s, d: _longs(stats.unigram_ranges(corpus(s, d))),
    "find_positions": lambda s, d: _longs(_hits(s, d)[1].select("qid", "shard", "doc_id", "ptr")),
    "ngram_count_batch": lambda s, d: _longs(count(corpus(s, d), grams(s, d))),
    "find_by_shard": _find_by_shard,
    "find_with_hint": _find_with_hint,
    "primitive_prob": lambda s, d: _longs(distribution.prob(corpus(s, d), gram_prompts(s, d))),
    "primitive_ntd": lambda s, d: _longs(distribution.ntd(corpus(s, d), grams(s, d))),
    "ntd_topk": lambda s, d: _longs(distribution.topk(distribution.ntd(corpus(s, d), grams(s, d)), 20)),
    "ntd_approx": lambda s, d: _longs(distribution.approximate(distribution.ntd(corpus(s, d), grams(s, d)), SUPPORT)),
    "infgram_prob": lambda s, d: _longs(distribution.infgram_prob(corpus(s, d), prompts(s, d))),
    "infgram_ntd": _infgram_ntd,
    "cursor_advance": _cursor_advance,
    "greedy_generate": lambda s, d: _longs(distribution.greedy(corpus(s, d), grams(s, d, 2), STEPS)),
    "cnf_strict": _strict,
    "cnf_compat": lambda s, d: _longs(cnf.compat(corpus(s, d), clauses(s, d), CNF_D).select("qid", "shard", "doc_id", "l", "r")),
    "count_cnf": lambda s, d: cnf.count_cnf(corpus(s, d), clauses(s, d), CNF_D),
    "cnf_strict_three": lambda s, d: _longs(cnf.strict(corpus(s, d), clauses(s, d, True), CNF_D).select("qid", "shard", "doc_id", "p")),
    "cnf_terms_once": lambda s, d: _longs(cnf.terms(corpus(s, d), clauses(s, d), dedupe=True).select("qid", "clause", "term", "shard", "doc_id", "p")),
    "longest_delims": lambda s, d: _longs(overlap.longest(corpus(s, d), texts(s, d), delims=DELIMS)),
    "longest_bow": lambda s, d: _longs(overlap.longest(corpus(s, d), texts(s, d), bow=BOW)),
    "doc_by_ix": lambda s, d: _longs(_line(documents.by_ix(corpus(s, d), None, MAX_DISP).select("doc_ix", "doc_id", "doc_len", "disp_len", "needle_offset", "token_ids"))),
    "doc_by_ptr": _doc_by_ptr,
    "doc_context2": _doc_context2,
    "search_docs_first_k": lambda s, d: _search(s, d, lambda h: documents.first_k(h, K)),
    "search_docs_random": lambda s, d: _search(s, d, lambda h: documents.random_draws(h, K, 7)),
    "creativity": lambda s, d: _longs(overlap.creativity(corpus(s, d), texts(s, d))),
    "attribution_spans": _attribution,
    "diff_longest": lambda s, d: _longs(overlap.diff_longest(corpus(s, d), toxic(s, d), texts(s, d))),
    "diff_blocked": lambda s, d: _longs(_line(overlap.blocked(corpus(s, d), toxic(s, d), grams(s, d, 5), CTX))),
    "suffix_rank": lambda s, d: _longs(stats.suffixes(corpus(s, d))),
    "slice_docs": _slice_docs,
    "query_suite": lambda s, d: _longs(stats.query_suite(corpus(s, d)).withColumn("ids", F.array_join("ids", " "))),
    "verify_index": _verify,
}


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict:
    from .oracle import SQL

    return dict(SQL)
