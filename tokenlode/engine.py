"""A facade for single queries with ids, and cursors; answers are dicts, bad arguments are {"error": ..}."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cnf as proximity
from .operators import distribution, documents, overlap, stats
from .operators.match import count, find, with_pointers
from .sources.corpus import Corpus
from .sources.shared import running, written


class GramEngine:
    """Queries over a corpus of ids. Version 4 semantics; options that only tuned threads or memory are taken and ignored."""

    def __init__(self, corpus: Corpus | str | list[str], eos_token_id: int = 0, spark: SparkSession | None = None, token_dtype: str = "u16", version: int = 4, bow_ids: list[int] | None = None,
                 precompute_unigram_logprobs: bool = False, max_support: int = 1000, max_clause_freq: int = 50000, max_diff_tokens: int = 100, maxnum: int = 1, max_disp_len: int = 1000, table: DataFrame | None = None, **ignored):
        if version not in (4, 5):
            raise ValueError("version must be 4 or 5")
        self.corpus = corpus if isinstance(corpus, Corpus) else Corpus.from_folders(spark or SparkSession.getActiveSession(), corpus, token_dtype, eos_token_id)
        self.spark = self.corpus.docs.sparkSession
        self.token_id_max, self.bow, self.logprobs = self.corpus.sep, bow_ids, precompute_unigram_logprobs
        self.max_support, self.max_clause_freq, self.max_diff_tokens, self.maxnum, self.max_disp_len = max_support, max_clause_freq, max_diff_tokens, maxnum, max_disp_len
        self._table: DataFrame | None = table

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> GramEngine:
        """What `save` wrote: the corpus and its suffix table."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(Corpus.from_parquet(spark, f"{path}/docs", about["sep"], about["eos"], about["width"]), table=spark.read.parquet(f"{path}/suffixes"), **options)

    def save(self, path: str) -> None:
        """Write the corpus and its suffix table, by shard and ranges of ranks."""
        c = self.corpus
        c.save(f"{path}/docs")
        self.table.repartitionByRange("shard", "rank").sortWithinPartitions("shard", "rank").write.parquet(f"{path}/suffixes")
        self.spark.createDataFrame([(json.dumps({"sep": c.sep, "eos": c.eos, "width": c.width}),)], "value string").coalesce(1).write.text(f"{path}/about")

    def _ids(self, ids) -> bool:
        return isinstance(ids, list) and all(isinstance(t, int) and not isinstance(t, bool) and 0 <= t <= self.token_id_max for t in ids)

    def _cnf(self, c) -> bool:
        return isinstance(c, list) and all(isinstance(d, list) and all(self._ids(t) and t for t in d) for d in c)

    def _query(self, ids: list[int], **more) -> DataFrame:
        extra = "".join(f", {k} bigint" for k in more)
        return self.spark.createDataFrame([(0, ids, *more.values())], "qid bigint, ids array<bigint>" + extra)

    def _sep(self, ids: list[int]) -> bool:
        return self.corpus.sep in ids

    @property
    def table(self) -> DataFrame:
        """The suffix table, made when first asked for; `save` keeps it for other sessions."""
        if self._table is None:
            self._table = stats.suffixes(self.corpus)
        return self._table

    def _found(self, ids: list[int]) -> DataFrame:
        return with_pointers(self.corpus, find(self.corpus, self._query(ids), self._sep(ids)))

    def num_shards(self) -> int:
        return len(self._shards())

    def _shards(self) -> dict[int, dict]:
        """What each shard holds; a row a shard."""
        if "shards" not in self.corpus.made:
            self.corpus.made["shards"] = {r["shard"]: r.asDict() for r in stats.shard_stats(self.corpus).orderBy("shard").collect()}
        return self.corpus.made["shards"]

    def _shard(self, s: int, what: str) -> int:
        if s not in self._shards():
            raise IndexError(f"no shard {s}")
        return self._shards()[s][what]

    def tok_cnt(self, s: int) -> int:
        return self._shard(s, "tok_cnt")

    def ds_size(self, s: int) -> int:
        """Bytes of the shard's tokens."""
        return self._shard(s, "ds_size")

    def total_tok_cnt(self) -> int:
        return sum(x["tok_cnt"] for x in self._shards().values())

    def total_doc_cnt(self) -> int:
        return sum(x["doc_cnt"] for x in self._shards().values())

    def compute_unigram_counts(self, s: int) -> dict[int, int]:
        self._shard(s, "tok_cnt")
        return {r["token"]: r["cnt"] for r in stats.unigram_counts(self.corpus).where(F.col("shard") == s).orderBy("token").collect()}

    def find(self, input_ids):
        """Where ids stand in the suffix order of each shard; what doesn't occur has an empty range where it would come."""
        if not self._ids(input_ids):
            return {"error": "input_ids: a list of ids is expected"}
        at = {r["shard"]: (r["start"], r["end"]) for r in stats.segment(self.corpus, input_ids).collect()}
        return {"cnt": sum(e - s for s, e in at.values()), "segment_by_shard": [at.get(s, (0, 0)) for s in self._shards()]}

    def find_with_hint(self, input_ids, hint_segment_by_shard):
        """`find` within ranges that a prefix of input_ids had; only their suffixes are looked at."""
        if not self._ids(input_ids):
            return {"error": "input_ids: a list of ids is expected"}
        if len(hint_segment_by_shard) != self.num_shards():
            return {"error": "hint_segment_by_shard: a range for each shard is expected"}
        got = self.find(input_ids)
        if "error" in got:
            return got
        both = [(max(s, a), min(e, b)) for (s, e), (a, b) in zip(got["segment_by_shard"], hint_segment_by_shard)]
        both = [(s, max(s, e)) for s, e in both]
        return {"cnt": sum(e - s for s, e in both), "segment_by_shard": both}

    def ntd_from_segment(self, num_bytes: int, segment_by_shard: list[tuple[int, int]], max_support=None):
        """The distribution of the tokens num_bytes behind the suffixes of ranges."""
        most = self.max_support if max_support is None else max_support
        if not isinstance(most, int) or most <= 0:
            return {"error": "max_support has to be positive"}
        if len(segment_by_shard) != self.num_shards() or num_bytes < 0 or num_bytes % self.corpus.width:
            return {"error": "a range for each shard, and whole tokens, are expected"}
        ranges = self.spark.createDataFrame([(s, a, e) for s, (a, e) in zip(self._shards(), segment_by_shard)], "shard int, a long, e long")
        at = self.table.join(F.broadcast(ranges), "shard").where("rank >= a AND rank < e")  # a row a shard
        d = distribution.behind(self.corpus, at.select(F.lit(0).cast("bigint").alias("qid"), "shard", "doc_id", "pos"), num_bytes // self.corpus.width)
        return self._answer(distribution.approximate(d, most).collect())

    def count(self, input_ids):
        if not self._ids(input_ids):
            return {"error": "input_ids: a list of ids is expected"}
        return {"count": count(self.corpus, self._query(input_ids), self._sep(input_ids)).first()["count"], "approx": False}

    def _prob(self, prompt_ids, cont_id, of):
        if not self._ids(prompt_ids):
            return {"error": "prompt_ids: a list of ids is expected"}
        if not self._ids([cont_id]):
            return {"error": "cont_id is no id"}
        r = of(self.corpus, self._query(prompt_ids, cont=cont_id), sep=self._sep([*prompt_ids, cont_id])).first().asDict()
        r.pop("qid")
        return r

    def primitive_prob(self, prompt_ids, cont_id):
        return self._prob(prompt_ids, cont_id, distribution.prob)

    def prob(self, prompt_ids, cont_id):
        return self._prob(prompt_ids, cont_id, distribution.infgram_prob)

    def _dist(self, prompt_ids, max_support, of):
        most = self.max_support if max_support is None else max_support
        if not isinstance(most, int) or most <= 0:
            return {"error": "max_support has to be positive"}
        if not self._ids(prompt_ids):
            return {"error": "prompt_ids: a list of ids is expected"}
        q = self._query(prompt_ids)
        b = of(self.corpus, q, self._sep(prompt_ids)) if of else q
        suffix = b.first()["suffix_len"] if of else None
        d = distribution.ntd(self.corpus, b.select("qid", "ids"), self._sep(prompt_ids))
        rows = distribution.approximate(d, most).collect()
        out = self._answer(rows)
        return out if suffix is None else out | {"suffix_len": suffix}

    @staticmethod
    def _answer(rows) -> dict:
        return {"prompt_cnt": sum(r["cont_cnt"] for r in rows), "result_by_token_id": {r["token"]: {"cont_cnt": r["cont_cnt"], "prob": r["prob"]} for r in rows}, "approx": any(r["approx"] for r in rows)}

    def primitive_ntd(self, prompt_ids, max_support=None):
        return self._dist(prompt_ids, max_support, None)

    def ntd(self, prompt_ids, max_support=None):
        return self._dist(prompt_ids, max_support, distribution.backoff)

    def _windows(self, cnf, max_clause_freq, max_diff_tokens):
        freq = self.max_clause_freq if max_clause_freq is None else max_clause_freq
        diff = self.max_diff_tokens if max_diff_tokens is None else max_diff_tokens
        if not isinstance(freq, int) or freq <= 0:
            return {"error": "max_clause_freq has to be positive"}, None
        if not isinstance(diff, int) or diff < 0:
            return {"error": "max_diff_tokens can't be negative"}, None
        if not self._cnf(cnf):
            return {"error": "cnf: lists of lists of lists of ids are expected"}, None
        if not cnf:
            return {"error": "cnf has no clause"}, None
        rows = [(0, c, t, ids) for c, d in enumerate(cnf) for t, ids in enumerate(d)]
        return None, proximity.compat(self.corpus, self.spark.createDataFrame(rows, "qid long, clause int, term int, ids array<bigint>"), diff, freq)

    def find_cnf(self, cnf, max_clause_freq=None, max_diff_tokens=None):
        error, w = self._windows(cnf, max_clause_freq, max_diff_tokens)
        if error:
            return error
        by: dict[int, list] = {}
        for r in w.orderBy("shard", "l", "r").collect():
            by.setdefault(r["shard"], []).append(r)
        cnt = sum(int(len(v) * v[0]["factor"]) for v in by.values())
        return {"cnt": cnt, "approx": any(v[0]["factor"] > 1 for v in by.values()), "ptrs_by_shard": [[r["l"] * self.corpus.width for r in by.get(s, [])] for s in range(self.num_shards())] if by else []}

    def count_cnf(self, cnf, max_clause_freq=None, max_diff_tokens=None):
        error, w = self._windows(cnf, max_clause_freq, max_diff_tokens)
        return error or self._counted(w)

    @staticmethod
    def _counted(w: DataFrame) -> dict:
        by = w.groupBy("shard").agg(F.count("*").alias("n"), F.max("factor").alias("factor")).collect()
        return {"count": sum(int(r["n"] * r["factor"]) for r in by), "approx": any(r["factor"] > 1 for r in by)}

    def _limits(self, maxnum, max_disp_len):
        n, most = self.maxnum if maxnum is None else maxnum, self.max_disp_len if max_disp_len is None else max_disp_len
        bad = next((name for name, v in (("maxnum", n), ("max_disp_len", most)) if not isinstance(v, int) or v <= 0), None)
        return ({"error": f"{bad} has to be positive"} if bad else None), n, most

    def _documents(self, at: DataFrame, most: int) -> list[dict]:
        return self._ordered(documents.by_ptr(self.corpus, at, most))

    def _drawn(self, rows: DataFrame, n: int, most: int, seed, cnt: int, approx: bool):
        have = rows.count()
        draws = documents.local_draws(have, n, seed)
        if not draws:
            return {"cnt": 0, "approx": approx, "idxs": [], "documents": []}
        idx = self.spark.createDataFrame(list(enumerate(draws)), "draw int, idx long")
        at = running(rows.select("shard", "ptr").withColumns({"qid": F.lit(0), "one": F.lit(1).cast("bigint")}), ["qid"], ["shard", "ptr"], "one")
        at = at.withColumn("idx", F.col("upto_one") - 1).join(idx, "idx").select("draw", "shard", "ptr")
        return {"cnt": cnt, "approx": approx, "idxs": draws, "documents": self._documents(at, most)}

    def search_docs(self, input_ids, maxnum=None, max_disp_len=None, seed=None):
        error, n, most = self._limits(maxnum, max_disp_len)
        if error or not self._ids(input_ids):
            return error or {"error": "input_ids: a list of ids is expected"}
        rows = self._found(input_ids).where("pos >= 0")
        return self._drawn(rows, n, most, seed, rows.count(), False)

    def search_docs_cnf(self, cnf, maxnum=None, max_disp_len=None, max_clause_freq=None, max_diff_tokens=None, seed=None):
        limits, n, most = self._limits(maxnum, max_disp_len)
        error, w = self._windows(cnf, max_clause_freq, max_diff_tokens)
        if limits or error:
            return limits or error
        w = written(w, "windows")
        got = self._counted(w)
        return self._drawn(w.select("shard", (F.col("l") * self.corpus.width).alias("ptr")), n, most, seed, got["count"], got["approx"])

    def _ordered(self, rows: DataFrame) -> list[dict]:
        d = rows.orderBy("draw").collect()
        return [{k: r[k] for k in ("doc_ix", "doc_len", "disp_len", "needle_offset", "metadata", "token_ids")} | {"blocked": False} for r in d]

    def _whole(self, rows: list, of: list, what: str) -> list:
        if len(rows) != len(of):
            raise IndexError(f"a {what} that isn't there")
        return rows

    def get_docs_by_ptrs(self, requests: list[tuple[int, int]], max_disp_len: int) -> list[dict]:
        at = self.spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(requests)], "draw int, shard int, ptr long")
        return self._whole(self._documents(at, max_disp_len), requests, "pointer")

    def get_doc_by_ptr(self, s: int, ptr: int, max_disp_len: int) -> dict:
        return self.get_docs_by_ptrs([(s, ptr)], max_disp_len)[0]

    def get_docs_by_ptrs2(self, requests: list[tuple[int, int, int, int]]) -> list[dict]:
        """(shard, ptr, needle_len, max_ctx_len): the needle with so many tokens on either side."""
        at = self.spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "draw int, shard int, ptr long, needle_len long, max_ctx_len long")
        return self._whole(self._ordered(documents.by_ptr_context(self.corpus, at)), requests, "pointer")

    def get_docs_by_ranks(self, requests: list[tuple[int, int]], max_disp_len: int) -> list[dict]:
        at = self.spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(requests)], "draw int, shard int, rank long")
        return self._whole(self._ordered(documents.by_rank(self.corpus, at, max_disp_len, self.table)), requests, "rank")

    def get_doc_by_rank(self, s: int, rank: int, max_disp_len: int) -> dict:
        return self.get_docs_by_ranks([(s, rank)], max_disp_len)[0]

    def get_docs_by_ranks2(self, requests: list[tuple[int, int, int, int]]) -> list[dict]:
        """(shard, rank, needle_len, max_ctx_len): as `get_docs_by_ptrs2`."""
        at = self.spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "draw int, shard int, rank long, needle_len long, max_ctx_len long")
        return self._whole(self._ordered(documents.by_rank_context(self.corpus, at, self.table)), requests, "rank")

    def get_docs_by_ixs(self, ixs: list[int], max_disp_len: int) -> list[dict]:
        at = self.spark.createDataFrame(list(enumerate(ixs)), "draw int, doc_ix long")
        return self._whole(self._ordered(documents.by_ix(self.corpus, at, max_disp_len)), ixs, "document")

    def get_doc_by_ix(self, doc_ix: int, max_disp_len: int) -> dict:
        return self.get_docs_by_ixs([doc_ix], max_disp_len)[0]

    def creativity(self, input_ids):
        if not self._ids(input_ids):
            return {"error": "input_ids: a list of ids is expected"}
        return {"rs": [r["r"] for r in overlap.creativity(self.corpus, self._query(input_ids)).orderBy("l").collect()]}

    def attribute(self, input_ids, delim_ids=None, min_len=1, max_cnt=10, enforce_bow=False):
        if not self._ids(input_ids) or not self._ids(delim_ids or []):
            return {"error": "input_ids, delim_ids: lists of ids are expected"}
        if not all(isinstance(v, int) and v > 0 for v in (min_len, max_cnt)):
            return {"error": "min_len and max_cnt have to be positive"}
        rows = overlap.attribute(self.corpus, self._query(input_ids), delim_ids, min_len, max_cnt, (self.bow or []) if enforce_bow else None, self.logprobs).orderBy("l").collect()
        return {"spans": [{k: r[k] for k in ("l", "r", "length", "count", "unigram_logprob_sum")} | {"docs": [x.asDict() for x in r["docs"]]} for r in rows]}

    def cursor(self) -> Cursor:
        return Cursor(self)

    def generate_draft(self, prompt_ids: list[int], n: int, seed: int) -> list[int]:
        """Tokens drawn by how often they follow; none if the prompt doesn't occur."""
        c = Cursor(self)
        for t in prompt_ids:
            if not c.advance(t)["cnt"]:
                return []
        return c.generate_draft(n, random.Random(seed))


class Cursor:
    """A prompt that grows token by token, and a written table of where it occurs.

    An advance keeps the places where the next token fits; their next AHEAD tokens
    are in the table, so the corpus is scanned for the first token and once more for every AHEAD.
    As the next token eos is the end of a document, so advancing by it goes on in the next one: from then on places are
    looked for in the stream.
    """

    AHEAD = 32

    def __init__(self, engine: GramEngine):
        self.engine = engine
        self.reset()

    def reset(self) -> None:
        self.ids, self.places, self.used, self.cnt = [], None, 0, self.engine.total_tok_cnt()

    @property
    def num_bytes(self) -> int:
        return len(self.ids) * self.engine.corpus.width

    def _move(self, token: int) -> None:
        c = self.engine.corpus
        t = c.sep if token == c.eos else token
        self.ids = [*self.ids, t]
        if self.cnt and self.places is not None and t != c.sep and self.used < self.AHEAD:
            self.places = written(self.places.where(F.get("next", F.lit(self.used)) == F.lit(t)), "cursor")
            self.used += 1
        elif self.cnt:
            self.places, self.used = written(find(c, self.engine._query(self.ids), self.engine._sep(self.ids), self.AHEAD), "cursor"), 0
        self.cnt = self.places.count() if self.cnt else 0

    def advance(self, token: int) -> dict:
        """What `GramEngine.find` says of the prompt with this token."""
        if not self.engine._ids([token]):
            return {"error": "token: an id is expected"}
        self._move(token)
        return self.engine.find(self.ids)

    def _next(self) -> DataFrame:
        """(qid, token, cont_cnt, prompt_cnt, prob) of what comes next."""
        c = self.engine.corpus
        if not self.ids or (self.cnt and self.used == self.AHEAD):
            return distribution.ntd(c, self.engine._query(self.ids), self.engine._sep(self.ids))
        t = F.coalesce(F.get("next", F.lit(self.used)), F.lit(c.eos))
        t = F.when(t == F.lit(c.sep), F.lit(c.eos)).otherwise(t)
        return distribution.shares(self.places.groupBy(F.lit(0).alias("qid"), t.alias("token")).agg(F.count("*").alias("cont_cnt")), "qid")

    def ntd(self, max_support: int | None = None) -> dict:
        most = self.engine.max_support if max_support is None else max_support
        if not isinstance(most, int) or most <= 0:
            return {"error": "max_support has to be positive"}
        return self.engine._answer(distribution.approximate(self._next(), most).collect())

    def advance_ntd(self, token: int, max_support: int | None = None) -> dict:
        if not self.engine._ids([token]):
            return {"error": "token: an id is expected"}
        self._move(token)
        return self.ntd(max_support)

    def sample_one(self, rng: random.Random) -> int | None:
        """A token drawn by how often it comes next: the one at a random place of the distribution, of which only that row is fetched."""
        if not self.cnt:
            return None
        d = running(self._next().select("qid", "token", "cont_cnt"), ["qid"], ["token"], "cont_cnt")
        return d.where(F.col("upto_cont_cnt") > rng.randrange(self.cnt)).orderBy("upto_cont_cnt").first()["token"]

    def generate_draft(self, n: int, rng: random.Random) -> list[int]:
        out = []
        while len(out) < n and (t := self.sample_one(rng)) is not None:
            out.append(t)
            self._move(t)
        return out


class EngineDiff(GramEngine):
    """A corpus, less what another one has: matches shrink until the main corpus has them more often, documents
    that show the same as one of the other corpus are blocked."""

    def __init__(self, corpus: Corpus | str | list[str], other: Corpus | str | list[str], **options):
        super().__init__(corpus, **options)
        self.other = other if isinstance(other, Corpus) else GramEngine(other, **options).corpus

    def compute_longest_prefix_len(self, input_ids: list[int], delim_ids: list[int] | None = None, enforce_bow: bool = False) -> int:
        if not input_ids:
            return 0
        d = overlap.diff_longest(self.corpus, self.other, self._query(input_ids), delim_ids, (self.bow or []) if enforce_bow else None)
        return d.where("l = 0").first()["n"]

    def get_docs_by_ptrs2_grouped(self, requests: list[tuple[list[tuple[int, int]], list[int], int, int]]) -> list[list[dict]]:
        """([(shard, ptr), ..], needle ids, needle_len, max_ctx_len) each: the documents of each request, blocked ones without tokens."""
        at = [(r, k, s, p, n, ctx) for r, (ptrs, _, n, ctx) in enumerate(requests) for k, (s, p) in enumerate(ptrs)]
        rows = self.spark.createDataFrame(at, "qid long, draw int, shard int, ptr long, needle_len long, max_ctx_len long")
        main = documents.by_ptr_context(self.corpus, rows)
        needles = self.spark.createDataFrame([(r, ids, n, ctx) for r, (_, ids, n, ctx) in enumerate(requests)], "qid long, ids array<bigint>, needle_len long, max_ctx_len long")
        hits = find(self.other, needles.select("qid", "ids"), sep=any(self.other.sep in x[1] for x in requests)).where("pos >= 0").join(needles.drop("ids"), "qid")
        theirs = documents.shown(self.other, hits, F.col("max_ctx_len"), F.col("needle_len") + F.col("max_ctx_len")).select("qid", "token_ids", F.lit(True).alias("hit")).distinct()
        both = main.join(theirs, ["qid", "token_ids"], "left").orderBy("qid", "draw").collect()
        out: list[list[dict]] = [[] for _ in requests]
        for r in both:
            row = {k: r[k] for k in ("doc_ix", "doc_len", "disp_len", "needle_offset", "metadata", "token_ids")}
            out[r["qid"]].append(row | {"blocked": bool(r["hit"]), "token_ids": [] if r["hit"] else r["token_ids"]})
        return out
