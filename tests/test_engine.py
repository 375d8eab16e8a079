"""Answers on a corpus of nine tokens, and random corpora against brute force."""

import io
import json
import random

import numpy as np
import pytest

from tokenlode import cli
from tokenlode.engine import EngineDiff, GramEngine
from tokenlode.operators import cnf, distribution, match, overlap, stats
from tokenlode.sources.corpus import Corpus, catalog

S = 65535


@pytest.fixture(scope="module")
def engine(spark):
    c = Corpus.from_ids(spark, [[[10, 20, 30, 40], [20, 30, 50]]])
    return GramEngine(Corpus(c.docs.coalesce(1), c.sep, c.eos, c.width), precompute_unigram_logprobs=True)


@pytest.mark.parametrize("ids, n", [([20], 2), ([20, 30], 2), ([99], 0), ([], 9), ([0], 0), ([50, 0], 0), ([S], 2), ([40, S, 20], 1)])
def test_count(engine, ids, n):
    assert engine.count(ids) == {"count": n, "approx": False}


@pytest.mark.parametrize("ids, at", [([20, 30], (1, 3)), ([30], (3, 5)), ([50], (6, 7)), ([99], (7, 7)), ([], (0, 9)), ([30, 60], (5, 5)), ([40, S], (5, 6))])
def test_segments(engine, ids, at):
    assert engine.find(ids) == {"cnt": at[1] - at[0], "segment_by_shard": [at]}


def test_hint(engine):
    assert engine.find_with_hint([20, 30, 40], [(1, 3)]) == {"cnt": 1, "segment_by_shard": [(1, 2)]}
    assert engine.find_with_hint([20, 30, 40], [(2, 3)])["cnt"] == 0
    assert "error" in engine.find_with_hint([20], [])
    got = engine.ntd_from_segment(4, [(1, 3)])
    assert {t: x["cont_cnt"] for t, x in got["result_by_token_id"].items()} == {40: 1, 50: 1}
    got = engine.ntd_from_segment(2, [(5, 7)])  # behind 40 and 50
    assert {t: x["cont_cnt"] for t, x in got["result_by_token_id"].items()} == {0: 2}


def test_shards(engine):
    assert (engine.num_shards(), engine.tok_cnt(0), engine.ds_size(0), engine.total_tok_cnt(), engine.total_doc_cnt()) == (1, 9, 18, 9, 2)
    assert engine.compute_unigram_counts(0) == {10: 1, 20: 2, 30: 2, 40: 1, 50: 1, S: 2}
    for f in (engine.tok_cnt, engine.ds_size, engine.compute_unigram_counts):
        with pytest.raises(IndexError):
            f(1)


def test_separators(engine):
    assert engine.primitive_prob([S], 10) == {"prompt_cnt": 2, "cont_cnt": 1, "prob": 0.5}
    assert engine.primitive_prob([40], S) == {"prompt_cnt": 1, "cont_cnt": 1, "prob": 1.0}
    assert engine.primitive_prob([50], S) == {"prompt_cnt": 1, "cont_cnt": 0, "prob": 0.0}
    assert engine.primitive_prob([], S)["cont_cnt"] == 2 and engine.primitive_prob([], 20)["cont_cnt"] == 2
    assert engine.prob([99, 40, S], 20) == {"prompt_cnt": 1, "cont_cnt": 1, "prob": 1.0, "suffix_len": 2}
    assert engine.ntd([99, S])["suffix_len"] == 1


def test_find(engine):
    assert engine.find([20, 30]) == {"cnt": 2, "segment_by_shard": [(1, 3)]}
    assert engine.find([50])["segment_by_shard"] == [(6, 7)]
    order = [(r["doc_id"], r["pos"]) for r in engine.table.orderBy("rank").collect()]
    assert [(5 * d + 1 + p) * 2 for d, p in order] == [2, 4, 12, 6, 14, 8, 16, 0, 10]


def test_prob(engine):
    assert engine.primitive_prob([20, 30], 40) == {"prompt_cnt": 2, "cont_cnt": 1, "prob": 0.5}
    assert engine.primitive_prob([50], 0) == {"prompt_cnt": 1, "cont_cnt": 0, "prob": 0.0}
    assert engine.primitive_prob([99], 20) == {"prompt_cnt": 0, "cont_cnt": 0, "prob": -1.0}
    assert engine.prob([7, 20, 30], 40) == {"prompt_cnt": 2, "cont_cnt": 1, "prob": 0.5, "suffix_len": 2}
    got = engine.prob([99], 20)
    assert (got["suffix_len"], got["prompt_cnt"], got["cont_cnt"]) == (0, 9, 2)


def test_ntd(engine):
    counts = lambda r: {t: x["cont_cnt"] for t, x in r["result_by_token_id"].items()}
    assert counts(engine.primitive_ntd([20, 30])) == {40: 1, 50: 1}
    assert counts(engine.primitive_ntd([50])) == {0: 1}
    assert counts(engine.primitive_ntd([])) == {0: 2, 10: 1, 20: 2, 30: 2, 40: 1, 50: 1}
    assert "error" in engine.primitive_ntd([1], 0) and "error" in engine.count("x") and "error" in engine.primitive_prob([1], -1)


def test_cnf(engine):
    assert engine.find_cnf([[[20, 30]]], max_diff_tokens=0) == {"cnt": 2, "approx": False, "ptrs_by_shard": [[4, 12]]}
    assert engine.count_cnf([[[10], [50]], [[30]]], max_diff_tokens=5)["count"] == 2
    assert engine.count_cnf([[[20]], [[40]]], max_diff_tokens=2)["count"] == 0
    assert engine.count_cnf([[[20], [20, 30]]], max_diff_tokens=5)["count"] == 4
    assert engine.find_cnf([[[20]], [[99]]]) == {"cnt": 0, "approx": False, "ptrs_by_shard": []}
    assert "error" in engine.find_cnf([])


def test_documents(engine):
    d = engine.get_doc_by_ix(0, 1000)
    assert (d["doc_len"], d["disp_len"], d["needle_offset"], d["token_ids"]) == (4, 4, 0, [10, 20, 30, 40])
    assert engine.get_docs_by_ptrs([(0, 14)], 1000)[0]["token_ids"] == [20, 30, 50]
    assert [x["token_ids"] for x in engine.get_docs_by_ptrs([(0, 6), (0, 2)], 2)] == [[20, 30], [10]]
    s = engine.search_docs([20, 30], seed=1)
    assert s["cnt"] == 2 and s["documents"][0]["token_ids"][s["documents"][0]["needle_offset"] :][:2] == [20, 30]


def test_documents_by(engine):
    assert engine.get_doc_by_ptr(0, 14, 1000)["needle_offset"] == 1
    assert engine.get_docs_by_ptrs2([(0, 4, 1, 1)])[0]["token_ids"] == [10, 20, 30]
    # ranks 0 and 4 are the first document's first token, and the second's 30
    assert [d["token_ids"] for d in engine.get_docs_by_ranks([(0, 4), (0, 0)], 2)] == [[20, 30], [10]]
    assert engine.get_doc_by_rank(0, 4, 1000)["token_ids"] == [20, 30, 50]
    assert [d["token_ids"] for d in engine.get_docs_by_ranks2([(0, 1, 1, 1)])] == [[10, 20, 30]]
    assert [d["doc_ix"] for d in engine.get_docs_by_ixs([1, 0, 1], 1000)] == [1, 0, 1]
    for f in (lambda: engine.get_doc_by_ix(2, 9), lambda: engine.get_doc_by_ptr(0, 99, 9), lambda: engine.get_doc_by_rank(0, 99, 9)):
        with pytest.raises(IndexError):
            f()


def test_search_cnf(engine):
    got = engine.search_docs_cnf([[[20, 30]], [[40], [50]]], maxnum=3, max_diff_tokens=5, seed=2)
    assert got["cnt"] == 1 and len(got["documents"]) == 3 and not got["approx"]  # the other window grows over a document's end
    assert engine.search_docs_cnf([[[99]]])["documents"] == []


def test_saved(spark, engine, tmp_path):
    engine.save(str(tmp_path / "index"))
    e = GramEngine.load(spark, str(tmp_path / "index"))
    assert e.count([20, 30])["count"] == 2 and e.get_doc_by_rank(0, 4, 1000)["token_ids"] == [20, 30, 50]
    assert e.ntd_from_segment(4, [(1, 3)])["prompt_cnt"] == 2


def test_diff(spark):
    main = Corpus.from_ids(spark, [[[10, 20, 30, 40], [20, 30, 50]]])
    other = Corpus.from_ids(spark, [[[20, 30, 50], [10]]])
    d = EngineDiff(main, other)
    assert [d.compute_longest_prefix_len(x) for x in ([20, 30, 50], [20, 30, 40], [10, 7], [99], [])] == [2, 3, 0, 0, 0]
    assert d.compute_longest_prefix_len([20, 30, 40], [20]) == 1
    got = d.get_docs_by_ptrs2_grouped([([(0, 4), (0, 12)], [20, 30], 2, 5), ([(0, 2)], [10], 1, 0)])
    assert [[(x["blocked"], x["token_ids"]) for x in r] for r in got] == [[(False, [10, 20, 30, 40]), (True, [])], [(True, [])]]


def test_overlap(engine):
    assert engine.creativity([10, 20, 30, 50]) == {"rs": [3, 4, 4, 4]}
    assert engine.creativity([77, 30, 40, 20]) == {"rs": [0, 3, 3, 4]}
    spans = engine.attribute([10, 20, 30, 50], min_len=2)["spans"]
    assert [(x["l"], x["r"], x["count"], [d["ptr"] for d in x["docs"]]) for x in spans] == [(0, 3, 1, [2]), (1, 4, 1, [12])]
    spans = engine.attribute([10, 20, 30, 50], delim_ids=[20], min_len=2)["spans"]
    assert [(x["l"], x["r"]) for x in spans] == [(0, 2), (2, 4)]
    assert engine.attribute([20, 30], max_cnt=1)["spans"] == []


def test_cursor(engine):
    c = engine.cursor()
    assert c.cnt == 9 and c.advance(20) == {"cnt": 2, "segment_by_shard": [(1, 3)]} and c.advance(30)["cnt"] == 2 and (c.cnt, c.num_bytes) == (2, 4)
    assert {t: x["cont_cnt"] for t, x in c.ntd()["result_by_token_id"].items()} == {40: 1, 50: 1}
    assert c.advance_ntd(40)["result_by_token_id"] == {0: {"cont_cnt": 1, "prob": 1.0}} and c.cnt == 1
    assert c.advance(0)["cnt"] == 1 and c.advance_ntd(20)["result_by_token_id"] == {30: {"cont_cnt": 1, "prob": 1.0}}  # on in the next document
    assert "error" in c.advance(-1) and c.advance(99)["cnt"] == 0 and c.sample_one(random.Random(1)) is None and c.ntd()["prompt_cnt"] == 0
    c.reset()
    assert (c.cnt, c.num_bytes) == (9, 0)


def test_cursor_looks_ahead_again(spark):
    e = GramEngine(Corpus.from_ids(spark, [[list(range(1, 12))]]))
    c = e.cursor()
    c.AHEAD = 3
    assert [c.advance(t)["cnt"] for t in range(1, 12)] == [1] * 11 and list(c.ntd()["result_by_token_id"]) == [0]


def test_draft(engine):
    assert engine.generate_draft([99], 3, 1) == []
    drafts = {tuple(engine.generate_draft([10], 3, seed)) for seed in range(6)}
    assert drafts <= {(20, 30, 40), (20, 30, 50), (20, 30, 0)} and all(d[:2] == (20, 30) for d in drafts)
    first = [engine.cursor().sample_one(random.Random(k)) for k in range(12)]
    assert set(first) <= {0, 10, 20, 30, 40, 50} and len(set(first)) > 1


def test_cli(engine, capsys, tmp_path, monkeypatch):
    rng = random.Random(1)
    assert cli.sample_token({}, 0, 1.0, rng) == 0 and cli.sample_token({5: 0.6, 4: 0.4}, 0, 0, rng) == 5 and cli.sample_token({5: 0.6, 4: 0.4}, 1, 1.0, rng) == 5
    said = [cli.answer(engine, x) for x in ("ping", "count 1 20", "prob 40 2 20 30", "ntd 10 2 20 30", "quit", "count 2 20", "what", "count 1 x")]
    assert said[:5] == ["pong", "count 2 0", "prob 2 1 0.5", "ntd 2 0 2", None] and all(x.startswith("error") for x in said[5:])
    np.array([S, 10, 20, 30, 40, S, 20, 30, 50], "<u2").tofile(tmp_path / "tokenized.0")
    np.array([0, 10], "<u8").tofile(tmp_path / "offset.0")
    assert cli.main(["run", "--index", str(tmp_path), "--prompt-ids", "10", "--generate", "2", "--temperature", "0"]) == 0
    assert capsys.readouterr().out.split("\n")[0] == "10 20 30"
    monkeypatch.setattr("sys.stdin", io.StringIO("ping\n\ncount 1 30\nquit\nping\n"))
    assert cli.main(["rpc", "--index", str(tmp_path)]) == 0 and capsys.readouterr().out == "pong\ncount 2 0\n"
    monkeypatch.setattr("sys.stdin", io.StringIO("10\nx\n"))
    assert cli.main(["run", "--index", str(tmp_path), "--interactive"]) == 0
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()][0] == "20"
    (tmp_path / "here.json").write_text(json.dumps({"b": {"s3_url": str(tmp_path), "tokenizer": {}, "version": 5}}))
    assert cli.main(["run", "b", "--catalogue", str(tmp_path / "here.json"), "--prompt", "10 20", "--topk", "1"]) == 0
    assert capsys.readouterr().out == "30\t1\t1.000000\n"
    (tmp_path / "c.json").write_text('{"b": {"s3_url": "u", "tokenizer": {}, "version": 4}}')
    assert cli.main(["list", str(tmp_path / "c.json")]) == 0 and capsys.readouterr().out == "b\tu\t{}\t4\n"


def test_random_against_brute_force(spark):
    r = random.Random(3)
    shards = [[[r.randrange(1, 4) for _ in range(r.randrange(0, 9))] for _ in range(4)] for _ in range(2)]
    c = Corpus.from_ids(spark, shards, "u32")
    docs = [d for s in shards for d in s]
    grams = [[r.randrange(1, 4) for _ in range(r.randrange(1, 7))] for _ in range(12)]
    q = spark.createDataFrame(list(enumerate(grams)), "qid long, ids array<bigint>")
    want = {k: sum(d[i : i + len(g)] == g for d in docs for i in range(len(d))) for k, g in enumerate(grams)}
    assert {x["qid"]: x["count"] for x in match.count(c, q).collect()} == want
    longest = lambda t: max([n for n in range(len(t) + 1) if n == 0 or any(d[i : i + n] == t[:n] for d in docs for i in range(len(d)))])
    assert {(x["qid"], x["l"]): x["r"] for x in overlap.creativity(c, q).collect()} == {(k, i): i + longest(g[i:]) for k, g in enumerate(grams) for i in range(len(g))}
    for s, ds in enumerate(shards):
        stream = [t for d in ds for t in [2**32 - 1, *d]]
        key = lambda i: b"".join(t.to_bytes(4, "little") for t in stream[i:])
        at = {(k, p): i for i, (k, p) in enumerate((k + 4 * s, p) for k, d in enumerate(ds) for p in range(-1, len(d)))}
        got = [at[x["doc_id"], x["pos"]] for x in stats.suffixes(c, 2).where(f"shard = {s}").orderBy("rank").collect()]
        assert got == sorted(range(len(stream)), key=key)


def test_approximate_keeps_totals(spark):
    d = spark.createDataFrame([(0, 10, 7, 20, 0.35), (0, 11, 7, 20, 0.35), (0, 12, 6, 20, 0.3)], "qid long, token long, cont_cnt long, prompt_cnt long, prob double")
    rows = distribution.approximate(d, 4).collect()
    assert sum(x["cont_cnt"] for x in rows) == 20 and all(x["approx"] for x in rows)


def test_folders(spark, tmp_path):
    np.array([S, 10, 20, 30, 40, S, 20, 30, 50], "<u2").tofile(tmp_path / "tokenized.0")
    np.array([0, 10], "<u8").tofile(tmp_path / "offset.0")
    assert [r["tokens"] for r in Corpus.from_folders(spark, str(tmp_path)).docs.orderBy("doc_id").collect()] == [[10, 20, 30, 40], [20, 30, 50]]
    assert GramEngine(str(tmp_path), spark=spark).count([20, 30]) == {"count": 2, "approx": False}
    np.zeros(9 * 9, "u1").tofile(tmp_path / "table.0")  # 9 bytes a pointer
    for bad in (str(tmp_path / "none"), str(tmp_path)):
        with pytest.raises(ValueError):
            Corpus.from_folders(spark, bad)


def test_catalogue_fields(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"b": {"s3_url": "u"}}')
    with pytest.raises(ValueError):
        catalog(spark, str(tmp_path / "c.json"))


def test_saved_corpus(spark, tmp_path):
    c = Corpus.from_ids(spark, [[[1, 2]], [[3]]], metadata=[["m"], ["n"]])
    c.save(str(tmp_path / "c"))
    got = Corpus.from_parquet(spark, str(tmp_path / "c"), c.sep, c.eos, c.width).docs.orderBy("doc_id").collect()
    assert [(r["shard"], r["tokens"], r["metadata"]) for r in got] == [(0, [1, 2], "m"), (1, [3], "n")]


def test_stream_and_layout(spark):
    r = random.Random(5)
    shards = [[[r.randrange(1, 9) for _ in range(r.randrange(0, 4))] for _ in range(15)] for _ in range(2)]
    c = Corpus.from_ids(spark, shards)
    lay = {x["doc_id"]: x for x in c.layout().collect()}
    for s, docs in enumerate(shards):
        stream, at = [t for d in docs for t in [S, *d]], 0
        for k, d in enumerate(docs):
            x = lay[15 * s + k]
            assert (x["doc_ix"], x["doc_start"], x["doc_len"]) == (15 * s + k, at, len(d))
            at += len(d) + 1
        for before in (False, True):
            for x in c.stream(5, before).where(f"shard = {s}").collect():
                a = lay[x["doc_id"]]["doc_start"]
                e = a + x["own"]
                assert x["tokens"] == (stream[max(0, a - 5) : e] if before else stream[a : e + 5])


def test_many_queries_in_parts(spark, monkeypatch):
    r = random.Random(7)
    docs = [[r.randrange(1, 6) for _ in range(60)] for _ in range(4)]
    c = Corpus.from_ids(spark, [docs])
    grams = [[r.randrange(1, 6) for _ in range(r.randrange(1, 4))] for _ in range(30)]
    q = spark.createDataFrame(list(enumerate(grams)), "qid long, ids array<bigint>")
    monkeypatch.setattr(match, "AT_ONCE", 7)
    want = {k: sum(d[i : i + len(g)] == g for d in docs for i in range(len(d))) for k, g in enumerate(grams)}
    assert {x["qid"]: x["count"] for x in match.count(c, q).collect()} == want
    got = {(x["qid"], x["l"], x["n"]): x["cnt"] for x in match.text_counts(c, q).collect()}
    subs = lambda g: sum(d[i : i + len(g)] == g for d in docs for i in range(len(d)))
    assert got == {(k, l, n): subs(g[l : l + n]) for k, g in enumerate(grams) for l in range(len(g)) for n in range(1, len(g) - l + 1) if subs(g[l : l + n])}


def test_long_matches(spark):
    """Longer than one scan reaches."""
    text = [k % 97 + 1 for k in range(700)]
    c = Corpus.from_ids(spark, [[text, text[:100] + [500]]])
    q = spark.createDataFrame([(0, text[:600]), (1, text[:80] + [600])], "qid long, ids array<bigint>")
    got = {(x["qid"], x["l"]): x["n"] for x in overlap.longest(c, q).where("l IN (0, 50)").collect()}
    assert got == {(0, 0): 600, (0, 50): 550, (1, 0): 80, (1, 50): 30}
    cnt = {(x["n"]): x["cnt"] for x in match.text_counts(c, q).where("qid = 0 AND l = 0").collect()}
    assert len(cnt) == 600 and all(cnt[n] == sum(d[i : i + n] == text[:n] for d in (text, text[:100] + [500]) for i in range(len(d))) for n in (1, 2, 63, 64, 65, 100, 101, 512, 513, 600))


def test_words_and_delimiters(spark):
    c = Corpus.from_ids(spark, [[[1, 2, 3, 4, 5, 6]]])
    q = spark.createDataFrame([(0, [1, 2, 3, 4, 9])], "qid long, ids array<bigint>")
    n = lambda **k: [x["n"] for x in overlap.longest(c, q, **k).orderBy("l").collect()]
    assert n() == [4, 3, 2, 1, 0] and n(delims=[2]) == [2, 1, 2, 1, 0] and n(bow=[3]) == [2, 1, 0, 0, 0] and n(bow=[9]) == [4, 3, 2, 1, 0]


def test_cnf_cap_and_dedupe(spark):
    docs = [[[1, 2] * 20 for _ in range(3)]]
    c = Corpus.from_ids(spark, docs)
    one = spark.createDataFrame([(0, 0, 0, [1]), (0, 0, 1, [1, 2])], "qid long, clause int, term int, ids array<bigint>")
    assert cnf.terms(c, one).count() == 120 and cnf.terms(c, one, dedupe=True).count() == 60
    got = cnf.terms(c, one, max_clause_freq=30)
    rows = got.collect()
    assert len(rows) == 30 and {r["factor"] for r in rows} == {4.0}
    r = cnf.count_cnf(c, one, 3, 30).first()
    assert (r["count"], r["approx"]) == (120, True)


def _exchanged(df, spark) -> str:
    """The physical plan above the scan of the corpus for matches, without what is broadcast."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "simple")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    return plan


def _random_corpus(spark, seed, docs=12, most=9, tokens=4):
    r = random.Random(seed)
    shards = [[[r.randrange(1, tokens) for _ in range(r.randrange(0, most))] for _ in range(docs)] for _ in range(2)]
    return r, [d for s in shards for d in s], Corpus.from_ids(spark, shards, "u32")


def test_matches_meet_the_layout_by_document(spark):
    r, docs, c = _random_corpus(spark, 11)
    grams = [[1], [2, 3], [2, 3], [3, 1, 2], [1, 1]]
    q = spark.createDataFrame(list(enumerate(grams)), "qid long, ids array<bigint>")
    got = match.placed(c, q)
    lay = {x["doc_id"]: x["doc_start"] for x in c.layout().collect()}
    want = sorted((k, d, (lay[d] + 1 + i) * 4) for k, g in enumerate(grams) for d, t in enumerate(docs) for i in range(len(t)) if t[i : i + len(g)] == g)
    assert sorted((x["qid"], x["doc_id"], x["ptr"]) for x in got.collect()) == want
    plan = _exchanged(got, spark)
    assert "Generate explode" in plan and "Exchange hashpartitioning" not in plan.split("Generate explode")[0]  # matches stay where they are


def test_next_tokens_are_counted_where_they_are_found(spark):
    r, docs, c = _random_corpus(spark, 12)
    prompts = [([1], 2), ([1], 3), ([2, 3], 0), ([2, 3], 1), ([9], 1), ([3], 3)]
    q = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(prompts)], "qid long, ids array<bigint>, cont long")
    for end in (False, True):
        want = {}
        for k, (g, t) in enumerate(prompts):
            nxt = [d[i + len(g)] if i + len(g) < len(d) else None for d in docs for i in range(len(d)) if d[i : i + len(g)] == g]
            want[k] = (len(nxt), sum(x == t or (end and t == 0 and x is None) for x in nxt))
        assert {x["qid"]: (x["prompt_cnt"], x["cont_cnt"]) for x in distribution.prob(c, q, end).collect()} == want
    one = Corpus(spark.range(4).selectExpr("0 AS shard", "id AS doc_id", "array_repeat(5L, 500) AS tokens", "'' AS metadata").coalesce(1))
    (_, n), = match.next_counts(one.docs, q.where("qid = 0").selectExpr("qid", "array(5L) AS ids"))
    assert sorted(x["cnt"] for x in n.collect()) == [4, 4 * 499]
    parts = one.docs.mapInArrow(match.scan.next_counts(spark.sparkContext.broadcast(match.Trie(match.pa.array([[5]])))), "u long, shard int, token long, cnt long")
    assert parts.count() == 2  # 2,000 matches


def test_terms_once_are_not_exchanged(spark):
    r, docs, c = _random_corpus(spark, 13)
    rows = [(0, 0, 0, [1]), (0, 0, 1, [1, 2]), (0, 1, 0, [2, 3]), (0, 1, 1, [2, 3]), (1, 0, 0, [3])]
    q = spark.createDataFrame(rows, "qid long, clause int, term int, ids array<bigint>")
    lay = {x["doc_id"]: x["doc_start"] for x in c.layout().collect()}

    def want(rows):
        out = {}
        for k, cl, t, g in rows:
            for d, x in enumerate(docs):
                for i in range(len(x)):
                    if x[i : i + len(g)] == g:
                        out[k, cl, d, lay[d] + 1 + i] = min(t, out.get((k, cl, d, lay[d] + 1 + i), 99))
        return out

    got = cnf.terms(c, q, dedupe=True)
    assert {(x["qid"], x["clause"], x["doc_id"], x["p"]): x["term"] for x in got.collect()} == want(rows) and got.count() == len(want(rows))
    assert "Exchange hashpartitioning" not in _exchanged(got, spark).split("Generate explode")[0]
    mixed = [(0, 0, 0, [1, 2]), (0, 0, 1, [1]), (0, 1, 0, [3])]  # the shorter one comes later
    got = cnf.terms(c, spark.createDataFrame(mixed, q.schema), dedupe=True).collect()
    assert {(x["qid"], x["clause"], x["doc_id"], x["p"]): x["term"] for x in got} == want(mixed) and len(got) == len(want(mixed))


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_near_clauses_by_document_and_by_block(spark, monkeypatch, block):
    """As with a row for each start, over the borders of documents and blocks."""
    monkeypatch.setattr(cnf, "BLOCK", block)
    r, docs, c = _random_corpus(spark, 14, most=7)
    rows = [(k, cl, t, [r.randrange(1, 4) for _ in range(r.randrange(1, 3))]) for k in range(12) for cl in range(k % 4 + 1) for t in range(r.randrange(1, 3))]
    rows += [(50, 0, 0, [1]), (50, 2, 0, [2])]  # clause 1 isn't there
    q = spark.createDataFrame(rows, "qid long, clause int, term int, ids array<bigint>")
    for far in (0, 2, 4):
        key = lambda x: (x["qid"], x["shard"], x["doc_id"], x["l"], x["r"])
        assert sorted(map(key, cnf.compat(c, q, far).collect())) == sorted(map(key, cnf.compat(c, q, far, 1 << 40).collect()))
        key = lambda x: (x["qid"], x["shard"], x["doc_id"], x["p"])
        assert sorted(map(key, cnf.strict(c, q, far).collect())) == sorted(map(key, cnf._strict_by_rows(c, q, far).collect()))
    assert "Window" not in _exchanged(cnf.strict(c, q, 2), spark)


def test_draws_put_few_occurrences_in_order(spark, monkeypatch):
    from tokenlode.operators import documents

    monkeypatch.setattr(documents, "BLOCK", 16)
    made = []
    monkeypatch.setattr(documents, "written", lambda df, label, w=documents.written: made.append(w(df, label)) or made[-1])
    r, docs, c = _random_corpus(spark, 15, docs=40, tokens=3)
    q = spark.createDataFrame([(0, [1]), (1, [2]), (2, [1, 2])], "qid long, ids array<bigint>")
    found = match.placed(c, q)
    by = {k: sorted((x["shard"], x["ptr"]) for x in found.collect() if x["qid"] == k) for k in range(3)}
    first = documents.first_k(found, 3).collect()
    assert sorted((x["qid"], x["idx"], x["shard"], x["ptr"], x["cnt"]) for x in first) == [(k, i, *by[k][i], len(by[k])) for k in range(3) for i in range(3)]
    drawn = documents.random_draws(found, 5, 7).collect()
    assert len(drawn) == 15 and all((x["shard"], x["ptr"]) == by[x["qid"]][x["idx"]] and x["cnt"] == len(by[x["qid"]]) for x in drawn)
    assert max(t.count() for t in made) < sum(map(len, by.values()))


@pytest.mark.parametrize("head", [(1 << 15,), (40, 90)])
def test_query_suite_counts_few_ngrams(spark, monkeypatch, head):
    """From the corpus's first positions, and for classes that these don't fill from those whose parts are frequent."""
    monkeypatch.setattr(stats, "HEAD", head)
    r = random.Random(16)
    docs = [[r.randrange(1, 4) if k % 3 else 7 for k in range(r.randrange(0, 30))] for _ in range(40)]
    c = Corpus.from_ids(spark, [docs])
    lengths = (1, 2, 3, 4, 8)
    first, cnt = {}, {}
    for d in docs:
        for i in range(len(d)):
            for n in lengths:
                if i + n <= len(d):
                    g = tuple(d[i : i + n])
                    first.setdefault(g, len(first))
                    cnt[g] = cnt.get(g, 0) + 1
    name = lambda n: next(b for b, lo, hi in stats.BUCKETS if lo <= n <= hi)
    want = {}
    for g in sorted(first, key=first.get):
        own = want.setdefault((len(g), name(cnt[g])), [])
        if len(own) < 3:
            own.append((g, cnt[g]))
    got = {}
    rows = stats.query_suite(c, 3, lengths).collect()
    for x in rows:
        got.setdefault((x["len"], x["bucket"]), set()).add((tuple(x["ids"]), x["cnt"]))
    assert got == {k: set(v) for k, v in want.items()} and len(rows) == sum(map(len, want.values()))


def test_frequent_ngrams_have_frequent_parts(spark):
    """Of all n-grams only those are exchanged whose parts are frequent."""
    c = Corpus.from_ids(spark, [[[1, 2, 3, 4, 10 + k, 500 + k, 900 + k] for k in range(30)]])
    docs = c.docs.select("doc_id", "tokens").coalesce(1)
    schema = "n int, h1 long, h2 long, cnt long, first struct<doc_id:bigint,pos:int>"
    one = [x for x in docs.mapInArrow(stats.scan.frequent((1,), 0, None), schema).collect() if x["cnt"] >= 20]
    bits = np.zeros(1 << 10, np.uint64)
    for x in one:
        h = np.uint64(x["h1"] & 0xFFFF)
        bits[int(h) >> 6] |= np.uint64(1) << (h & np.uint64(63))
    two = docs.mapInArrow(stats.scan.frequent((2, 3), 1, spark.sparkContext.broadcast(bits)), schema).collect()
    assert sorted((x["n"], x["cnt"], x["first"]["pos"]) for x in two if x["cnt"] > 1) == [(2, 30, 0), (2, 30, 1), (2, 30, 2), (3, 30, 0), (3, 30, 1)] and len(two) < 20  # 160 others


def test_suffixes_of_words_in_blocks_and_ranges(spark, monkeypatch):
    """Words that are longer than the key, begin alike or hold the bytes that end words; equal documents over many blocks."""
    from tokenlode.operators import suffix

    monkeypatch.setattr(suffix, "BLOCK", 16)
    monkeypatch.setattr(suffix, "RANGE", 32)
    asked = []
    monkeypatch.setattr(suffix, "discard", lambda spark, path, f=suffix.discard: asked.append(path) or f(spark, path))
    r = random.Random(17)
    words = ["a", "ab", "b", "ñu", "a" * 30, "a" * 30 + "b", "a" * 31, "a\x00", "a\x01b"]
    same = [r.choice(words) for _ in range(70)]
    docs = [same, [r.choice(words) for _ in range(20)], same, [], same, ["a"] * 40, [], same + ["b"], ["a"] * 40]
    rows = [(k % 2, k, t, "") for k, t in enumerate(docs)]
    c = Corpus(spark.createDataFrame(rows, "shard int, doc_id long, tokens array<string>, metadata string"))
    for first in (1, 24):
        got = stats.suffixes(c, first).collect()
        for s in (0, 1):
            own = [(k, t) for k, t in enumerate(docs) if k % 2 == s]
            stream = [t.encode() for _, d in own for t in ["\U0010ffff", *d]]
            at = [(k, p) for k, d in own for p in range(-1, len(d))]
            want = sorted(range(len(stream)), key=lambda i: stream[i:])
            assert [(x["doc_id"], x["pos"]) for x in sorted((x for x in got if x["shard"] == s), key=lambda x: x["rank"])] == [at[i] for i in want]
            assert sorted(x["rank"] for x in got if x["shard"] == s) == list(range(len(stream)))
    assert len(asked) < 14  # four ranks at once, not twice the length with each round
