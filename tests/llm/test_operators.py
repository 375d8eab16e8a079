"""Each operator on nulls, empty and repeated rows, empty tables and extra columns, and against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from tokenlode.llm import chat, exact_dedup, hilbert_ann, language_id, line_dedup, mixing, ngram_jaccard, pii, sentencepiece_wfst, sharding
from tokenlode.llm.common import scratch

SF = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, lang string, source string, n_chars long, place int, digest string, weight double"
LONG = "word " * 30_000
TEXTS = ["", None, "a b c d e f", "a b c d e f", "a b c d e g", LONG, "12.3.4.5 and a@b.example.org", "ß\u0000 日本 ퟿"]
ROWS = [(i, t, "en", "s", 1, 7, "x", 2.0) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f", None, None, None, 7, "x", 2.0), (2, "a b c d e f", "en", "s", 1, 7, "x", 2.0), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, COLS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sentencepiece(odd, none, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_wfst.MODEL)
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in sentencepiece_wfst.encode(docs).collect()}
    for r in rows:
        want = sp.encode(r["text"])
        assert got[r["doc_id"]]["ids"] == want and got[r["doc_id"]]["decoded"] == sp.decode(want)
    assert sentencepiece_wfst.encode(none).count() == 0
    odd_ = sentencepiece_wfst.encode(odd).collect()
    assert len(odd_) == len(ROWS) and sum(r["ids"] is None for r in odd_) == 2
    assert {r["doc_id"]: r["text"] for r in sentencepiece_wfst.decode(sentencepiece_wfst.encode(odd)).collect() if r["doc_id"] is not None}[0] == ""


def test_sentencepiece_memory(monkeypatch):
    """What a worker remembers of 400,000 words is small; words that recur all the time are encoded once."""
    import tracemalloc

    t = sentencepiece_wfst.Transducer(sentencepiece_wfst.MODEL)
    words_ = ["".join(x) for x in itertools.product("etaoinshrdlucmfwypvbgkqjxz", repeat=4)][:400_000]
    tracemalloc.start()
    for k in range(0, len(words_), 2000):
        t.encode([" ".join(words_[k : k + 2000])])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 70e6, held
    monkeypatch.setattr(sentencepiece_wfst, "WORDS", 100)
    t, often = sentencepiece_wfst.Transducer(sentencepiece_wfst.MODEL), []
    encode_words = t.encode_words
    monkeypatch.setattr(t, "encode_words", lambda ws: (often.extend(w for w in ws if w == " the"), encode_words(ws)))
    for k in range(0, 4000, 40):
        t.encode(["the " + " ".join(words_[k : k + 40])])
    assert len(often) == 1


@pytest.mark.parametrize("kind", [1, 2])
def test_sentencepiece_without_byte_fallback(tmp_path, kind):
    """Models written by hand: runs of unknown characters are one piece, as in the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.unk_id = kind, 0
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = True
    pieces = ["<unk>", "<s>", "</s>", "▁", "a", "b", "c", "ab", "▁a", "bc", "▁ab", "abc", "."]
    for k, x in enumerate(pieces):
        m.pieces.add(piece=x, score=-(k**1.37) / 2, type=2 if k == 0 else 3 if k < 3 else 1)
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    sp, ours = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_wfst.Transducer(str(path))
    rng = np.random.default_rng(kind)
    texts = ["".join(rng.choice(list("abc .xé日"), rng.integers(0, 14))) for _ in range(400)]
    got = [np.frombuffer(x, "<i4") for x in ours.encode(texts)]
    assert [list(x) for x in got] == sp.encode(texts)
    assert [ours.decode(x) for x in got] == [sp.decode(x.tolist()) for x in got]


def test_exact_dedup(spark, odd, none):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "i"))
    kept = exact_dedup.exact_dedup(odd, index)
    assert kept.columns == odd.columns
    texts = Counter(r["text"] for r in kept.collect())
    assert texts.pop(None) == 2 and set(texts.values()) == {1} and len(texts) == 6
    assert exact_dedup.exact_dedup(odd.where("text IS NOT NULL"), index).count() == 0  # all are known by now
    index.compact()
    assert len(index.generations()) == 1 and index.all().count() == 6
    assert exact_dedup.exact_dedup_ids(none, exact_dedup.DigestIndex(spark, scratch(spark, "i"))).count() == 0


def test_sharding(spark, odd, none):
    got = sharding.shard(odd, 3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [3, 4, 4] and len(got[0]) == len(COLS.split(",")) + 2
    assert sharding.shard(none, 3).count() == 0
    many = sharding.shard(spark.range(1000), 7, part=64).collect()
    assert {r["id"] for r in many} == set(range(1000)) and set(Counter(r["shard"] for r in many).values()) == {142, 143}
    assert sharding.shard(spark.createDataFrame([(1, 2, 3)] * 5, "shard int, Place int, x int"), 2).columns == ["shard", "place", "_shard", "_Place", "x"]
    assert all(sorted(r["place"] for r in many if r["shard"] == k) == list(range(sum(r["shard"] == k for r in many))) for k in range(7))
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 4e5) < 150


def test_sharding_is_uniform():
    """Two parts of 2 and 3 rows over shards of 2, 2 and 1: the matrix has the law that enumerating all arrangements gives."""
    law = Counter(tuple(Counter(x[:2])[k] for k in range(3)) for x in itertools.permutations([0, 0, 1, 1, 2]))
    n = 4000
    rows = Counter(tuple(int(x) for x in sharding.Matrix(np.array([2, 3]), np.array([2, 2, 1]), seed).row(0)) for seed in range(n))
    assert set(rows) <= set(law)
    chi = sum((rows[k] - n * law[k] / 120) ** 2 / (n * law[k] / 120) for k in law)
    assert chi < 20.5  # the 0.999 quantile of 5 degrees of freedom
    both = [sharding.Matrix(np.array([2, 3]), np.array([2, 2, 1]), 7).row(k) for k in range(2)]
    assert list(sum(both)) == [2, 2, 1] and [x.sum() for x in both] == [2, 3]


def test_sharding_of_rows_is_uniform(spark, tmp_path):
    """Where the first of 6 rows goes, over seeds."""
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "r"))
    at = Counter(next((r["shard"], r["place"]) for r in sharding.shard_paths(spark, str(tmp_path / "r"), 2, seed, part=4).collect() if r["id"] == 0) for seed in range(8))
    assert len(at) >= 3


def brute_jaccard(rows, n=3, t=0.5):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        s = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        sets[i] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def brute_classes(docs, n=3, t=0.5):
    """(id, class, links, copies) of each different (id, set)."""
    of = lambda text: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := text.lower().split()) else frozenset()
    v = sorted({(i, of(x)) for i, x in docs if i is not None and x is not None}, key=lambda x: (x[0], sorted(x[1])))
    near = lambda a, b: bool(a) and bool(b) and len(a & b) / len(a | b) >= t
    link = {k: {m for m in range(len(v)) if m != k and near(v[k][1], v[m][1])} for k in range(len(v))}
    out = []
    for k, (i, s) in enumerate(v):
        seen, todo = {k}, [k]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, min(v[m][0] for m in seen), len({v[m][1] for m in link[k]} - {s}), sum(v[m][1] == s for m in link[k])))
    return sorted(out)


def classes(df):
    return sorted(map(tuple, df.select("doc_id", "class_id", "n_links", "n_copies").collect()))


def test_ngram_jaccard(spark, odd, none, docs):
    rows = docs.select("doc_id", "text").collect()
    first = {}
    for i, text in sorted(rows):
        first.setdefault(frozenset(zip(*[(text.lower().split() + [None, None])[k:] for k in range(3)])), i)
    ids = set(first.values())
    assert {(r["doc_a"], r["doc_b"]) for r in ngram_jaccard.pairs(docs).collect()} == {(a, b) for a, b in brute_jaccard(rows) if a in ids and b in ids}
    assert classes(ngram_jaccard.jaccard_join(docs)) == brute_classes(rows)
    assert classes(ngram_jaccard.jaccard_join(odd)) == brute_classes([(r[0], r[1]) for r in ROWS])
    assert ngram_jaccard.jaccard_join(none).count() == 0 and ngram_jaccard.pairs(none).count() == 0
    kept = ngram_jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 2, 5, 6, 7]
    assert ngram_jaccard.keep_one(none).count() == 0
    at = ngram_jaccard.edges(np.array([100] + [0] * 5 + [50, 50] + [0] * 56), 4)
    assert len(at) == 3 and list(np.searchsorted(at, np.array([0, 7 << 58], np.uint64), "right")) == [0, 3]


def test_ngram_jaccard_in_many_parts(spark, monkeypatch):
    """Small limits, so that there are many fragments, blocks, groups and rounds of components."""
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 400, 40)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(base[i % 6])
        for k in rng.integers(0, 40, rng.integers(0, 8)):
            w[k] = f"x{rng.integers(0, 2000)}"
        rows.append((i, " ".join(w)))
    for name, v in (("ENTRIES", 300), ("BLOCK", 16), ("GROUP", 60), ("EDGES", 40)):
        monkeypatch.setattr(ngram_jaccard, name, v)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(ngram_jaccard.jaccard_join(d)) == brute_classes(rows)


def test_ngram_jaccard_groups(spark, monkeypatch):
    """Small limits, so that some near copies are in groups of many blocks, some in none, and some linked across groups; equal sets, sizes apart, ids shared."""
    rng = np.random.default_rng(6)
    base = [[f"w{x}" for x in rng.integers(0, 400, 40)] for _ in range(4)]
    rows = []
    for i in range(160):
        w = list(base[i % 4])
        for k in rng.integers(0, 40, rng.integers(0, 8)):
            w[k] = f"x{rng.integers(0, 2000)}"
        w = w[: rng.integers(15, 41)] if i % 5 == 0 else w + base[(i + 1) % 4][:30] if i % 7 == 0 else w
        rows.append((i, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[4][1]), (4, rows[4][1]), (202, "alone in all of this"), (None, rows[5][1])]
    for name, v in (("HOT", 12), ("ROWS", 8), ("MEET", 300), ("ENTRIES", 300), ("BLOCK", 16), ("GROUP", 60), ("EDGES", 40)):
        monkeypatch.setattr(ngram_jaccard, name, v)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert classes(ngram_jaccard.jaccard_join(d)) == want
    assert sorted({r["doc_id"] for r in ngram_jaccard.keep_one(d.where("doc_id is not null and doc_id not in (3, 4)")).collect()}) == sorted({c for _, c, _, _ in brute_classes([r for r in rows if r[0] not in (None, 3, 4)])})
    one = {}
    for i, text in sorted((i, x) for i, x in rows if i is not None and i not in (3, 4)):
        one.setdefault(text, i)
    one = {i: text for text, i in one.items()}
    got = [(r["doc_a"], r["doc_b"]) for r in ngram_jaccard.pairs(d.where("doc_id not in (3, 4)")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_jaccard(one.items())


def test_ngram_jaccard_many_near_copies_are_not_paired(spark):
    """400 near copies: no pair of them is written as a candidate, all links are counted."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 + 1 :])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert (ngram_jaccard.Join(d).candidates().selectExpr("sum(n)").first()[0] or 0) < 400
    assert classes(ngram_jaccard.jaccard_join(d)) == [(i, 0, 399, 0) for i in range(400)]


def test_ngram_jaccard_passage_of_words_beyond_known(spark, monkeypatch):
    """A passage in 300 texts that have nothing else in common makes no group of them, however few words KNOWN takes."""
    monkeypatch.setattr(ngram_jaccard, "KNOWN", 5)
    passage = [f"p{k}" for k in range(15)]
    rows = [(i, " ".join([f"x{i}y{k}" for k in range(40)] + passage)) for i in range(300)] + [(300, " ".join(["other", *(f"x7y{k}" for k in range(40)), *passage]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    j = ngram_jaccard.Join(d)
    assert len(j.known.value[0]) == 15
    assert (j.candidates().selectExpr("sum(n)").first()[0], j.groups) == (1, None)
    assert classes(ngram_jaccard.jaccard_join(d)) == [(i, 7 if i == 300 else i, int(i in (7, 300)), 0) for i in range(301)]


def test_ngram_jaccard_ids_shared(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b + " eleven"), (None, a)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in ngram_jaccard.keep_one(d).collect()) == [(0, a), (1, a), (5, b)]
    assert classes(ngram_jaccard.jaccard_join(d)) == [(1, 1, 0, 1), (5, 1, 0, 1), (5, 5, 1, 0), (7, 5, 1, 0)]


def test_line_dedup(spark, odd, none):
    d = spark.createDataFrame([(i, f"own line {i} {'x' * i}\nPage {i} of 90 copyright notice here\nbody{i} text{i}") for i in range(12)], "doc_id long, text string")
    got = line_dedup.line_dedup(d).collect()
    assert all("copyright" not in r["text"] and r["n_dropped"] == 1 for r in got)
    t = {r["template"] for r in line_dedup.templates(d).collect()}
    assert t == {"Page <*> of <*> copyright notice here"}
    assert line_dedup.line_dedup(none).count() == 0
    got = line_dedup.line_dedup(odd)
    assert got.columns == ["doc_id", "text", "n_dropped"] and sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(r[0]), str(r[1])) for r in ROWS)


def test_line_dedup_passages(spark):
    """A long line in two texts stays in the first; copies of that text keep it as well."""
    p = " ".join(f"p{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" for k in range(60))
    d = spark.createDataFrame([(4, f"a\n {p}\t\nb"), (2, f"c\n{p}"), (3, f"c\n{p}"), (5, p), (6, p[:40]), (7, p[:40]), (None, f"d\n{p}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(d).collect()}
    assert got == {4: ("a\nb", 1), 2: (f"c\n{p}", 0), 3: (f"c\n{p}", 0), 5: ("", 1), 6: (p[:40], 0), 7: (p[:40], 0), None: ("d", 1)}


def test_mixing(spark, odd, none):
    d = spark.createDataFrame([(i, "w " * 10, "a" if i < 30 else "b") for i in range(40)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    by = Counter()
    for r in got:
        by[r["source"]] += r["n_tokens"] * r["copies"]
    assert by == {"a": 200, "b": 200}
    assert mixing.mix_rows(d).count() == 40
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(odd).columns == odd.columns
    assert sorted(r["n_tokens"] for r in mixing.mix(odd).collect()) == sorted(brute_mix([(r[0], r[1], r[3]) for r in ROWS], {}, "n"))


def brute_mix(rows, weight, what="rows"):
    """Copies of each row (id, text, source), in plain loops; what "n": the tokens of those taken."""
    by, out = {}, []
    for i, text, source in rows:
        tie = hashlib.md5((text or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"{mixing.SEED}|{'null' if i is None else i}|{tie}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        by.setdefault(source or "", []).append((-math.log(u) / weight.get(i, 1.0), -1 if i is None else i, tie, len(re.findall(r"[^ \t\n\r]+", text or "")), (i, text)))
    total = sum(r[3] for rs in by.values() for r in rs)
    full = [s for s, rs in by.items() if sum(r[3] for r in rs)]
    for s, rs in by.items():
        held = sum(r[3] for r in rs)
        epochs, rest = divmod(total // len(full), held) if held else (1, -1)
        rs.sort(key=lambda r: r[:3])
        for r in rs:
            upto = sum(x[3] for x in rs if x[:3] <= r[:3])  # rows that tie go together
            copies = epochs + (upto <= rest)
            out += [r[3]] * (copies > 0) if what == "n" else [r[4]] * copies
    return out


def test_mixing_without_tokens(spark):
    d = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "x y", "b"), (4, "", "b"), (3, "x y", None)], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["source"], r["copies"]) for r in mixing.mix(d).collect()}
    assert {x for x in got if x[1] == "a"} == {(1, "a", 1), (2, "a", 1)} and (3, "b", 1) in got and (3, "", 1) in got
    assert mixing.mix(d, shares={"b": 1.0}).where("source <> 'b'").count() == 0
    labels = spark.createDataFrame([(3, 1, 9), (3, 0, 9), (None, 1, 9), (4, None, 9)], "doc_id long, quality int, weight int")
    assert mixing.weights(d, labels).collect() == [(3, 2.0)]


def test_chat(spark):
    t = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "User ", "hi"), (2, 1, "assistant", "<|x"), (3, 0, "user", "hi"), (3, 1, "assistant", "<|x"), (None, 0, "user", "z"), (4, None, None, None), (4, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(t).collect()}
    assert set(got) == {2, 4} and got[2]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n< |x<|im_end|>\n" and got[4]["n_turns"] == 1
    assert chat.format_chats(t.limit(0)).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(900, None, "e"), (None, x[0].tolist(), "e"), (901, [0.0] * 16, "e"), (902, [1.0], "e")]
    got = hilbert_ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"), k=5, block=64, halo=32).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-s[i])[:5]}
    assert len(want & {(r["vec_id"], r["neighbour"]) for r in got}) / len(want) >= 0.9
    assert hilbert_ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd_ = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [1.0, 0.1]), (-4, [0.0, 2.0]), (3, [1.0, 0.1])]
    few = hilbert_ann.neighbours(spark.createDataFrame([(*r, 1, 2) for r in odd_], "vec_id long, embedding array<float>, similarity int, id int"), every=2).collect()
    assert {(r["vec_id"], r["rank"], r["neighbour"]) for r in few} == {(0, 1, -4), (0, 2, 3), (-4, 1, 0), (-4, 2, 3)}  # of rows with an id the least vector counts


def test_ann_windows_grow(spark):
    x = np.random.default_rng(3).standard_normal((6000, 64)).astype(np.float32)
    got = hilbert_ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), block=32, halo=16, every=10).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(0, 6000, 10) for j in np.argpartition(-s[i], 10)[:10]}
    assert len(got) == 6000 and len(want & {(r["vec_id"], r["neighbour"]) for r in got}) / len(want) >= 0.9


def test_ann_ties(spark):
    # all similarities among the first 100 round to 1, though those of greater ids are nearer to each other
    rows = [(i, [1.0, 0.0025 * (1 - i / 100), *[0.0] * 14]) for i in range(100)] + [(100 + i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).standard_normal((100, 16)))]
    got = hilbert_ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), curves=1).where("vec_id < 100").collect()
    by = {i: [r["neighbour"] for r in sorted(got, key=lambda r: r["rank"]) if r["vec_id"] == i] for i in range(100)}
    assert all(n == [j for j in range(11) if j != i][:10] for i, n in by.items())


def test_language_id(odd, none, docs):
    known = [r for r in docs.select("doc_id", "text", "lang").collect() if r["lang"] and len(r["text"].split()) > 20]
    fit = language_id.fit([r["text"] for r in known[::2]], [r["lang"] for r in known[::2]])
    right = [fit.decode(*language_id.features(r["text"]))[0] == r["lang"] for r in known[1::2]]
    assert np.mean(right) >= 0.95
    assert language_id.language_id(none).count() == 0 and language_id.keep_known(none).count() == 0
    got = language_id.predict(odd, fit).collect()
    assert len(got) == len(ROWS) and sum(r["language"] is None and r["ambiguous"] for r in got) == 3


def test_language_id_decoding(docs):
    """Decoding against plain loops, for codewords of few and of many languages."""
    known = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect() if r["lang"] and len(r["text"].split()) > 20]
    fit = language_id.fit(*map(list, zip(*known[::2])))
    for text, _ in known[1::20] + [("", ""), ("a", ""), ("12 34", "")]:
        x, letters = language_id.features(text)
        losses = []
        for k in range(len(fit.languages)):
            total = sum(float(w) * math.log1p(math.exp(-float(c) * max(-30.0, min(30.0, float(x @ fit.weights[:, j]) + float(fit.bias[j]))))) for j, (c, w) in enumerate(zip(fit.code[k], fit.loss_weights)))
            losses.append(total / float(fit.loss_weights.sum()))
        order = sorted(range(len(losses)), key=lambda k: losses[k])
        got = fit.decode(x, letters)
        if not letters:
            assert got == (None, 1.0, 0.0, True)
            continue
        margin = losses[order[1]] - losses[order[0]]
        assert got[0] == fit.languages[order[0]] and abs(got[1] - losses[order[0]]) < 1e-4 and abs(got[2] - margin) < 1e-4
        assert got[3] == (margin < fit.min_margin or letters < fit.min_letters) or abs(margin - fit.min_margin) < 1e-4
    many = language_id.codewords(12)
    assert len({tuple(r) for r in many}) == 12 and min(int((a != b).sum()) for a, b in itertools.combinations(many, 2)) >= 10
    tie = language_id.Model(["a", "b"], np.array([[1], [-1]], np.float32), np.zeros((len(language_id.ORDERS) * language_id.BUCKETS, 1)), np.zeros(1), np.ones(1))
    assert tie.decode(*language_id.features("words"))[0] == "a" and tie.decode(*language_id.features("words"))[2:] == (0.0, True)


def test_pii_against_plain_search(docs):
    """An independent finder over whole texts: whatever it finds is replaced, each value always alike, and all else stays."""
    c = pii.Cipher("k")
    seen = {}
    for r in docs.select("text").collect():
        new, _ = pii.replace(r["text"], c)
        old_words, new_words = r["text"].split(), new.split()
        assert len(old_words) == len(new_words)
        for a, b in zip(old_words, new_words):
            d = a.strip('".,;')
            card = d.isdigit() and 13 <= len(d) <= 19
            good = card and sum(int(x) if k % 2 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(d[::-1], 1)) % 10 == 0
            address = len(d.split(".")) == 4 and all(x.isdigit() and int(x) < 256 and str(int(x)) == x for x in d.split("."))
            if good or address:
                assert a != b and seen.setdefault(d, b.strip('".,;')) == b.strip('".,;')
                assert len(d) == len(b.strip('".,;')) or address
            elif card or (d.isalpha() and len(d) < 30):
                assert a == b


@pytest.mark.parametrize("text", ["9807915762804490", "256.1.1.1", "2024-04-31", "900-12-3456", "DE00 3704 0044 0532 0130 00", "a@b", "abcdef", "1234", "deadbeef"])
def test_pii_leaves_what_is_not_valid(text):
    assert pii.replace(f"x {text} y", pii.Cipher("k")) == (f"x {text} y", {})


def test_pii_columns(spark):
    got = pii.pseudonymise(spark.createDataFrame([("a@b.example.org", 1)], "text string, PII int"))
    assert got.columns == ["text", "_PII", "pii"] and got.first()["pii"] == {"email": 1}


def test_pii(odd, none, docs):
    texts = [r["text"] for r in docs.select("text").collect()]
    c = pii.Cipher("k")
    assert all(pii.replace(pii.replace(t, c)[0], c, back=True)[0] == t for t in texts)
    got = pii.pseudonymise(odd)
    assert got.columns == [*odd.columns, "pii"] and got.count() == len(ROWS) and pii.pseudonymise(none).count() == 0
    a, b, e = pii.replace("4111 1111 1111 1111 or 4111111111111111 or 7 4111 1111 1111 1111", c)[0].split(" or ")
    assert a.replace(" ", "") == b and pii.luhn(b) and b != "4111111111111111" and e == f"7 {a}"
    t = pii.replace("at 2024-01-15T10:00:00Z", c)[0]
    assert t != "at 2024-01-15T10:00:00Z" and t.endswith("T10:00:00Z") and pii.replace(t, c, back=True)[0] == "at 2024-01-15T10:00:00Z"


def test_pipeline(spark):
    """Against the stages in plain loops, and the library's encoder."""
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(*language_id.sample(docs, 300))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["text"] and not model.decode(*language_id.features(r["text"]))[3]]
    texts = {}
    for r in sorted(rows):
        texts.setdefault(r[1], r)
    of = {i: c for i, c, _, _ in brute_classes([r[:2] for r in texts.values()])}
    rows = [r for r in texts.values() if of[r[0]] == r[0]]
    best = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").collect():
        best[r["doc_id"]] = max(best.get(r["doc_id"], 0), r["quality"])
    want = brute_mix(rows, {i: mixing.GOOD if q else mixing.POOR for i, q in best.items()})
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_wfst.MODEL)
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_ids", "decoded"]
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in out.collect()) == sorted((i, x, sp.decode(x)) for i, x in ((i, sp.encode(t)) for i, t in want))


def test_pipeline_on_odd_tables(spark, tmp_path, odd, none):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, d in (("odd", odd), ("none", none)):
        at = tmp_path / name
        d.write.parquet(str(at / "documents.parquet"))
        (at / "labels.parquet").symlink_to(tmp_path / "labels.parquet")
        got = corpus_pipeline.run(spark, str(at)).collect()
        assert len(got) <= len(ROWS) and (name == "odd" or not got)


@pytest.mark.parametrize("few", [0, 500])
def test_ngram_jaccard_small_sets_take_no_step_each(monkeypatch, few):
    monkeypatch.setattr(ngram_jaccard, "FEW", few)

    class Marks(np.ndarray):
        steps = 0

        def __setitem__(self, *x):
            Marks.steps += 1
            super().__setitem__(*x)

    r = np.random.default_rng(3)
    own = [np.sort(r.choice(40, r.integers(0, 5), replace=False)) for _ in range(300)] + [np.arange(40)] * 3
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    a = np.sort(r.integers(0, 304, 2000))  # 303 stands for sets that the fragment hasn't
    b = r.integers(0, 304, 2000)
    size = lambda x: own[x] if x < 303 else own[0][:0]
    got = ngram_jaccard._shared(np.concatenate(own).astype(np.int32), first, np.zeros(41, bool).view(Marks), a, b)
    assert got.tolist() == [len(np.intersect1d(size(x), size(y))) for x, y in zip(a, b)]
    assert Marks.steps == 0 if few else Marks.steps > 300
