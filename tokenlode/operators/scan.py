"""Sequences of tokens looked for from every position of many documents at once.

The sequences are a trie, which is sent to every task. A task numbers the tokens of a stretch of documents as the trie does,
and follows it from all positions together, one token further with each step; what is compared is numbers, so matches are exact.
Documents stay where they are read: what leaves the task is matches, their counts, or what is near them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are taken at a time.
STRETCH = 1 << 20
_NONE = np.zeros(0, np.int64)


class Trie:
    """Different sequences of one token or more. Nodes are numbered level by level; ends has the number of the sequence that ends at a node, or -1."""

    def __init__(self, seqs: pa.Array):
        seqs = seqs.combine_chunks() if isinstance(seqs, pa.ChunkedArray) else seqs
        flat, self.lengths = seqs.flatten(), seqs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocab = flat.unique()
        codes = pc.index_in(flat, self.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(self.lengths) - self.lengths
        self.keys, self.first, self.paths, self.size = [], [], [], 0
        node, live = np.zeros(len(seqs), np.int64), np.arange(len(seqs))
        while len(live):
            uniq, node[live] = np.unique(node[live] * len(self.vocab) + codes[first[live] + len(self.keys)], return_inverse=True)
            self.keys.append(uniq)
            self.first.append(self.size)
            self.paths.append((live, self.size + node[live]))
            self.size += len(uniq)
            live = live[self.lengths[live] > len(self.keys)]
        self.ends = np.full(self.size, -1, np.int64)
        for k, (seq, at) in enumerate(self.paths):
            own = self.lengths[seq] == k + 1
            self.ends[at[own]] = seq[own]
        self.start = np.full(len(self.vocab) + 1, -1, np.int64)  # the last for tokens that aren't known
        if self.keys:
            self.start[self.keys[0]] = np.arange(len(self.keys[0]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "paths"}

    def walk(self, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, nodes) for each length, of the places of at from which so many tokens match."""
        node = self.start[codes[at]]
        at, node = at[node >= 0], node[node >= 0]
        for k, (keys, first) in enumerate(zip(self.keys, self.first)):
            if k:
                code = codes[at + k]
                at, key = at[code >= 0], (node * len(self.vocab) + code)[code >= 0]
                node = np.searchsorted(keys, key)
                node[node == len(keys)] = 0
                ok = keys[node] == key
                at, node = at[ok], node[ok]
            if not len(at):
                return
            yield at, first + node

    def hits(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, sequences) of all matches."""
        places, seqs = [_NONE], [_NONE]
        for p, node in self.walk(codes, at):
            seq = self.ends[node]
            places.append(p[seq >= 0])
            seqs.append(seq[seq >= 0])
        return np.concatenate(places), np.concatenate(seqs)


class Stretch:
    """Documents one behind the other, each with a place behind its last token that is no token's (code -1)."""

    def __init__(self, rows: pa.RecordBatch, vocab: pa.Array, skip: object = None):
        lists = rows.column("tokens")
        self.rows, self.values = rows, lists.flatten()
        self.size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = np.cumsum(self.size) - self.size
        self.first = self.flat + np.arange(len(self.size))
        self.doc = np.repeat(np.arange(len(self.size)), self.size + 1)
        values = self.values if vocab.type == self.values.type else self.values.cast(vocab.type)
        self.codes = np.full(len(self.doc), -1, np.int64)
        self.codes[np.arange(len(self.values)) + np.repeat(np.arange(len(self.size)), self.size)] = pc.fill_null(pc.index_in(values, vocab), -1).to_numpy(zero_copy_only=False)
        if "own" in rows.schema.names:
            own = rows.column("own").to_numpy(zero_copy_only=False)
            self.at = np.flatnonzero(np.arange(len(self.doc)) - self.first[self.doc] < own[self.doc])
        else:
            self.at = np.arange(len(self.doc))

    def pos(self, places: np.ndarray) -> np.ndarray:
        return places - self.first[self.doc[places]]

    def behind(self, places: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each place how many tokens, most at most, follow its next n in the document, and where the first is among values."""
        doc = self.doc[places]
        pos = places - self.first[doc] + n
        return np.clip(self.size[doc] - pos, 0, most), self.flat[doc] + pos


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about STRETCH tokens."""
    for b in batches:
        upto = np.cumsum(b.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(upto):
            e = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STRETCH, "right")))
            yield b.slice(a, e - a)
            a = e


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, .. n[k] numbers, for each k."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


def rows(trie, after: int) -> Callable:
    """(u, shard, doc_id, pos, next) of each match; next only where after is more than 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in stretches(batches):
            s = Stretch(b, t.vocab)
            at, u = t.hits(s.codes, s.at)
            doc = pa.array(s.doc[at])
            out = {"u": pa.array(u), "shard": b.column("shard").take(doc), "doc_id": b.column("doc_id").take(doc), "pos": pa.array(s.pos(at).astype(np.int32))}
            if after:
                n, first = s.behind(at, t.lengths[u], after)
                out["next"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), s.values.take(pa.array(_ranges(first, n))))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _lists(b: pa.RecordBatch, s: Stretch, at: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """(shard, doc_id, hits) of the documents with places: number << 32 | pos of each."""
    order = np.argsort(at, kind="stable")
    at, number = at[order], number[order]
    doc, n = np.unique(s.doc[at], return_counts=True)
    hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(number << 32 | s.pos(at)))
    doc = pa.array(doc)
    return pa.RecordBatch.from_pydict({"shard": b.column("shard").take(doc), "doc_id": b.column("doc_id").take(doc), "hits": hits})


def by_document(trie) -> Callable:
    """(shard, doc_id, hits): a row for each document with matches, sequence << 32 | pos each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in stretches(batches):
            s = Stretch(b, t.vocab)
            at, u = t.hits(s.codes, s.at)
            yield _lists(b, s, at, u)

    return run


def next_counts(trie, shards: bool = False, follow: bool = True) -> Callable:
    """(u, shard, token, cnt): how often each sequence has each next token, null at the end of a document; null throughout without follow, and shard without shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in stretches(batches):
            s = Stretch(b, t.vocab)
            at, u = t.hits(s.codes, s.at)
            code, tokens = np.zeros(len(at), np.int64), s.values.slice(0, 0)
            if follow:
                n, first = s.behind(at, t.lengths[u], 1)
                coded = s.values.take(pa.array(first[n > 0])).dictionary_encode()
                tokens = coded.dictionary
                code[n > 0] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
            shard = b.column("shard").to_numpy(zero_copy_only=False).astype(np.int64)[s.doc[at]] if shards else np.zeros(len(at), np.int64)
            low = shard.min(initial=1 << 40)
            key, cnt = np.unique(((shard - low) * len(t.lengths) + u) * (len(tokens) + 1) + code, return_counts=True)
            code, key = key % (len(tokens) + 1), key // (len(tokens) + 1)
            token = tokens.take(pa.array(code - 1, mask=code == 0))
            shard = pa.array((key // len(t.lengths) + low).astype(np.int32)) if shards else pa.nulls(len(key), pa.int32())
            yield pa.RecordBatch.from_pydict({"u": pa.array(key % len(t.lengths)), "shard": shard, "token": token, "cnt": pa.array(cnt)})

    return run


def node_counts(trie) -> Callable:
    """(node, cnt): from how many positions each node is reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        n = np.zeros(t.size, np.int64)
        for b in stretches(batches):
            s = Stretch(b, t.vocab)
            for _, node in t.walk(s.codes, s.at):
                n[: node.max() + 1] += np.bincount(node)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"node": pa.array(some), "cnt": pa.array(n[some])})

    return run


class Clauses:
    """Of queries numbered k the sequences u of each clause's terms: rows (k, clause, u), clause 0 first."""

    def __init__(self, k: np.ndarray, clause: np.ndarray, u: np.ndarray):
        order = np.lexsort((u, clause, k))
        self.k, self.clause, self.u = k[order], clause[order], u[order]
        self.queries, self.most = int(k.max(initial=-1)) + 1, int(clause.max(initial=-1)) + 1
        cell = self.k * self.most + self.clause
        self.many = np.bincount(cell, minlength=self.queries * self.most)
        self.first = np.cumsum(self.many) - self.many

    def whole(self) -> np.ndarray:
        """Whether a query has all clauses up to its last."""
        return (self.many.reshape(self.queries, self.most) > 0).sum(1) == self.size()

    def size(self) -> np.ndarray:
        """How many clauses a query has, by its last."""
        out = np.zeros(self.queries, np.int64)
        np.maximum.at(out, self.k, self.clause + 1)
        return out

    def slots(self, k: np.ndarray, clause: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(where, u): one term after the other of the clause of each k."""
        cell = k * self.most + clause
        for j in range(int(self.many[cell].max(initial=0))):
            at = np.flatnonzero(self.many[cell] > j)
            yield at, self.u[self.first[cell[at]] + j]


class Rows:
    """Numbers by sequence: those of a sequence's rows, for many sequences at once."""

    def __init__(self, u: np.ndarray, value: np.ndarray):
        order = np.argsort(u, kind="stable")
        self.value = value[order]
        self.many = np.bincount(u, minlength=1)
        self.first = np.cumsum(self.many) - self.many

    def each(self, at: np.ndarray, u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, values) of the rows of all u, about STRETCH at a time."""
        keep = u < len(self.many)
        at, u = at[keep], u[keep]
        n = self.many[u]
        at, u, n = at[n > 0], u[n > 0], n[n > 0]
        upto, a = np.cumsum(n), 0
        while a < len(at):
            e = max(a + 1, int(np.searchsorted(upto, upto[a] - n[a] + STRETCH, "right")))
            yield np.repeat(at[a:e], n[a:e]), self.value[_ranges(self.first[u[a:e]], n[a:e])]
            a = e


class Places:
    """Matches by sequence and place, to ask which is the next one from a place on."""

    def __init__(self, at: np.ndarray, u: np.ndarray):
        self.low = int(at.min(initial=0))
        self.span = int(at.max(initial=0)) - self.low + 2
        self.key = np.append(np.sort(u * self.span + (at - self.low)), np.iinfo(np.int64).max)

    def from_(self, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first place at or behind each of at; a very large number if there is none."""
        low = np.clip(at - self.low, 0, self.span - 1)
        key = self.key[np.searchsorted(self.key, u * self.span + low)]
        return np.where(key < (u + 1) * self.span, key - u * self.span + self.low, FAR)

    def before(self, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last place before each of at; a very small number if there is none."""
        low = np.clip(at - self.low, 0, self.span - 1)
        k = np.searchsorted(self.key, u * self.span + low) - 1
        key = self.key[k]
        return np.where((k >= 0) & (key >= u * self.span), key - u * self.span + self.low, -FAR)


#: No place.
FAR = 1 << 62


def near(sent, most: int) -> Callable:
    """(shard, doc_id, hits): query << 32 | pos of each match of a first clause's term with one of each other clause, most tokens away at most, in the same document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c, size, heads = sent.value
        for b in stretches(batches):
            s = Stretch(b, t.vocab)
            at, u = t.hits(s.codes, s.at)
            places, got_at, got_k = Places(at, u), [_NONE], [_NONE]
            for p, k in heads.each(at, u):
                first = s.first[s.doc[p]]
                lo, hi = np.maximum(p - most, first), np.minimum(p + most, first + s.size[s.doc[p]])
                for clause in range(1, c.most):
                    ok = size[k] <= clause
                    for some, of in c.slots(k, np.full(len(k), clause)):
                        ok[some] |= places.from_(of, lo[some]) <= hi[some]
                    p, k, lo, hi = p[ok], k[ok], lo[ok], hi[ok]
                got_at.append(p)
                got_k.append(k)
            yield _lists(b, s, np.concatenate(got_at), np.concatenate(got_k))

    return run


def windows(sent, most: int, block: int) -> Callable:
    """Of a block of a shard with rows (shard, block, doc_start, doc_id, hits) the windows (k, shard, doc_id, l, r) that start in it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        c, plan = sent.value
        shard, blk = (x.as_py() for x in key)
        start, doc_id = table["doc_start"].to_numpy(), table["doc_id"].to_numpy()
        order = np.argsort(start)
        many = table["hits"].combine_chunks().value_lengths().to_numpy()
        hits = table["hits"].combine_chunks().flatten().to_numpy()
        at, u = (hits & 0xFFFFFFFF) + np.repeat(start, many) + 1, hits >> 32
        reach = most * max(1, c.most - 1)
        ok = (at >= blk * block - reach) & (at < (blk + 1) * block + reach)
        at, u = at[ok], u[ok]
        places, out = Places(at, u), []
        own = (at >= blk * block) & (at < (blk + 1) * block)
        steps, heads = plan[shard] if shard in plan else (None, Rows(_NONE, _NONE))
        for p, k in heads.each(at[own], u[own]):
            l, r = p.copy(), p.copy()
            for step in range(1, c.most):
                clause = steps[k, step]
                pl, pr = np.full(len(k), -FAR), np.full(len(k), FAR)
                going = np.flatnonzero(clause >= 0)
                for some, of in c.slots(k[going], clause[going]):
                    some = going[some]
                    pl[some] = np.maximum(pl[some], places.before(of, r[some]))
                    pr[some] = np.minimum(pr[some], places.from_(of, l[some]))
                okl, okr = np.minimum(l, pl) + most >= l, np.maximum(r, pr) <= r + most
                okl[clause < 0] = okr[clause < 0] = False
                l, r = np.where(okl, np.minimum(l, pl), l), np.where(okr, np.maximum(r, pr), r)
                ok = okl | okr | (clause < 0)
                k, l, r = k[ok], l[ok], r[ok]
            dl, dr = (np.searchsorted(start[order], x - 1, "right") - 1 for x in (l, r))
            ok = dl == dr
            out.append((k[ok], doc_id[order][dl[ok]], l[ok], r[ok]))
        k, d, l, r = (np.concatenate([_NONE, *x]) for x in zip(*out)) if out else [_NONE] * 4
        return pa.table({"k": k, "shard": pa.array(np.full(len(k), shard, np.int32)), "doc_id": d, "l": l, "r": r})

    return run


_MUL = np.random.default_rng(20240229).integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hashed(tokens: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each token, the same on every machine."""
    from pandas.util import hash_array

    if pa.types.is_integer(tokens.type):
        x = tokens.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return np.stack([_mix(x ^ m) for m in _MUL[:, 0]])
    x = tokens.to_numpy(zero_copy_only=False)
    return np.stack([hash_array(x, hash_key=key, categorize=False) for key in ("0123456789abcdef", "fedcba9876543210")])


def frequent(lengths: tuple[int, ...], known: int, sent) -> Callable:
    """(n, h1, h2, cnt, first): the n-grams of these lengths, by 128 bits, of which all parts of known tokens are in the bits that were sent.

    cnt is how often they occur in a stretch of documents, first the document and the position of the first time there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stretches(batches):
            s = Stretch(b, b.column("tokens").flatten().slice(0, 0))
            coded = s.values.dictionary_encode()
            t = np.zeros((2, len(s.doc) + 64), np.uint64)
            at = np.arange(len(s.values)) + np.repeat(np.arange(len(s.size)), s.size)
            t[:, at] = _hashed(coded.dictionary)[:, coded.indices.to_numpy(zero_copy_only=False)]
            left = s.size[s.doc] - (np.arange(len(s.doc)) - s.first[s.doc])

            def gram(n: int, of: int, at: np.ndarray) -> np.ndarray:
                h = np.full(len(at), n, np.uint64)
                for k in range(n):
                    h += t[of, at + k] * _MUL[of, k]
                return _mix(h)

            some = np.flatnonzero(left >= max(1, known))
            if known:
                bits = sent.value
                h = gram(known, 0, some) & np.uint64((len(bits) << 6) - 1)
                ok = (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
                some = some[ok]
            run_ = np.zeros(len(s.doc) + 1, np.int64)
            run_[some] = 1
            bad = np.concatenate([[0], np.cumsum(1 - run_)])  # how many starts before a place aren't known
            doc_id = b.column("doc_id").to_numpy(zero_copy_only=False)
            for n in lengths:
                p = some[left[some] >= n]
                p = p[bad[p + n - max(1, known) + 1] == bad[p]]
                h1, h2 = gram(n, 0, p), gram(n, 1, p)
                order = np.lexsort((s.pos(p), doc_id[s.doc[p]], h2, h1))
                h1, h2, p = h1[order], h2[order], p[order]
                new = np.ones(len(p), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                first = np.flatnonzero(new)
                cnt = np.diff(np.append(first, len(p)))
                p = p[first]
                where = pa.StructArray.from_arrays([pa.array(doc_id[s.doc[p]]), pa.array(s.pos(p).astype(np.int32))], ["doc_id", "pos"])
                yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(p), n, np.int32)), "h1": pa.array(h1[first].view(np.int64)), "h2": pa.array(h2[first].view(np.int64)), "cnt": pa.array(cnt), "first": where})

    return run
