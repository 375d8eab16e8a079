"""SentencePiece encoding and decoding with weighted finite-state transducers.

Three transducers are compiled from a model file: the normaliser (character
map, dummy prefix, white space), the pieces (a trie whose arcs give a piece
and its weight) and the byte fallback (any other character to its bytes).
The trie is run as an automaton whose state tells all pieces that end at a
position. Composed with an input, they form a lattice over its positions; the ids are
those of the shortest path in the tropical semiring.

For a unigram model a piece weighs its negated log probability. For a BPE
model the state is the last piece, and an arc weighs 0 if BPE leaves its
piece and the last one apart when it meets them alone, infinity if not. One
path of finite weight is left, and it is that of BPE: BPE never merges
across a boundary of its own result, so each pair in it stands alone as well;
conversely, the first merge across a boundary would also happen within the
pair there. Each position thus has one live state.

No piece goes from other characters to a space, nor from letters to most
signs; at such places the lattice narrows to a point, so it is cut into words
whose paths are looked up again where a word recurs.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import named, release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Paths of words that a worker remembers at least (two and a half times as many at most, and one text's), and verdicts on pairs of pieces.
WORDS, PAIRS = 100_000, 300_000


class Normaliser:
    """The normalising transducer: longest match in the character map, then white space."""

    def __init__(self, spec):
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.units, self.strings = None, b""
        if spec.precompiled_charsmap:
            n = struct.unpack_from("<I", spec.precompiled_charsmap)[0]
            self.units = np.frombuffer(spec.precompiled_charsmap[4 : 4 + n], "<u4").tolist()
            self.strings = spec.precompiled_charsmap[4 + n :]

    def _longest(self, b: bytes, i: int) -> tuple[int, int]:
        """(end, place of the replacement) of the longest key at b[i:], or (i, -1); the trie is a double array."""
        units = self.units
        at, end, found = (units[0] >> 10) << ((units[0] & 512) >> 6), i, -1
        for k in range(i, len(b)):
            at ^= b[k]
            u = units[at]
            if u & 0x800000FF != b[k]:
                break
            at ^= (u >> 10) << ((u & 512) >> 6)
            if u >> 8 & 1:
                end, found = k + 1, units[at] & 0x7FFFFFFF
        return end, found

    def _mapped(self, text: str) -> str:
        b, out, i = text.encode(), [], 0
        while i < len(b):
            end, at = self._longest(b, i)
            if at >= 0:
                out.append(self.strings[at : self.strings.index(b"\0", at)])
            else:
                end = i + (1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4)
                out.append(b[i:end])
            i = end
        return b"".join(out).decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        """Spaces stay spaces here; the pieces' mark for them is put in later."""
        if self.units is not None:
            text = self._mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(SPACE, " ")
        return " " + text if self.prefix and text else text


class State(dict):
    """Of the automaton of pieces: the next states by character, found as they are needed.

    text is the longest end of the input with which a piece begins; arcs has the pieces that end there, the longest
    first and the last character always, each with its length negated and its verdicts by the piece before.
    """

    __slots__ = ("of", "text", "arcs")

    def __missing__(self, ch: str) -> State:
        s = self.of.state(self.text + ch)
        if s.text:
            self[ch] = s
        return s


class Transducer:
    """The composition of the normaliser, the pieces and the byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type not in (1, 2) or m.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("only BPE and unigram models without user-defined or unused pieces and with leading spaces")
        self.bpe = m.trainer_spec.model_type == 2
        self.normalise = Normaliser(m.normalizer_spec)
        self.ids = {p.piece.replace(SPACE, " "): i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = {p.piece.replace(SPACE, " "): p.score for p in m.pieces if p.type == 1}
        self.unk = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.bytewise = m.trainer_spec.byte_fallback and len(self.byte) == 256
        self.surface = [b"" if p.type == 3 else m.trainer_spec.unk_surface.encode() if p.type == 2 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.unk_cost = 10 - min(self.score.values())
        self.code = {p: struct.pack("<i", i) for p, i in self.ids.items()}
        self.states: dict[str, State | None] = {"": None} | {p[:k]: None for p in self.ids for k in range(1, len(p) + 1)}
        self.verdicts: dict[str, dict[str, bool]] = {}
        self.cut = self._cut()
        # paths used since there were WORDS of them, and those from before
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = 0

    def _cut(self) -> re.Pattern | None:
        """Matches the words between whose ends no piece reaches, or None."""
        if any(" " in p.lstrip(" ") for p in self.ids):
            return None
        signs = {chr(c) for c in range(1, 128) if not chr(c).isalnum() and chr(c) != " "}
        while bad := {c for p in self.ids for c in p if c in signs and not set(p.lstrip(" ")) <= signs}:
            signs -= bad
        s = re.escape("".join(sorted(signs)))
        return re.compile(f" *[{s}]+| *[^ {s}]+| +" if signs else " *[^ ]+| +")

    def words(self, text: str) -> list[str]:
        return self.cut.findall(text) if self.cut else [text] if text else []

    def state(self, text: str) -> State:
        """That of the longest end of text with which a piece begins."""
        while text not in self.states:
            text = text[1:]
        s = self.states[text]
        if s is None:
            s = self.states[text] = State()
            ends = [text[k:] for k in range(len(text)) if text[k:] in self.ids or k == len(text) - 1]
            s.of, s.text, s.arcs = self, text, tuple((p, -len(p), self.verdicts.setdefault(p, {})) for p in ends)
        return s

    def _judge(self, a: str, b: str, known: dict[str, bool]) -> bool:
        """Whether BPE over a and b joined gives a and b; with an empty a, over b gives b."""
        if self.pairs >= PAIRS:
            for v in self.verdicts.values():
                v.clear()
            self.pairs = 0
        self.pairs += 1
        known[a] = ok = self._merged(a, b)
        return ok

    def _merged(self, a: str, b: str) -> bool:
        s, score, edge = list(a + b), self.score.get, len(a)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = score(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return s == ([a, b] if a else [b])
            start = sum(map(len, s[:at]))
            if start < edge < start + len(s[at]) + len(s[at + 1]):
                return False
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _emit(self, pieces: list[str]) -> bytes:
        try:
            return b"".join([self.code[p] for p in pieces])
        except KeyError:
            out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.replace(" ", SPACE).encode()] if self.bytewise else [self.unk]
        return np.array(out, "<i4").tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Add the words' paths. In sorted order, what a word shares with the one before it keeps its states."""
        before, cost, last, states = "", [0.0], [""], [self.state("")]
        for w in sorted(words):
            keep = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                keep += 1
            del cost[keep + 1 :], last[keep + 1 :], states[keep + 1 :]
            s = states[-1]
            for ch in w[keep:]:
                s = s[ch]
                states.append(s)
                if not s.text:  # no piece that holds this character can be here, so it stands alone
                    last.append(ch)
                    if not self.bpe:
                        cost.append(cost[-1] + self.unk_cost)
                elif self.bpe:
                    piece = ""
                    for p, k, known in s.arcs:
                        prior = last[k]
                        ok = known.get(prior)
                        if ok or ok is None and self._judge(prior, p, known):
                            piece = p
                            break
                    last.append(piece)
                else:
                    best, piece = float("inf"), ""
                    for p, k, _ in reversed(s.arcs):
                        c = cost[k] + (-self.score[p] if p in self.score else self.unk_cost)
                        if c < best:
                            best, piece = c, p
                    cost.append(best)
                    last.append(piece)
            before = w
            pieces, end = [], len(w)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            self.paths[w] = self._emit(pieces[::-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        out: list[bytes] = []
        cut: list[list[str]] = []
        n = 0
        for t in texts:  # so many texts at once that their words fit
            cut.append(self.words(self.normalise(t)))
            n += len(cut[-1])
            if n >= WORDS // 4:
                out += self._paths(cut)
                cut, n = [], 0
        return out + self._paths(cut)

    def _paths(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of texts that are cut into words."""
        if len(self.paths) >= WORDS:
            self.paths, self.older = {}, self.paths
        new = []
        for w in {w for ws in cut for w in ws if w not in self.paths}:
            if (path := self.older.get(w)) is None:
                new.append(w)
            else:
                self.paths[w] = path
        self.encode_words(new)
        return [self._joined(b"".join(map(self.paths.__getitem__, ws))) for ws in cut]

    def _joined(self, path: bytes) -> bytes:
        """Without byte fallback a run of unknown characters is one unknown piece."""
        if self.bytewise:
            return path
        ids = np.frombuffer(path, "<i4")
        twice = (ids[1:] == self.unk) & (ids[:-1] == self.unk)
        return np.delete(ids, np.flatnonzero(twice) + 1).tobytes() if twice.any() else path

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids without a piece nothing."""
        n, s = len(self.surface), self.surface
        if len(ids) and (ids.min() < 0 or ids.max() >= n):
            ids = ids[(ids >= 0) & (ids < n)]
        text = b"".join(map(s.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.normalise.prefix and text.startswith(" ") else text


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """Compiled once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """(doc_id, ids, n_ids, decoded), a row for each row of docs.

    The empty text has no ids and decodes to itself; a null text has null ids,
    n_ids and decoded. Texts of any length are encoded whole. Repeated rows
    and null ids stay; an empty table gives an empty one; other columns don't
    matter. model is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        t = transducer(model)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = b.column(1).to_pylist()
                got = iter(t.encode([x for x in texts if x is not None]))
                ids = [None if x is None else np.frombuffer(next(got), "<i4") for x in texts]
                ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
                flat = np.concatenate([x for x in ids if x is not None] + [np.zeros(0, "<i4")])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
                cols = [b.column(0), lists, pa.array([None if x is None else len(x) for x in ids], pa.int32())]
                if decoded:
                    cols.append(pa.array([None if x is None else t.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_ids", "decoded"][: len(cols)])

    kind = dict(docs.dtypes)[id_col]
    d = docs.select(named(docs, id_col), named(docs, text_col).cast("string"))
    return d.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids int" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids. Null ids give a null text, no ids the
    empty one; a null among ids, or an id out of range, gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            text = [None if x is None else t.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(named(rows, id_col), named(rows, ids_col)).mapInArrow(run, f"doc_id {kind}, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
