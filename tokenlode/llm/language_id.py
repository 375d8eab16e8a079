"""Language ID with error-correcting output codes.

Every language has a codeword of bits. One binary classifier a bit, a
logistic regression over hashed byte n-grams, predicts it; the language
whose codeword has the least weighted loss against the predicted bits is
chosen. A text whose two best codewords are too close, or which holds too
little to tell, is flagged as ambiguous.

The classifiers are fitted on the driver on at most `per_language` labelled
rows of each language, drawn by a hash of their ids from the whole table.
Prediction is over all texts, whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

#: Features: hashed byte n-grams of these lengths, in so many buckets each.
ORDERS, BUCKETS = (1, 2, 3, 4), 2048
#: Bytes that part words; digits and signs say nothing about a language.
_TO = np.full(256, 32, np.uint8)
_TO[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TO[128:] = np.arange(128, 256)


def features(text: str) -> tuple[np.ndarray, int]:
    """Square roots of n-gram frequencies, and how many letters the text has.

    Case, digits and signs don't count; runs of what isn't a letter are one space.
    """
    b = _TO[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    b = np.concatenate([[np.uint8(32)], b, [np.uint8(32)]])
    gap = b == 32
    b = b[~(gap & np.concatenate([[False], gap[:-1]]))]
    out = np.zeros(len(ORDERS) * BUCKETS, np.float32)
    h = np.zeros(len(b), np.uint32)
    w = b.astype(np.uint32)
    for k, n in enumerate(range(1, max(ORDERS) + 1)):
        if n == 1:
            h = w + np.uint32(1)
        else:
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) + w[n - 1 :] + np.uint32(1)
        x = (h * np.uint32(0x9E3779B1)) >> np.uint32(21)
        out[k * BUCKETS : (k + 1) * BUCKETS] = np.bincount(x, minlength=BUCKETS)
        out[k * BUCKETS : (k + 1) * BUCKETS] /= max(1, len(x))
    return np.sqrt(out), int((b != 32).sum())


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: all 2^(n-1)-1 splits for up to 5 languages,
    else the random code of 24 + 8 log2 n bits with the largest least distance of 200."""
    if n <= 5:
        bits = [(1, *r) for r in itertools.product((-1, 1), repeat=n - 1) if -1 in r]
        return np.array(bits, np.float32).T.copy() if bits else np.ones((1, 1), np.float32)
    rng, best, score = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (n, 24 + int(8 * np.log2(n)))).astype(np.float32)
        m = m[:, np.abs(m.sum(0)) < n]
        d = min(int((m[i] != m[j]).sum()) for i, j in itertools.combinations(range(n), 2))
        if d > score:
            best, score = m, d
    return best


@dataclass
class Model:
    """languages[i] has the row code[i]; weights and bias predict the bits, and loss_weights say how far each is trusted."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    loss_weights: np.ndarray
    min_margin: float = 0.1
    min_letters: int = 3

    def decode(self, x: np.ndarray, letters: int) -> tuple[str | None, float, float, bool]:
        """(language, loss, margin to the next, ambiguous)."""
        if letters == 0:
            return None, 1.0, 0.0, True
        f = np.clip(x @ self.weights + self.bias, -30, 30)
        loss = (np.log1p(np.exp(-self.code * f)) * self.loss_weights).sum(1) / self.loss_weights.sum()
        order = np.argsort(loss, kind="stable")
        margin = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else float("inf")
        return self.languages[order[0]], float(loss[order[0]]), margin, margin < self.min_margin or letters < self.min_letters


def fit(texts: list[str], langs: list[str], steps: int = 100, held: float = 0.2, **limits) -> Model:
    """Fit the bits' classifiers; the loss weight of a bit is its log odds of being right on rows held out."""
    names = sorted(set(langs))
    code = codewords(len(names))
    x = np.stack([features(t)[0] for t in texts])
    y = np.array([names.index(g) for g in langs])
    out = np.arange(len(y)) % max(2, round(1 / held)) == 0

    def train(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, t = x[rows], code[y[rows]]
        share = np.array([1 / (t == s).mean(0).clip(1e-3) / 2 for s in (-1, 1)])
        cost = np.where(t > 0, share[1], share[0])
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        m = v = 0.0
        for k in range(1, steps + 1):
            g = -t * cost / (1 + np.exp(np.clip(t * (a @ w + b), -30, 30))) / len(a)
            gw = a.T @ g + 1e-5 * w
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            w = (w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
            b = (b - 0.5 * g.sum(0)).astype(np.float32)
        return w, b

    trust = np.ones(code.shape[1], np.float32)
    if out.any() and not out.all():
        w, b = train(np.flatnonzero(~out))
        right = ((np.sign(x[out] @ w + b) == code[y[out]]).sum(0) + 1) / (out.sum() + 2)
        trust = np.log(right / (1 - right)).clip(0.05).astype(np.float32)
    w, b = train(np.arange(len(y)))
    return Model(names, code, w, b, trust, **limits)


def sample(docs: DataFrame, per_language: int, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", seed: int = 11) -> tuple[list[str], list[str]]:
    """At most per_language labelled rows of each language, by the least hashes of ids among those that have a text."""
    d = docs.select(named(docs, id_col).alias("i"), named(docs, lang_col).alias("g"), named(docs, text_col).alias("t"))
    d = d.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 40)) / float(1 << 40))
    counts = {r["g"]: r["n"] for r in d.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    part = F.lit(0.0)
    for g, n in counts.items():
        part = F.when(F.col("g") == g, F.lit(2.0 * per_language / n)).otherwise(part)
    rows = d.where((F.col("u") < part) & F.col("t").isNotNull()).orderBy("u", "i", "t").collect()
    had: dict[str, int] = {}
    texts, langs = [], []
    for r in rows:
        if had.setdefault(r["g"], 0) < per_language:
            had[r["g"]] += 1
            texts.append(r["t"])
            langs.append(r["g"])
    return texts, langs


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, loss, margin, ambiguous), a row for each row of docs.

    A null text, or one without letters, has no language, a loss of 1 and a
    margin of 0, and is ambiguous; so is any with fewer than min_letters
    letter bytes or a margin under min_margin. Equal texts get equal results;
    repeated rows stay repeated; null ids stay null; other columns don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            got = [m.decode(*features(t)) if t else (None, 1.0, 0.0, True) for t in (x.as_py() for x in b.column(1))]
            cols = list(zip(*got)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                ["doc_id", "language", "loss", "margin", "ambiguous"],
            )

    kind = dict(docs.dtypes)[id_col]
    d = docs.select(named(docs, id_col), named(docs, text_col).cast("string"))
    return d.mapInArrow(run, f"doc_id {kind}, language string, loss double, margin double, ambiguous boolean")


def language_id(docs: DataFrame, labelled: DataFrame | None = None, per_language: int = 300) -> DataFrame:
    """`predict` with a model fitted on the labelled rows (docs' own column lang by default).

    Where no row is labelled there is no language to choose: each text is
    ambiguous.
    """
    texts, langs = sample(docs if labelled is None else labelled, per_language)
    if not texts:
        return docs.select(
            named(docs, "doc_id").alias("doc_id"), F.lit(None).cast("string").alias("language"), F.lit(1.0).alias("loss"), F.lit(0.0).alias("margin"), F.lit(True).alias("ambiguous")
        )
    return predict(docs, fit(texts, langs))


def keep_known(docs: DataFrame, labelled: DataFrame | None = None, per_language: int = 300, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text `language_id` can place, with their columns.

    What goes is ambiguous there: null texts, texts without letters or with
    fewer than min_letters letter bytes, and those between two languages. Without
    labelled rows nothing can be placed, so nothing is rejected.
    """
    texts, langs = sample(docs if labelled is None else labelled, per_language)
    if not texts:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(fit(texts, langs))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([bool(t) and not held.value.decode(*features(t))[3] for t in b], dtype=bool)

    return docs.where(known(named(docs, text_col).cast("string")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
