"""Line dedup with a log-template tree.

Lines are parsed by a tree of fixed depth: its first level is the number of
tokens, the next ones are the leading tokens, where a token with a digit
counts as a variable field. Within a leaf, a token is constant at its
position if lines of enough documents have it there; the others are
variable fields and generalise to <*>. What results is a line's template; it
stands for lines of other documents only if enough of it is constant. Lines
of templates that recur over enough documents are dropped.

A long line needs no template to be told: where it recurs word for word in
as few as two different texts, it stays in the first of them and is dropped
from the others.

Leaves that too few documents reach are left out by counting their hashes,
which loses nothing: no template within can recur. Lines of the other leaves pass a
bit set of fixed size, and only their tokens are exchanged; the few of too small leaves that pass as well
go when the leaves themselves are counted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, materialise, named

#: Leading tokens that the tree looks at, documents that make a template recur, and its least constant share.
DEPTH, MIN_DOCS, CONSTANT = 3, 8, 0.6
#: Tokens of a line that recurs from two texts on.
LONG = 20
VAR, DIGIT = "<*>", re.compile("[0-9]")


def tokens(line: str) -> list[str]:
    return [t for t in line.replace("\t", " ").replace("\r", " ").split(" ") if t]


def leaf(of: list[str], depth: int) -> str:
    """The path of a line's tokens through the tree."""
    return " ".join([str(len(of)), *[VAR if DIGIT.search(t) else t for t in of[:depth]]])


def _texts(docs: DataFrame) -> DataFrame:
    d = docs.select(named(docs, "doc_id").cast("bigint").alias("id"), named(docs, "text").cast("string").alias("text")).where("text IS NOT NULL")
    return d.select("id", F.unhex(F.md5("text")).alias("hash"), "text")


def lines(docs: DataFrame, depth: int = DEPTH, long: int = LONG) -> DataFrame:
    """(id, hash, no, leaf, line) of each line that has tokens: 64 bits of its leaf and, if it is long, 128 of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, leaves, whole = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                for n, line in enumerate(text.split("\n")):
                    if t := tokens(line):
                        at.append(k)
                        no.append(n)
                        leaves.append(xxhash.xxh64_intdigest(leaf(t, depth).encode("utf-8", "surrogatepass"), 42))
                        whole.append(hashlib.md5(" ".join(t).encode("utf-8", "surrogatepass")).digest() if len(t) >= long else None)
            at = pa.array(at, pa.int64())
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(np.array(leaves, np.uint64).view(np.int64)), pa.array(whole, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "hash", "no", "leaf", "line"])

    return _texts(docs).mapInArrow(run, "id long, hash binary, no int, leaf long, line binary")


def often(rows: DataFrame, by: str, of: str, least: int) -> DataFrame:
    """The values of by with at least so many different ones of `of`."""
    return rows.select(by, of).distinct().groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(by)


def live(docs: DataFrame, known: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, id, hash, no, tokens) of the lines in leaves of enough texts; tokens with a digit are <*>."""
    maybe = bloom(often(known, "leaf", "hash", min_docs), hashed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, leaves, of = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                for n, line in enumerate(text.split("\n")):
                    if t := tokens(line):
                        at.append(k)
                        no.append(n)
                        leaves.append(leaf(t, depth))
                        of.append(line)
            hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in leaves], np.uint64)
            some = np.flatnonzero(maybe.has(hashes)).tolist() if leaves else []
            own = pa.array([at[k] for k in some], pa.int64())
            masked = [[VAR if DIGIT.search(t) else t for t in tokens(of[k])] for k in some]
            cols = [pa.array([leaves[k] for k in some], pa.string()), b.column(0).take(own), b.column(1).take(own), pa.array([no[k] for k in some], pa.int32()), pa.array(masked, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["leaf", "id", "hash", "no", "tokens"])

    s = materialise(_texts(docs).mapInArrow(run, "leaf string, id long, hash binary, no int, tokens array<string>"), "maybe-live")
    return s.join(often(s, "leaf", "hash", min_docs), "leaf")  # a text's copies count once


def templates(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, known: DataFrame | None = None) -> DataFrame:
    """(id, hash, no, template) of the lines whose template recurs. known: what `lines` gives, if it is at hand."""
    s = live(docs, lines(docs, depth) if known is None else known, depth, min_docs)
    each = s.select("leaf", "hash", F.posexplode("tokens").alias("at", "token")).where(F.col("token") != VAR).distinct()
    common = each.groupBy("leaf", "at", "token").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs)
    common = common.groupBy("leaf", "at").agg(F.collect_list("token").alias("tokens"))
    common = common.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", "tokens"))).alias("common"))
    t = s.join(common, "leaf")
    kept = F.transform("tokens", lambda x, i: F.when(F.array_contains(F.coalesce(F.try_element_at("common", i), F.array().cast("array<string>")), x), x).otherwise(VAR))
    t = t.select("id", "hash", "no", kept.alias("kept"))
    t = t.where(F.size(F.filter("kept", lambda x: x != VAR)) >= F.size("kept") * constant)
    t = materialise(t.select("id", "hash", "no", F.array_join("kept", " ").alias("template")), "templates")
    return t.join(often(t, "template", "hash", min_docs), "template")


def repeats(known: DataFrame) -> DataFrame:
    """(id, hash, no) of long lines that another text has as well, but for the first such text, by its least id (null last), then hash."""
    d = known.where("line IS NOT NULL").select("id", "hash", "no", "line")
    first = d.groupBy("line").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("f"), F.min("hash").alias("a"), F.max("hash").alias("b"))
    return d.join(first.where("a <> b").select("line", F.col("f.hash").alias("stays")), "line").where("hash <> stays").select("id", "hash", "no")


def line_dedup(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, long: int = LONG) -> DataFrame:
    """(doc_id, text, n_dropped), a row for each row of docs.

    A template recurs if min_docs different texts hold it: exact copies of a
    document count as one, and so do repeats within it. All lines of
    a recurring template go. Of a line of `long` tokens or more that different texts have word
    for word (white space aside), those of the first text stay (and of its copies) and the others go. Lines without tokens stay; the text of a document
    that loses all of its lines is empty. A null text stays null with
    0 dropped, an empty one empty. Rows that share id and text lose the same
    lines. Null ids are ids like others, and come last. An empty table gives an empty one.
    Other columns don't matter.
    """
    known = materialise(lines(docs, depth, long), "lines")
    gone = templates(docs, depth, min_docs, constant, known).select("id", "hash", "no").unionByName(repeats(known))
    gone = materialise(gone.groupBy("id", "hash").agg(F.collect_set("no").alias("gone")), "gone")
    d = docs.select(named(docs, "doc_id").alias("doc_id"), named(docs, "text").alias("text"))
    both = d.join(gone, d["doc_id"].eqNullSafe(gone["id"]) & (F.unhex(F.md5(d["text"])) == gone["hash"]), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    return both.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, md5(text) AS h, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), e AS (
  SELECT doc_id, h, unnest(parts) AS line, unnest(range(len(parts))) AS no FROM d
), raw AS (
  SELECT doc_id, h, no, regexp_extract_all(line, '[^ \t\r]+') AS raw FROM e
), k AS (
  SELECT doc_id, h, no, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VAR}' ELSE x END) AS tokens FROM raw
), l AS (
  SELECT *, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf FROM k WHERE len(tokens) > 0
), live AS (
  SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT h) >= {MIN_DOCS}
), p AS (
  SELECT doc_id, h, no, leaf, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM l WHERE leaf IN (SELECT leaf FROM live)
), common AS (
  SELECT leaf, i, token FROM p WHERE token <> '{VAR}' GROUP BY leaf, i, token HAVING count(DISTINCT h) >= {MIN_DOCS}
), t AS (
  SELECT doc_id, h, no, string_agg(CASE WHEN c.token IS NULL THEN '{VAR}' ELSE p.token END, ' ' ORDER BY p.i) AS template
  FROM p LEFT JOIN common c ON p.leaf = c.leaf AND p.i = c.i AND p.token = c.token
  GROUP BY doc_id, h, no HAVING count(c.token) >= count(*) * {CONSTANT}
), often AS (
  SELECT template FROM t GROUP BY template HAVING count(DISTINCT h) >= {MIN_DOCS}
), long AS (
  SELECT doc_id, h, no, array_to_string(raw, ' ') AS line FROM raw WHERE len(raw) >= {LONG}
), first AS (
  SELECT line, first(h ORDER BY doc_id NULLS LAST, h) AS stays FROM long GROUP BY line HAVING count(DISTINCT h) > 1
), gone AS (
  SELECT doc_id, h, no FROM t WHERE template IN (SELECT template FROM often)
  UNION SELECT doc_id, h, no FROM long JOIN first USING (line) WHERE h <> stays
), n AS (
  SELECT doc_id, h, count(*) AS n FROM gone GROUP BY doc_id, h
), r AS (
  SELECT e.doc_id, e.h, string_agg(e.line, chr(10) ORDER BY e.no) AS text
  FROM e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.h = g.h AND e.no = g.no WHERE g.no IS NULL GROUP BY e.doc_id, e.h
)
SELECT d.doc_id, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text, coalesce(n.n, 0)::INT AS n_dropped
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id AND md5(d.text) = n.h LEFT JOIN r ON d.doc_id = r.doc_id AND md5(d.text) = r.h
"""
