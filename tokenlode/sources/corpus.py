"""A tokenized corpus as a DataFrame, and what can be read into one."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import tokenize
from .shared import running, written

WIDTHS = {"u8": 1, "u16": 2, "u32": 4}


@dataclass(frozen=True)
class Corpus:
    """docs(shard INT, doc_id BIGINT, tokens ARRAY, metadata STRING), in each shard in the order of doc_id.

    A separator stands in front of every document. It takes up one position,
    and counts show it as `sep`; where it is the next token, as `eos`. width
    is the bytes of a token in pointers. Tokens are strings or integers.
    """

    docs: DataFrame
    sep: object = "<sep>"
    eos: object = "<eos>"
    width: int = 4
    #: Tables made from the corpus when first asked for.
    made: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def from_texts(cls, texts: DataFrame, shards: int = 1, id_col: str = "doc_id", text_col: str = "text", metadata_col: str | None = None) -> Corpus:
        """Words as tokens; a document's shard is its id modulo shards. Rows without an id are no documents."""
        meta = F.col(metadata_col).cast("string") if metadata_col else F.lit("")
        docs = texts.where(F.col(id_col).isNotNull()).select(
            F.pmod(F.col(id_col), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).cast("bigint").alias("doc_id"), tokenize(F.col(text_col)).alias("tokens"), meta.alias("metadata")
        )
        return cls(docs)

    @classmethod
    def from_ids(cls, spark: SparkSession, shards: list[list[list[int]]], token_dtype: str = "u16", eos: int = 0, metadata: list[list[str]] | None = None) -> Corpus:
        """From lists: shards of documents of ids."""
        width, rows = WIDTHS[token_dtype], []
        for s, docs in enumerate(shards):
            for d in docs:
                rows.append((s, len(rows), [int(t) for t in d], metadata[s][len(rows) - sum(map(len, shards[:s]))] if metadata else ""))
        df = spark.createDataFrame(rows, "shard int, doc_id long, tokens array<bigint>, metadata string")
        return cls(df, (1 << 8 * width) - 1, eos, width)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, sep: object = "<sep>", eos: object = "<eos>", width: int = 4) -> Corpus:
        """What `save` wrote."""
        docs = spark.read.parquet(path)
        missing = {"shard", "doc_id", "tokens", "metadata"} - set(docs.columns)
        if missing:
            raise ValueError(f"no corpus: columns {sorted(missing)} are missing")
        return cls(docs.select("shard", "doc_id", "tokens", "metadata"), sep, eos, width)

    def save(self, path: str) -> None:
        """A folder that `from_parquet` reads, by shard."""
        self.docs.write.partitionBy("shard").parquet(path)

    @classmethod
    def from_folders(cls, spark: SparkSession, dirs: list[str] | str, token_dtype: str = "u16", eos: int = 0) -> Corpus:
        """Binary shards: flat little-endian token streams (tokenized.*) with byte offsets of separators
        (offset.*), and metadata.* with metaoff.*; shards of later folders count on.

        Executors read documents by themselves; the driver reads only sizes.
        Raises ValueError for folders, counts or sizes that don't fit.
        """
        if token_dtype not in WIDTHS:
            raise ValueError(f"token_dtype must be one of {sorted(WIDTHS)}")
        width, tasks, shard = WIDTHS[token_dtype], [], 0
        for d in [dirs] if isinstance(dirs, str) else dirs:
            p = Path(d)
            if not p.is_dir():
                raise ValueError(f"{d} is no folder")
            kinds: dict[str, list[Path]] = {k: [] for k in ("tokenized", "table", "offset", "metadata", "metaoff")}
            for f in sorted(p.iterdir()):
                kind = next((k for k in kinds if k in f.name), None)
                if kind:
                    kinds[kind].append(f)
            n = len(kinds["tokenized"])
            if not n:
                raise ValueError(f"{d} holds no shards")
            if len(kinds["offset"]) != n or len(kinds["table"]) not in (0, n) or len(kinds["metadata"]) not in (0, n) or len(kinds["metadata"]) != len(kinds["metaoff"]):
                raise ValueError(f"{d}: the numbers of files of the kinds differ")
            for i in range(n):
                tok, off = kinds["tokenized"][i], kinds["offset"][i]
                if tok.stat().st_size % width or off.stat().st_size % 8:
                    raise ValueError(f"{d}: a size isn't a multiple of its width")
                if kinds["table"]:  # a pointer of 1 to 8 bytes for each token
                    size, tokens = kinds["table"][i].stat().st_size, tok.stat().st_size // width
                    if (size % tokens or not 1 <= size // tokens <= 8) if tokens else size:
                        raise ValueError(f"{d}: the suffix table doesn't fit the tokens")
                docs = off.stat().st_size // 8
                meta = (str(kinds["metadata"][i]), str(kinds["metaoff"][i])) if kinds["metadata"] else ("", "")
                if meta[1] and Path(meta[1]).stat().st_size != off.stat().st_size:
                    raise ValueError(f"{d}: metaoff doesn't fit offset")
                tasks += [(shard, a, min(a + 4096, docs), docs, str(tok), str(off), *meta) for a in range(0, docs, 4096)]
                shard += 1
        kind = np.dtype(f"<u{width}")

        def read(batches):
            import pandas as pd

            for b in batches:
                for _, s, a, e, docs, tok, off, meta, metaoff in b.itertuples():
                    o = np.memmap(off, "<u8", "r")
                    t = np.memmap(tok, kind, "r")
                    ends = np.append(o[a + 1 : e + 1], [] if e < docs else [len(t) * width]).astype(np.int64) // width
                    starts = np.asarray(o[a:e]).astype(np.int64) // width + 1
                    texts = [""] * (e - a)
                    if meta:
                        m, mo = np.memmap(meta, np.uint8, "r"), np.memmap(metaoff, "<u8", "r")
                        upto = np.append(mo[a + 1 : e + 1], [] if e < docs else [len(m)]).astype(np.int64)
                        texts = [bytes(m[int(x) : int(y)]).decode("utf-8", "replace").rstrip("\n") for x, y in zip(mo[a:e], upto)]
                    yield pd.DataFrame({"shard": s, "doc_id": np.arange(a, e), "tokens": [t[x:y].astype(np.int64) for x, y in zip(starts, ends)], "metadata": texts})

        plan = spark.createDataFrame(tasks, "s int, a long, e long, docs long, tok string, off string, meta string, metaoff string").repartition(max(1, len(tasks)))
        docs = plan.mapInPandas(read, "shard int, doc_id long, tokens array<bigint>, metadata string")
        return cls(docs, (1 << 8 * width) - 1, eos, width)

    def layout(self) -> DataFrame:
        """(shard, doc_id, doc_ix, doc_start, doc_len), a written table of narrow rows; made when first asked for."""
        if "layout" not in self.made:
            d = self.docs.select("shard", "doc_id", F.size("tokens").cast("bigint").alias("doc_len")).withColumns({"one": F.lit(1).cast("bigint"), "all": F.col("doc_len") + 1})
            d = running(d, ["shard"], ["doc_id"], "one", "all")
            before = d.groupBy("shard").agg(F.count("*").alias("n"))  # a row a shard
            before = before.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
            d = d.join(before, "shard").select("shard", "doc_id", (F.col("before") + F.col("upto_one") - 1).alias("doc_ix"), (F.col("upto_all") - F.col("all")).alias("doc_start"), "doc_len")
            self.made["layout"] = written(d, "layout")
        return self.made["layout"]

    def stream(self, n: int, before: bool = False) -> DataFrame:
        """docs as stretches of the token stream: the separator, the document, and what follows in
        the shard up to n tokens; `own` is how many positions are the document's. For needles with separators and for suffix order.

        With before it is what precedes, in front. A document takes from its neighbour, from the next one
        if that has too little, and so on: so many joins of n tokens a document as it takes.
        """
        at = self.layout().select("shard", "doc_id", "doc_ix")
        d = self.docs.select("shard", "doc_id", F.concat(F.array(F.lit(self.sep)), F.col("tokens")).alias("tokens"))
        part = F.slice("tokens", -F.least(F.size("tokens"), F.lit(n)), n) if before else F.slice("tokens", 1, n)
        ends = written(d.select("shard", "doc_id", part.alias("part")).join(at, ["shard", "doc_id"]).select("shard", "doc_ix", "part"), "ends")
        todo, got, hop = at.select("shard", "doc_id", "doc_ix", F.slice(F.array(F.lit(self.sep)), 1, 0).alias("more")), None, 0
        while n:
            hop += 1
            near = ends.select("shard", (F.col("doc_ix") + (hop if before else -hop)).alias("doc_ix"), "part")
            joined = F.concat("part", "more") if before else F.concat("more", "part")
            step = written(todo.join(near, ["shard", "doc_ix"], "left").select("shard", "doc_id", "doc_ix", F.when(F.col("part").isNull(), F.col("more")).otherwise(joined).alias("more"), F.col("part").isNull().alias("end")), "stream")
            done = F.col("end") | (F.size("more") >= n)
            got = step.where(done) if got is None else got.unionByName(step.where(done))
            todo = step.where(~done).drop("end")
            if not todo.limit(1).count():
                break
        if got is None:
            return d.withColumn("own", F.size("tokens"))
        cut = F.slice("more", -F.least(F.size("more"), F.lit(n)), n) if before else F.slice("more", 1, n)
        cut = F.when(F.size("more") > 0, cut).otherwise(F.col("more"))
        d = d.join(got.select("shard", "doc_id", cut.alias("more")), ["shard", "doc_id"]).withColumn("own", F.size("tokens"))
        return d.withColumn("tokens", F.concat("more", "tokens") if before else F.concat("tokens", "more")).drop("more")

    def head(self, max_docs: int | None = None, max_tokens: int | None = None) -> Corpus:
        """The first documents by doc_ix whose tokens, separators included, stay within max_tokens."""
        at = self.layout()
        if max_docs is not None:
            at = at.where(F.col("doc_ix") < max_docs)
        if max_tokens is not None:
            shards = at.groupBy("shard").agg(F.sum(F.col("doc_len") + 1).alias("n"))
            shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
            at = at.join(shards, "shard").where(F.col("before") + F.col("doc_start") + F.col("doc_len") + 1 <= max_tokens)
        return Corpus(self.docs.join(at.select("shard", "doc_id"), ["shard", "doc_id"], "left_semi"), self.sep, self.eos, self.width)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalogue {name: {s3_url, tokenizer: {...}, version}} as (name, url, tokenizer, version)."""
    got = json.loads(Path(path).read_text())
    if not isinstance(got, dict):
        raise ValueError("a catalogue is an object by name")
    rows = []
    for name, x in got.items():
        if not isinstance(x, dict) or not isinstance(x.get("s3_url"), str) or not isinstance(x.get("tokenizer"), dict) or not isinstance(x.get("version"), int):
            raise ValueError(f"entry {name} doesn't have the fields of a catalogue")
        rows.append((name, x["s3_url"], json.dumps(x["tokenizer"], sort_keys=True), x["version"]))
    return spark.createDataFrame(rows, "name string, url string, tokenizer string, version int")
