"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate over its quality weight: -ln(u)/w,
u from a hash of seed and id. Within a source, documents are taken in the
order of keys until the source's token budget is full; that is weighted
sampling without replacement. A budget of more than the source holds is
first met with complete epochs, then with a selection for the fraction.

The prefix sums need no sort of a whole source: keys are put in cells whose
order is theirs, the cells' sums tell in which cell a budget ends, and only
the documents of that cell are ranked. Cells, and thus ranked documents, are
about as many in a large source as a small one has documents a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, named

#: Cells of a source; the one in which its budget ends is sorted.
CELLS = 1 << 16
SEED = "mix-1"
#: Sampling weights of documents by label; 1 for those without.
GOOD, POOR = 2.0, 0.5


def tokens(text: Column) -> Column:
    """Words parted by white space."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("bigint")


def unit(seed: str, *by: Column) -> Column:
    """A number in (0, 1) from a hash; nulls hash like the word null."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in by])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def select(rows: DataFrame, shares: dict[str, float] | None, total: int | None, seed: str = SEED) -> DataFrame:
    """(id, n, source, weight, text_hash) -> the same and copies, for rows that are taken at least once.

    shares gives sources' target weights, relative to each other; other sources
    get nothing. None gives each source the same. total is the token budget
    of all; None takes as many tokens as the rows have.
    """
    key = -F.log(unit(seed, F.col("id"), F.col("tie"))) / F.col("weight")
    d = rows.withColumn("key", key).withColumn("cell", F.floor(F.col("key") / (1 + F.col("key")) * CELLS).cast("int"))
    cells = d.groupBy("source", "cell").agg(F.sum("n").alias("n"))
    sums = cells.groupBy("source").agg(F.sum("n").alias("held"))
    if shares is None:
        sums = sums.withColumn("share", F.lit(1.0))
    else:
        share = F.lit(0.0)
        for s, w in shares.items():
            share = F.when(F.col("source") == s, F.lit(float(w))).otherwise(share)
        sums = sums.withColumn("share", share)
    free = sums.where("held = 0 AND share > 0").select("source", F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("left"), F.lit(1).alias("epochs"))
    sums = sums.where("held > 0")
    all_ = sums.agg(F.sum("share").alias("shares"), F.sum("held").alias("all"))
    budget = F.floor((F.lit(total) if total is not None else F.col("all")) * F.col("share") / F.col("shares")).cast("bigint")
    budgets = sums.crossJoin(F.broadcast(all_)).where("shares > 0").withColumn("budget", budget)
    budgets = budgets.select("source", F.floor(F.col("budget") / F.col("held")).cast("int").alias("epochs"), (F.col("budget") % F.col("held")).alias("rest"))
    by_cell = Window.partitionBy("source").orderBy("cell")
    # the cell in which the sum passes the rest, and what is left there
    ends = cells.withColumn("upto", F.sum("n").over(by_cell)).join(budgets, "source").where("upto > rest")
    ends = ends.groupBy("source").agg(F.min(F.struct("cell", "n", "upto", "rest", "epochs")).alias("e"))
    ends = ends.select("source", F.col("e.cell").alias("end"), (F.col("e.rest") - F.col("e.upto") + F.col("e.n")).alias("left"), F.col("e.epochs").alias("epochs"))
    ends = materialise(ends.unionByName(free), "budgets")  # a row for each source
    d = d.join(ends, "source")
    rank = Window.partitionBy("source").orderBy("key", "id", "tie")
    within = d.where("cell = end").withColumn("upto", F.sum("n").over(rank)).withColumn("more", (F.col("upto") <= F.col("left")).cast("int")).drop("upto")
    out = d.where("cell <> end").withColumn("more", (F.col("cell") < F.col("end")).cast("int")).unionByName(within)
    return out.withColumn("copies", F.col("epochs") + F.col("more")).where("copies > 0")


def weights(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, weight) from labels: GOOD for quality 1, POOR for 0. Labels with a
    null id or quality don't count; of several for an id the best does."""
    d = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return d.select(F.col("doc_id").cast("bigint").alias("wid"), F.when(F.col("q") > 0, GOOD).otherwise(POOR).alias("weight"))


def measured(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """What `select` takes: no texts, so little is exchanged."""
    d = docs.select(
        named(docs, "doc_id").cast("bigint").alias("id"), F.coalesce(named(docs, "source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(tokens(named(docs, "text")), F.lit(0)).alias("n"), F.md5(F.coalesce(named(docs, "text"), F.lit(""))).alias("tie"),
    )
    if labels is None:
        return d.withColumn("weight", F.lit(1.0))
    return d.join(weights(docs, labels), F.col("id") == F.col("wid"), "left").drop("wid").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def mix(docs: DataFrame, labels: DataFrame | None = None, shares: dict[str, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents taken.

    Ties in the key go by id, then by a hash of the text. A null source is the
    source ''; a null or empty text has no tokens: it takes no budget, and its
    place in the order says whether it is in the fraction. All documents of a source that has no tokens at all are
    taken once, if its share isn't 0; they don't count for the others' shares. A null id is hashed
    as such. Repeated rows tie and are taken or left together. An empty table,
    a total of 0 or shares of 0 give nothing. A document is taken only whole: a
    source's fraction ends before the first one that doesn't fit. Other columns
    don't matter.
    """
    d = materialise(measured(docs, labels), "measured")
    return select(d, shares, total, seed).select(F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), F.col("copies").cast("int").alias("copies"))


def mix_rows(docs: DataFrame, labels: DataFrame | None = None, shares: dict[str, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as `mix` takes it, with their own columns.

    Rows that share id and text are taken together: as often as the most taken of them.
    """
    i, t, c = fresh(docs, "id__", "tie__", "copies__")
    d = materialise(measured(docs, labels), "measured")
    got = select(d, shares, total, seed).groupBy("id", "tie").agg(F.max("copies").alias(c)).select(F.col("id").alias(i), F.col("tie").alias(t), c)
    rows = docs.withColumns({i: named(docs, "doc_id").cast("bigint"), t: F.md5(F.coalesce(named(docs, "text"), F.lit("")))})
    gi, gt = fresh(rows, "gid__", "gtie__")
    got = got.withColumnsRenamed({i: gi, t: gt})
    both = rows.join(got, rows[i].eqNullSafe(got[gi]) & (rows[t] == got[gt]))
    return both.withColumn(c, F.explode(F.array_repeat(F.lit(1), F.col(c).cast("int")))).select(*[named(rows, x) for x in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source the same share of as many tokens as there are."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = f"""
WITH w AS (
  SELECT doc_id, CASE WHEN max(quality) > 0 THEN {GOOD} ELSE {POOR} END AS weight
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n, md5(coalesce(text, '')) AS tie,
    coalesce(weight, 1.0)::DOUBLE AS weight
  FROM documents d LEFT JOIN w USING (doc_id)
), k AS (
  SELECT *, -ln((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || tie), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE) / weight AS key FROM d
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY key, doc_id, tie) AS upto, sum(n) OVER (PARTITION BY source) AS held, sum(n) OVER () AS total FROM k
), b AS (
  SELECT *, floor(total::DOUBLE / (SELECT count(DISTINCT source) FROM s WHERE held > 0))::BIGINT AS budget FROM s WHERE held > 0
)
SELECT doc_id, source, n AS n_tokens, (budget // held::BIGINT + CASE WHEN upto <= budget % held::BIGINT THEN 1 ELSE 0 END)::INT AS copies
FROM b WHERE budget // held::BIGINT + CASE WHEN upto <= budget % held::BIGINT THEN 1 ELSE 0 END > 0
UNION ALL SELECT doc_id, source, n, 1::INT FROM s WHERE held = 0
"""
