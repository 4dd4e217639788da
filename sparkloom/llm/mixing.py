"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations alone.

Every source is given a number of words. What it takes beyond whole repeats is cut out of the order of a hash of
the ids: sizes are summed by source and hash bucket, the bucket in which the running sum passes the budget is found,
only that bucket is split again, and last the few documents of the last boundary bucket are placed one by one. A
document is then in or out by comparing its hash with its source's threshold; the documents are never sorted. A
larger budget moves the threshold up, so mixes of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, free_name
from sparkloom.workspace import materialise

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Bits of the 60-bit hash that the first and the second histogram look at.
BITS = (12, 24)


def id_hash(c: Column) -> Column:
    """60 bits of MD5 of the id as text; a null id hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``(source, source_size)`` → plus ``target``, by water-filling.

    Sources in code point order, null last, get the weights in turn. None exceeds *most* times its own size: in
    ascending order of cap by weight, the first source whose fair share of what is left fits under its cap tells
    the level for itself and all after it. One row per source, so one task can hold them.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("shares", F.sum("w").over(after))
    s = s.withColumn("fits", F.col("left") / F.col("shares") <= F.col("ratio"))
    s = s.withColumn("first", F.min(F.when(F.col("fits"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "left", "shares"))).over(everything))
    free = (F.col("w") * F.col("first.left")) / F.col("first.shares")
    return s.select("source", "source_size", F.when(F.col("first").isNotNull() & (F.col("ratio") >= F.col("first.ratio")), F.least(free, F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double")).alias("target"))


def _boundary(sums: DataFrame, budget: DataFrame) -> DataFrame:
    """Per source the first bucket whose running sum passes the budget, and the sum before it."""
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.join(budget, F.col("source").eqNullSafe(F.col("bsource"))).withColumn("upto", F.col("base") + F.sum("n").over(w))
    first = run.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"), "rest")).alias("e"))
    return materialise(first.select("source", "e.*"), "edges")


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h"))


def thresholds(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``(doc_id, source, size, h)`` → a row per source: target, whole repeats, and the hash up to which once more is taken."""
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = materialise(goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    bucket = lambda bits: F.shiftright("h", 60 - bits)
    key = F.coalesce("doc_id", F.lit(-(2**63)))

    def inside(edge: DataFrame, bits: int) -> DataFrame:
        e = edge.select(F.col("source").alias("bsource"), F.col("bucket").alias("at"), "rest", "base")
        return slim.join(e, F.col("source").eqNullSafe(F.col("bsource")) & (bucket(bits) == F.col("at")))

    coarse = slim.groupBy("source", bucket(BITS[0]).alias("bucket")).agg(F.sum("size").alias("n"))
    edge = _boundary(coarse, goal.select(F.col("source").alias("bsource"), "rest", F.lit(0).cast("long").alias("base")))
    fine = inside(edge, BITS[0]).groupBy("source", bucket(BITS[1]).alias("bucket")).agg(F.sum("size").alias("n"))
    edge = _boundary(fine, edge.select(F.col("source").alias("bsource"), "rest", "base"))
    order = Window.partitionBy("source").orderBy("h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside(edge, BITS[1]).withColumn("upto", F.col("base") + F.sum("size").over(order))
    placed = placed.filter(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest")).groupBy(F.col("source").alias("psource")).agg(F.max(F.struct("h", key.alias("k"))).alias("cut"))
    edge = edge.join(placed, F.col("source").eqNullSafe(F.col("psource")), "left").select(F.col("source").alias("esource"), F.col("bucket").alias("edge"), "cut")
    return materialise(
        goal.join(edge, F.col("source").eqNullSafe(F.col("esource")), "left").select(F.col("source").alias("tsource"), "source_size", "target", "whole", "edge", "cut"), "thresholds"
    )


def _taken(h: Column, doc_id: Column, at: str = "") -> Column:
    """How often a document is taken whole, beside its source's row of ``thresholds``."""
    key, bucket = F.coalesce(doc_id, F.lit(-(2**63))), F.shiftright(h, 60 - BITS[1])
    at_edge = (bucket == F.col(at + "edge")) & ((h < F.col(at + "cut.h")) | ((h == F.col(at + "cut.h")) & (key <= F.col(at + "cut.k"))))
    return F.col(at + "whole") + F.coalesce((bucket < F.col(at + "edge")) | at_edge, F.lit(False)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    ``size`` counts words of the text (null: 0). Of a source with target T and size Z every document is taken
    floor(T / Z) times; those up to the threshold, in order of (hash, id), once more, so that the sum comes as near
    T as whole documents allow. A null source is a source. Rows that repeat an id are cut together only if their
    hashes leave the same order, and count each. Empty tables and sources without words give targets of 0.
    """
    slim = materialise(_slim(docs, id_col, text_col, source_col), "sizes")
    picked = slim.join(thresholds(slim, weights, most), F.col("source").eqNullSafe(F.col("tsource")))
    return picked.select("doc_id", "size", "source_size", "target", (_taken(F.col("h"), F.col("doc_id")) * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of *docs*, with all their columns, as often as ``mix`` takes them; texts without words are not taken.

    Each row is judged by itself beside the few thresholds of its source, so rows that share an id do not get each
    other's copies, and texts are not shuffled.
    """
    cuts = thresholds(materialise(_slim(docs, id_col, text_col, source_col), "sizes"), weights, most)
    cut, copy = (free_name(docs, n) for n in ("cut", "copy"))
    cuts = cuts.select(F.struct("*").alias(cut))
    source, doc_id = docs[source_col].cast("string"), docs[id_col].cast("long")
    beside = docs.join(cuts, source.eqNullSafe(F.col(f"{cut}.tsource")))
    times = _taken(id_hash(docs[id_col]), doc_id, f"{cut}.")
    copies = F.when(_size(docs[text_col]) > 0, F.sequence(F.lit(1), times.cast("int"), F.lit(1)))
    return beside.filter(times > 0).withColumn(copy, F.explode(copies)).select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM z),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rem,
         CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares
  FROM r),
f AS (SELECT rem AS frem, shares AS fshares, ratio AS fratio FROM l WHERE CAST(rem AS DOUBLE) / shares <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN fratio IS NOT NULL AND ratio >= fratio THEN least(CAST(w * frem AS DOUBLE) / fshares, CAST(cap AS DOUBLE)) ELSE CAST(cap AS DOUBLE) END AS target
  FROM l LEFT JOIN f ON TRUE),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, (whole + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size AS taken FROM c
"""
