"""A training corpus from raw documents: five stages, each written and read again before the next one starts.

Languages are told and texts without any dropped, exact and near copies are reduced to one document each, sources are
brought to their target weights (a document that a source must repeat comes several times), and what is left is
encoded to token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact, language, mixing, neardup, pieces
from sparkloom.llm.common import free_name, ship
from sparkloom.llm.queries import PIECES, tokenizer
from sparkloom.workspace import brief_shuffles, fresh_path, materialise, remove, scope

#: Bits of the bitmap of rows that go: for each of them, in all at most, and in a piece as Spark's function makes it.
BITS_EACH, MOST_BITS, PIECE = 32, 1 << 27, 1 << 15


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of *docs* whose *key* is not in *gone*, a written table of one column with that name.

    A bitmap of the hashes of *gone* goes to every task; it has MOST_BITS at most, whatever the table's size. A row whose
    bit is not set stays where it is. Only the others, what goes and a few by chance, meet the list itself, so a list too
    long to be broadcast costs no shuffle of all texts.
    """
    at, bit, piece, bits = (free_name(docs, n) for n in ("at", "bit", "piece", "bits"))
    most = min(MOST_BITS, max(PIECE, BITS_EACH * gone.count()))
    hashed = lambda df: df.withColumn(at, F.pmod(F.xxhash64(key), F.lit(most))).withColumns({piece: F.expr(f"{at} div {PIECE}"), bit: F.col(at) % PIECE})
    marks = hashed(gone).groupBy(piece).agg(F.bitmap_construct_agg(bit).alias(bits))
    met = hashed(docs).join(F.broadcast(marks), piece, "left")
    byte = F.conv(F.hex(F.substring(bits, F.expr(f"cast({bit} div 8 + 1 AS int)"), F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} % 8 AS int))")) != 0, F.lit(False))
    rest = met.filter(marked).select(*docs.columns).join(gone, key, "left_anti")
    return met.filter(~marked).select(*docs.columns).unionByName(rest)


def _one_of_each(docs: DataFrame, operator: Callable[[DataFrame, str], DataFrame], group: str) -> DataFrame:
    """One row, with all its columns, of each group that *operator* finds: that of the smallest id, null ids last.

    Where every row has an id of its own, that of the group's smallest tells the row, and no text is written. Otherwise
    the operator sees a key of the row's own in place of the id, so rows that repeat an id, or have none, are told
    apart; those keys are written with the rows, as a second evaluation need not number the rows alike. What the operator
    wrote goes as soon as the rows that go are known; they are fewer than those that stay in most tables.
    """
    spark = docs.sparkSession
    own, row, other, key = (free_name(docs, n) for n in ("own", "row", "id", "group"))
    path = fresh_path(spark, "chosen")
    ids = docs.select(F.col("doc_id").cast("long").alias(own))
    n, held, distinct = ids.agg(F.count(F.lit(1)), F.count(own), F.count_distinct(own)).first()
    if n == held == distinct:
        keyed, key_of = docs.withColumn(own, F.col("doc_id").cast("long")), own
        with scope(spark), brief_shuffles(spark):
            operator(docs, "doc_id").filter(F.col("doc_id") != F.col(group)).select(F.col("doc_id").alias(own)).write.parquet(path)
    else:
        keyed, key_of = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row
        with scope(spark), brief_shuffles(spark):
            groups = operator(keyed, row).select(F.col("doc_id").alias(row), F.col(group).alias(key))
            named = keyed.select(row, F.col("doc_id").cast("long").alias(other))
            first = F.min(F.struct(F.col(other).isNull().alias("none"), other, row)).alias("first")
            chosen = groups.join(named, row).groupBy(key).agg(first).select(F.col(f"first.{row}").alias(row))
            keyed.select(row).join(chosen, row, "left_anti").write.parquet(path)
    return _without(keyed, key_of, spark.read.parquet(path)).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too) have no language and go, whether or not there are labels to learn from."""
    model = language.fit(docs)
    ship(spark)
    if not model.languages:
        return docs.filter(language.lettered(F.col("text")))
    return docs.filter(language.label(F.col("text"), model)["lang_pred"] != "und")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that of the smallest id."""
    return _one_of_each(docs, exact.exact_dedup, "keep_id")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays, that of the smallest id (five words a shingle, similarity 0.8)."""
    return _one_of_each(docs, partial(neardup.near_duplicates, shingle=5, threshold=80), "component_id")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source takes it: not at all, once, or up to three times."""
    return mixing.repeated(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, whether they decode to its text, and the ids and score of its best path."""
    return pieces.encode_documents(docs, tokenizer(PIECES)).select("doc_id", "ids", "n_tokens", "round_trip", "best_ids", "best_score")


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("pieces", pieces_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scope(spark):  # what a stage wrote on its way goes with it, its input once it is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
