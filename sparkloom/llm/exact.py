"""Exact dedup by deterministic block naming, in DataFrame operations alone.

Every text is cut into blocks of fixed size. The distinct blocks are sorted and each gets an integer, its name; then
adjacent names are paired and the distinct pairs sorted and named, until one name is left per document. Equal names
mean equal texts: no step relies on a hash being free of collisions. A digest only rules documents out beforehand:
a text whose SHA-256 occurs once has no equal, and so needs no name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SALTS, norm_text, text_of, with_totals
from sparkloom.workspace import materialise

BLOCK_CHARS = 16_384


def _name(values: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The distinct *values* with an integer each, ascending in order of (hash, value).

    Ranges are cut by the hash, so what the driver samples to find them is a number per value and not a block.
    """
    ordered = values.select(*keys).distinct().withColumn("at", F.xxhash64(*keys)).repartitionByRange("at").sortWithinPartitions("at", *keys).drop("at")
    return materialise(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def _named(level: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``(rid, pos, *keys)`` → ``(rid, pos, name)``. A value that many rows have is dealt by a salt, so that no task gets them all."""
    dealt = level.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    held = dealt.select(*keys, "salt").distinct()
    names = held.join(_name(held, keys, label), keys)
    return dealt.join(names, [*keys, "salt"]).select("rid", "pos", "name")


def identities(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(rid, t)``, one text per rid → ``(rid, name)``, one row per rid; names are equal exactly if the texts are."""
    cut = F.when(F.length("t") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = materialise(texts.select("rid", F.posexplode(cut).alias("pos", "block")), "blocks")
    level = _named(blocks, ["block"], "block-names")
    longest = blocks.agg(F.max("pos")).first()[0] or 0
    while longest > 0:
        at = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = materialise(level.groupBy("rid", F.expr("pos div 2").alias("pos")).agg(at(0).alias("a"), F.coalesce(at(1), F.lit(-1)).alias("b")), "pairs")
        level = _named(pairs, ["a", "b"], "pair-names")
        longest //= 2
    return level.select("rid", "name").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty; texts that differ only in runs of ASCII white space are equal. ``keep_id`` is the
    smallest id of the group and ``kept`` tells whether the row has it. Rows that repeat both id and text stand or
    fall together, and each counts in ``group_size``. Null ids are kept apart from others: such a row is kept only
    if its whole group has null ids. An empty table gives an empty result; other columns are ignored.
    """
    base = text_of(docs, id_col, text_col).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    slim = materialise(base.select("doc_id", "th", F.sha2(norm_text("text"), 256).alias("text_sha256")), "digests")
    each = slim.groupBy("doc_id", "th", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    cand = with_totals(each, ["text_sha256"], "doc_id", {"rows": (F.sum("times"), F.sum("rows"))}, "rows > 1").select("doc_id", "th", "text_sha256", "times")
    cand = materialise(cand.withColumn("rid", F.monotonically_increasing_id()), "candidates")
    # The one shuffle of whole texts. The list of candidates grows with the table, so it is never broadcast; a
    # partition's share of it is far smaller than its texts, so it is hashed and the texts need not be sorted.
    held = cand.select(F.col("doc_id").alias("cid"), F.col("th").alias("cth"), F.col("text_sha256").alias("csha"), "rid")
    found = base.join(held.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth"))).select("rid", "csha", norm_text("text").alias("t"))
    texts = found.filter(F.sha2("t", 256) == F.col("csha")).select("rid", "t")
    named = materialise(identities(texts, block_chars).join(cand, "rid").select("name", "doc_id", "text_sha256", "times"), "identities")
    named = with_totals(named, ["name"], "doc_id", {"keep_id": (F.min("doc_id"), F.min("keep_id")), "group_size": (F.sum("times"), F.sum("group_size"))}, "true")
    verdict = named.select(F.col("doc_id").alias("vid"), F.col("text_sha256").alias("vsha"), "keep_id", "group_size").distinct()
    out = slim.join(verdict, F.col("doc_id").eqNullSafe(F.col("vid")) & (F.col("text_sha256") == F.col("vsha")), "left")
    keep = F.when(F.col("vsha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
