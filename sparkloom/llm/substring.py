"""Removal of repeated passages by level-wise doubling.

A window of ``length`` words that repeats has halves that repeat, so windows of half the length are looked at first,
and only where one repeats is it extended to twice its length. At the first level it is enough to look at anchors:
of the half windows in a full window, those with the least hash. Equal windows have equal anchors, so no repeat is
lost, and about one position in six is sent. What survives is hashed with two bases at the full length; of equal
windows the earliest stays and the words of the others are removed. Windows are told apart by these hashes, and words
by 64 bits: two different words are taken for one with a probability of 2^-64 a pair.

Before anything is shuffled, each task settles what it can see alone: an anchor it meets twice has survived, a
window it meets again is not the earliest. Of each it sends one on, so no key gathers more rows than there are tasks.
What arrives is sorted by key and read as a stream, so the size of a partition does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import in_groups, map_arrow, rows, with_totals
from sparkloom.llm.hashing import BASES, run_hashes, sliding, word_hashes
from sparkloom.workspace import materialise

LENGTH = 20
#: Rows that a task holds before it settles and sends them.
HELD = 4_000_000
EMPTY = sha256(b"").hexdigest()
NULL_ID = -(2**63)
_TOP = np.uint64(2**64 - 1)


def _half_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each text, half-window hashes, and the least of those in every full window (0: crosses texts)."""
    words, counts = word_hashes(texts)
    half = length // 2
    h = run_hashes(words, half) | np.uint64(1)
    if len(words) < length:
        return words, counts, h, np.empty(0, np.uint64)
    least = sliding(h, length - half + 1)
    ends = np.cumsum(counts)
    last = np.repeat(ends, counts)[: len(least)]
    least[np.arange(len(least)) + length > last] = 0
    return words, counts, h, least


def _arrays(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first, cut so that no key goes on in the next piece."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        x = _arrays(b)
        cut = int(np.searchsorted(x[0], x[0][-1]))
        if cut or (held and held[-1][0][-1] != x[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [y[:cut] for y in x], strict=True)]
            held = []
        held.append([y[cut:] for y in x])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _batch(names: list[str], cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cols[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in cols], names=names)


def anchors(base: DataFrame, length: int) -> DataFrame:
    """``(did, th, pos)`` of the anchors whose half window occurs more than once in the corpus."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for some in in_groups(((d, t, th) for d, th, t in rows(batches) if t)):
            texts = [t.encode() for _, t, _ in some]
            _, counts, h, least = _half_windows(texts, length)
            if not len(least):
                continue
            pad = np.zeros(length - length // 2, np.uint64)
            at = np.flatnonzero(h == sliding(np.concatenate([pad, least, pad])[: len(h) + len(pad)], len(pad) + 1, np.maximum))
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, at, "right")
            held.append((h[at].view(np.int64), np.array([d for d, _, _ in some], np.int64)[doc], np.array([x for _, _, x in some], np.int64)[doc], (at - (ends - counts)[doc]).astype(np.int32)))
            n += len(at)
            if n >= HELD:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, did, th, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, did, th, pos = key[order], did[order], th[order], pos[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        sure = same[1:] | same[:-1]
        spread = same[:-1]  # has survived already and need not meet the others of its key
        key = np.where(spread, run_hashes(key.view(np.uint64) + np.arange(len(key), dtype=np.uint64), 1).view(np.int64), key)
        yield from _batch(["k", "did", "th", "pos", "sure"], [key, did, th, pos, sure])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, did, th, pos, sure in _whole_keys(batches):
            same = np.zeros(len(key) + 1, bool)
            if len(key):
                same[1:-1] = key[1:] == key[:-1]
            at = same[1:] | same[:-1] | sure.astype(bool)
            yield from _batch(["did", "th", "pos"], [did[at], th[at], pos[at]])

    dealt = map_arrow(base, emit, "k long, did long, th long, pos int, sure boolean").repartition("k").sortWithinPartitions("k")
    return map_arrow(dealt, keep, "did long, th long, pos int")


def repeats(texts: DataFrame, length: int) -> DataFrame:
    """``(did, th, text, at)`` with surviving anchors → ``(did, th, start)`` of windows that also start earlier."""
    half = length // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for some in in_groups(((d, t, th, at) for d, th, t, at in rows(batches))):
            data = [t.encode() for _, t, _, _ in some]
            words, counts, h, least = _half_windows(data, length)
            if not len(least):
                continue
            first = np.cumsum(counts) - counts
            alive = np.full(len(h), _TOP)
            at = np.concatenate([np.asarray(x[3], np.int64) + f for x, f in zip(some, first, strict=True)])
            alive[at] = h[at]
            start = np.flatnonzero((sliding(alive, length - half + 1) == least) & (least != 0))
            doc = np.searchsorted(np.cumsum(counts), start, "right")
            one, two = (run_hashes(words, length, b)[start].view(np.int64) for b in BASES)
            held.append((one, two, np.array([x[0] for x in some], np.int64)[doc], (start - first[doc]).astype(np.int32), np.array([x[2] for x in some], np.int64)[doc]))
            n += len(start)
            if n >= HELD:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        one, two, did, start, th = (np.concatenate(x) for x in zip(*held, strict=True))
        again, order = _later(one, two, did, start)
        spread = run_hashes(one.view(np.uint64) + np.arange(len(one), dtype=np.uint64), 1).view(np.int64)
        one = np.where(again, spread, one)
        yield from _batch(["k1", "k2", "did", "start", "th", "again"], [x[order] for x in (one, two, did, start, th, again)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # the earliest of the key at hand
        for b in batches:
            if not b.num_rows:
                continue
            one, two, did, start, th, sure = _arrays(b)
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            new[0] = lead is None or (one[0], two[0]) != lead[:2]
            at = np.maximum.accumulate(np.where(new, np.arange(len(one)), -1))
            d, s = np.where(at < 0, did[0] if lead is None else lead[2], did[at]), np.where(at < 0, start[0] if lead is None else lead[3], start[at])
            again = (did != d) | (start != s) | sure.astype(bool)
            lead = (one[-1], two[-1], d[-1], s[-1])
            yield from _batch(["did", "th", "start"], [did[again], th[again], start[again]])

    dealt = map_arrow(texts, emit, "k1 long, k2 long, did long, start int, th long, again boolean").repartition("k1").sortWithinPartitions("k1", "k2", "did", "start")
    return map_arrow(dealt, keep, "did long, th long, start int")


def _later(one: np.ndarray, two: np.ndarray, did: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which occurrences come after the earliest of their key (the same id and start is the same place), and the order."""
    order = np.lexsort((start, did, two, one))
    again = np.zeros(len(one), bool)
    if len(one):
        k1, k2, d, s = one[order], two[order], did[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        again[order] = (d != d[lead]) | (s != s[lead])
    return again, order


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``.

    Null texts have no words. Ids order documents, null before all. Rows that repeat an id are one place in that
    order: a row is not a repeat of another with its id at the same start. Texts of fewer words than *length* lose
    nothing. Other columns are ignored.
    """
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(did.alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, th, t in rows(iter([b])):
                words = t.encode().split()
                out.append((d, th, len(words), sha256(b" ".join(words)).hexdigest()))
            d, th, n, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(th, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["did", "th", "n_words", "sha"])

    stats = materialise(map_arrow(base, measure, "did long, th long, n_words long, sha string"), "word-stats")
    # A whole text that stands earlier is a repeat from end to end, and adds no window of its own.
    each = stats.filter(F.col("n_words") >= length).select("sha", "did", "th").distinct()
    copies = materialise(with_totals(each, ["sha"], "did", {"first": (F.min("did"), F.min("first"))}).filter("did > first").select("did", "th").distinct(), "copies")

    alive = anchors(base, length).groupBy("did", "th").agg(F.collect_set("pos").alias("at"))
    alive = materialise(alive.join(copies, ["did", "th"], "left_anti"), "anchors")
    found = materialise(base.join(alive, ["did", "th"]).select("did", "th", "text", "at"), "repeat-texts")
    spans = repeats(found, length).groupBy("did", "th").agg(F.collect_set("start").alias("starts"))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, th, t, starts in rows(iter([b])):
                words = t.encode().split()
                cover = np.zeros(len(words) + 1, np.int32)
                starts = np.asarray(starts)
                cover[starts] += 1
                np.subtract.at(cover, starts + length, 1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((d, th, int(gone.sum()), sha256(kept).hexdigest()))
            d, th, n, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(th, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["did", "th", "n_removed", "kept_sha256"])

    struck = map_arrow(found.join(spans, ["did", "th"]).select("did", "th", "text", "starts"), strike, "did long, th long, n_removed long, kept_sha256 string")
    whole = copies.select("did", "th", F.lit(True).alias("copy"))
    out = stats.join(struck.dropDuplicates(["did", "th"]), ["did", "th"], "left").join(whole, ["did", "th"], "left")
    return out.select(
        F.nullif("did", F.lit(NULL_ID)).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


#: Windows as lists of words; a window whose list starts earlier somewhere covers words that go.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i AS start, array_to_string(w[i : i + 19], ' ') AS win FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
r AS (SELECT doc_id, start FROM s QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, start) > 1),
g AS (SELECT DISTINCT doc_id, start + k AS pos FROM r, unnest(range(0, 20)) AS u(k)),
e AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n > 0 THEN list_filter(w, lambda x, i: NOT list_contains(gone, i)) ELSE w END, ' ')) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id)
"""
