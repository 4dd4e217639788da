"""Near-duplicate documents by HyperMinHash, every link confirmed on the full sets.

A document is the set of its shingles' hashes. They fall into 64 buckets by their leading bits; of each bucket's least
value a register keeps the number of leading zeros and ten bits of mantissa. Bands of as many registers as the
threshold allows, four at most, name the buckets in which similar documents meet: a pair at the threshold fails to meet
with a probability of at most 1e-5 (7.4e-6 with sixteen bands of four at 0.85, 2.9e-7 with twenty-one of three at 0.8;
below a threshold of 0.17 single registers no longer reach that). Documents with one and the same set are one node from
the start.

Nobody compares all pairs of a bucket. In the first round every member meets only the smallest one, in the second
one chosen by hash, unless the two are connected already; what buckets still hold apart is then compared pair by
pair in small buckets. Members of large ones are joined by a prefix filter, exact for sets: shingles are ordered from
rare to frequent, and sets that meet the threshold share one of their first few. So what only a template has in
common is never compared, and no link between components is missed. Registers give a Jaccard estimate, corrected for
chance collisions; pairs within five standard errors of the threshold go on to the comparison of the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import in_groups, map_arrow, rows, ship, with_totals
from sparkloom.llm.graph import Joined, components
from sparkloom.llm.hashing import BASES, mix, run_hashes, word_hashes
from sparkloom.workspace import materialise

SHINGLE = 3
THRESHOLD = 85  # percent
BUCKET_BITS, MANTISSA = 6, 10
BUCKETS = 1 << BUCKET_BITS
BAND = 4  # registers in a band, at most
MISS = 1e-5  # how likely a pair at the threshold may meet in no band
#: Members up to which a bucket is compared pair by pair; members, and set values, of a block of a larger one.
SMALL = 16
BLOCK, BLOCK_VALUES = 512, 1_000_000
COLUMNS = 4096
#: Pairs of one document beyond which its set is sent to more tasks than one.
FAN = 512
_EDGES = np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = [(t or "").encode().lower() for t in texts]  # bytes: A-Z alone
    words, counts = word_hashes(data)
    runs = run_hashes(words, shingle)
    out, at = [], 0
    for n in counts.tolist():
        if n >= shingle:
            out.append(np.unique(runs[at : at + n - shingle + 1]))
        elif n:
            out.append(mix(run_hashes(words[at : at + n], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set; 0 where a bucket is empty."""
    at = np.searchsorted(s, _EDGES[:-1])
    full = (at < len(s)) & (s[np.minimum(at, len(s) - 1)] >> np.uint64(64 - BUCKET_BITS) == np.arange(BUCKETS, dtype=np.uint64)) if len(s) else np.zeros(BUCKETS, bool)
    rest = np.where(full, s[np.minimum(at, len(s) - 1)] if len(s) else np.uint64(0), np.uint64(0)) << np.uint64(BUCKET_BITS)
    _, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return np.where(full, ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa, np.uint64(0)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers and the number of buckets they rest on."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    ratio = n / np.maximum(m, 1)
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, equal - chance) / np.maximum(used, 1), used


def plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """False only for pairs that sizes exclude, or that lie five standard errors below the threshold."""
    t = threshold / 100
    j, used = estimate(a, b, n, m)
    return (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & (j >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1 / BUCKETS)


def _regs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _signatures(base: DataFrame, shingle: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_groups(rows(batches)):
            sets = shingle_sets([t for _, t in some], shingle)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in some], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                names=["did", "n", "fp", "regs"],
            )

    return map_arrow(base, sign, "did long, n long, fp binary, regs binary")


def band_size(threshold: int) -> int:
    """The most registers in a band with which a pair at *threshold* percent is missed with at most ``MISS``."""
    return next((k for k in range(BAND, 1, -1) if (1 - (threshold / 100) ** k) ** (BUCKETS // k) <= MISS), 1)


def _bands(nodes: DataFrame, band: int) -> DataFrame:
    """``(key, rep)`` for every band that is not empty."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            full = np.zeros((b.num_rows, BUCKETS // band, BAND), np.uint16)
            full[:, :, :band] = _regs(b.column(1))[:, : BUCKETS // band * band].reshape(b.num_rows, -1, band)
            packed = full.view(np.uint64)[:, :, 0]  # a band's registers in one number
            keys = mix(packed + np.arange(packed.shape[1], dtype=np.uint64)[None, :] * np.uint64(BASES[1]))
            i, j = np.nonzero(packed)
            yield pa.RecordBatch.from_arrays([pa.array(keys[i, j].view(np.int64)), pa.array(b.column(0).to_numpy(zero_copy_only=False)[i])], names=["key", "rep"])

    return map_arrow(nodes.select("rep", "regs"), name, "key long, rep long")


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``(hub, b)`` → ``(a, b)``, a < b, of those whose full sets meet the threshold.

    A hub may have any number of pairs: they are dealt in parts of about FAN, and each part has a copy of its set.
    Hubs of more than one part are few, one for FAN pairs at most, so every task has their list. *pairs* are written.
    """
    counted = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("parts"))
    sized = pairs.select("hub", "b").join(F.broadcast(counted.filter("parts > 1")), "hub", "left")
    sized = sized.select("hub", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts").cast("int"), F.lit(0)).alias("part"))
    hubs = counted.select("hub", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    side = lambda x: nodes.select(F.col("rep").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.table(b)
                n, m = (t.column(x).to_numpy().astype(float) for x in ("n_hub", "n_b"))
                at = np.flatnonzero(plausible(_regs(t.column("regs_hub")), _regs(t.column("regs_b")), n, m, threshold))
                yield b.select(["hub", "part", "b"]).take(pa.array(at))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out = [], []
            for a, b, s, t in rows(iter([batch])):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= threshold * (len(s) + len(t) - both):
                    a_out.append(min(a, b))
                    b_out.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    registered = sized.join(hubs.join(side("hub"), "hub"), ["hub", "part"]).join(side("b"), "b")
    maybe = map_arrow(registered.select("hub", "part", "b", "regs_hub", "regs_b", "n_hub", "n_b"), likely, "hub long, part int, b long")
    held = lambda x: sets.select(F.col("rep").alias(x), F.col("s").alias(f"s_{x}"))
    both = maybe.join(hubs.join(held("hub"), "hub"), ["hub", "part"]).join(held("b"), "b")
    return map_arrow(both.select("hub", "b", "s_hub", "s_b"), confirm, "a long, b long")


def _span() -> dict[str, tuple[Column, Column]]:
    """The smallest and the largest component among the rows of a key."""
    return {"lo": (F.min("comp"), F.min("lo")), "hi": (F.max("comp"), F.max("hi"))}


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their components and that of the drawn one, of the buckets that still hold more than one."""
    m = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component", "n")
    own = F.min(F.when(F.col("rep") == F.col("drawn"), F.col("comp")))
    return with_totals(m, ["key"], "rep", _span() | {"other": (own, F.min("other"))}, "lo <> hi")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections, as products of incidence columns, a few thousand values at a time."""
    rows_of = lambda sets: np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    both, (a, b) = np.intersect1d(np.concatenate(left), np.concatenate(right)), (rows_of(left), rows_of(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), COLUMNS):
        part = both[at : at + COLUMNS]
        sides = []
        for sets, owner in ((left, a), (right, b)):
            v = np.concatenate(sets)
            k = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[k] == v
            m = np.zeros((len(sets), len(part)), np.float32)
            m[owner[hit], k[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _bridges(pairs: np.ndarray) -> np.ndarray:
    """Indices of those pairs of components that join what was apart until then."""
    up = Joined()
    return np.array([i for i, (x, y) in enumerate(pairs.tolist()) if up.join(x, y)], np.int64)


def _prefixes(held: DataFrame, threshold: int) -> DataFrame:
    """``(rep, comp, s)`` → ``(token, rep, comp, size, pos)``: the first tokens of each set, rarest first.

    Any order that is the same for all sets makes the filter exact. Tokens are counted one by one, as counters that
    tokens share fill up with the table: then what many sets hold gets into the prefixes, and clusters run together.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = [np.frombuffer(s, np.int64) for s in b.column(1).to_pylist()]
                owner = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(owner)], names=["token", "rep"])

    counted = with_totals(map_arrow(held.select("rep", "s"), spread, "token long, rep long"), ["token"], "rep")  # in one set: no row
    often = counted.groupBy("rep").agg(F.collect_list(F.struct("token", "n")).alias("often"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rep, comp, s, tokens, counts = (c[i] for c in batch.columns)
                s = np.frombuffer(s.as_py(), np.uint64)
                times = np.ones(len(s), np.int64)
                if tokens.is_valid:
                    t, c = (x.values.to_numpy(zero_copy_only=False) for x in (tokens, counts))
                    at = np.minimum(np.searchsorted(s, t.view(np.uint64)), len(s) - 1)
                    own = s[at] == t.view(np.uint64)  # not those of another set under the same id
                    times[at[own]] = c[own]
                n = len(s) + (-threshold * len(s) // 100) + 1  # all but the number that must be shared, and one
                first = s[np.lexsort((s, times))[:n]]
                same = lambda x, t: pa.array(np.full(n, x), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), same(rep.as_py(), pa.int64()), same(comp.as_py(), pa.int64()), same(len(s), pa.int64()), pa.array(np.arange(n, dtype=np.int32))], names=["token", "rep", "comp", "size", "pos"])

    ranked = held.join(often, "rep", "left").select("rep", "comp", "s", F.col("often.token").alias("tokens"), F.col("often.n").alias("counts"))
    return map_arrow(ranked, cut, "token long, rep long, comp long, size long, pos int")


def _rest(apart: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """What still has to be compared, as pairs ``(hub, b)`` to test, and links that are confirmed already.

    Small buckets give the pairs of different components in them. Members of large ones meet by the tokens of their
    prefixes: rare tokens give pairs too. What shares a token that is frequent in the prefixes themselves is gathered
    in clusters (tokens that share a member are one), each is cut into blocks of bounded size, and every two blocks
    meet in one task, which compares full sets and gives back only links between components, one for each join.
    """
    members = apart.filter(F.col("n") > SMALL).groupBy("rep").agg(F.min("comp").alias("comp")).join(sets, "rep")
    cut = materialise(_prefixes(materialise(members, "members"), threshold), "tokens")  # read twice
    tokens = materialise(with_totals(cut, ["token"], "rep", _span(), "lo <> hi"), "prefixes")
    pairs = None
    for rows_, key, extra in ((apart, "key", ()), (tokens, "token", ("size", "pos"))):
        some = rows_.filter(F.col("n") <= SMALL)
        x, y = (some.select(key, *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "comp", *extra)]) for side in "xy")
        met = x.join(y, key).filter("rep_x < rep_y AND comp_x <> comp_y")
        if extra:
            # At the first token that two sets share, no more than the shorter rest of both can be shared.
            most = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))
            met = met.filter((100 + threshold) * most >= threshold * (F.col("size_x") + F.col("size_y")))
        met = met.select(F.col("rep_x").alias("hub"), F.col("rep_y").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)

    large = tokens.filter(F.col("n") > SMALL).select(F.col("token").alias("key"), "rep", "comp", "size")
    heads = large.groupBy("key").agg(F.min("rep").alias("head"))
    met = materialise(large.join(heads, "key").select(F.col("rep").alias("a"), F.col("head").alias("b")), "edges")
    cluster = materialise(components(met), "clusters")
    in_cluster = cluster.select(F.col("node").alias("rep"), F.col("component").alias("cl"))

    # A cluster may hold most of the table: it is dealt before the sets come to its members.
    own = large.groupBy("rep").agg(F.min("comp").alias("comp"), F.max("size").alias("size")).join(in_cluster, "rep")
    own = with_totals(own, ["cl"], "rep", {"values": (F.sum("size"), F.sum("values"))}, "true")
    own = own.withColumn("parts", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("values") / BLOCK_VALUES)).cast("int"))
    dealt = own.withColumn("i", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("cl", "rep", "comp", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i").join(sets, "rep")
    ship(apart.sparkSession)

    def compare(t: pa.Table) -> pa.Table:
        rep, comp, i = (t.column(c).to_numpy() for c in ("rep", "comp", "i"))
        values = [np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()]
        left, right = np.flatnonzero(i == t.column("x")[0].as_py()), np.flatnonzero(i == t.column("y")[0].as_py())
        a = b = np.empty(0, np.int64)
        if len(left) and len(right):
            shared = _shared([values[k] for k in left], [values[k] for k in right])
            n, m = (np.array([len(values[k]) for k in side], np.float32) for side in (left, right))
            p, q = np.nonzero((100 * shared >= threshold * (n[:, None] + m[None, :] - shared)) & (comp[left][:, None] != comp[right][None, :]))
            a, b = rep[left[p]], rep[right[q]]
            kinds, first = np.unique(np.stack([comp[left[p]], comp[right[q]]], axis=1), axis=0, return_index=True)
            at = first[_bridges(kinds)]
            a, b = a[at], b[at]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return pairs, dealt.groupBy("cl", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * shared >= threshold * united`` shingles. Texts without words (null, empty) are
    linked with nothing; so are rows with a null id, whose component is null and which are kept. Rows that repeat are
    in one component and share the verdict. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(_signatures(base, shingle), "signatures")
    live = signed.filter("n > 0 AND did IS NOT NULL")
    nodes = materialise(live.groupBy("fp").agg(F.min("did").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "nodes")
    bands = _bands(nodes, band_size(threshold))
    drawn = {"least": (F.min("rep"), F.min("least")), "at": (F.min(F.xxhash64("rep")), F.min("at")), "drawn": (F.min_by("rep", F.xxhash64("rep")), F.min_by("drawn", "at"))}
    members = materialise(with_totals(bands, ["key"], "rep", drawn).drop("at"), "members")

    wanted = members.select(F.col("rep").alias("did")).distinct()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_groups(rows(batches)):
            sets = shingle_sets([t for _, t in some], shingle)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "s"])

    chosen = base.join(wanted, "did", "left_semi").select("did", "text")
    sets = materialise(map_arrow(chosen, to_sets, "rep long, s binary"), "sets")

    tested = materialise(members.filter("rep <> least").select(F.col("least").alias("hub"), F.col("rep").alias("b")).distinct(), "pairs")
    links = materialise(_links(tested, nodes, sets, threshold), "links")
    labels = materialise(components(links), "labels")
    for step in ("drawn", "rest"):
        apart = materialise(_apart(members, labels), "apart")
        if apart.isEmpty():
            break
        if step == "drawn":
            pairs = apart.filter("comp <> other").select(F.col("drawn").alias("hub"), F.col("rep").alias("b"))
        else:
            pairs, sure = _rest(apart, sets, threshold)
            links = links.unionByName(materialise(sure, "links"))
        both = lambda p: p.withColumns({"low": F.least("hub", "b"), "high": F.greatest("hub", "b")})
        fresh = both(pairs).dropDuplicates(["low", "high"]).join(both(tested).select("low", "high"), ["low", "high"], "left_anti")
        fresh = materialise(fresh.select("hub", "b"), "pairs")
        links = links.unionByName(materialise(_links(fresh, nodes, sets, threshold), "links"))
        labels = materialise(components(links), "labels")
        tested = tested.unionByName(fresh)

    place = nodes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("comp"))
    out = signed.join(place, "fp", "left")
    comp = F.when(F.col("n") > 0, F.when(F.col("did").isNotNull(), F.col("comp"))).otherwise(F.col("did"))
    return out.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("did").eqNullSafe(comp).alias("kept"))


#: Sets of shingles as text; all pairs that share one are counted, then components by repeated least neighbours.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS size FROM h),
x AS (SELECT doc_id, unnest(s) AS shingle FROM h),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.size + nb.size - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS least FROM n UNION SELECT e.b, reach.least FROM reach JOIN e ON e.a = reach.node WHERE reach.least < e.b),
k AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(size AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k ON node = doc_id
"""
