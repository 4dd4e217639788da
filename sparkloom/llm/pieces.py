"""SentencePiece encoding and decoding, with giant documents cut into chunks.

The best segmentation under the pieces' scores is a path through a lattice. A chunk of the text is summed up by a
max-plus matrix: entry (s, t) is the best score of covering the chunk if the first s characters were taken by a piece
that began before it and the last piece reaches t characters beyond it. Matrices multiply associatively, so chunks are
reduced in any grouping; the products' best path fixes the state at every cut, and each chunk is then backtraced on
its own. Chunks are cut anywhere, in the middle of a word too.

A BPE model (such as the public one) holds pieces and scores, but its own encoder merges greedily and does not look
for the path of the best score. ``encode_documents`` gives both: the library's ids, and the ids of the best path. For
the former, giant texts are cut where no piece holds the two characters on either side, so that no merge could have
crossed; the ids are the library's for the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Out, TwoGenerations, in_groups, map_arrow, rows, text_of
from sparkloom.workspace import materialise

CHUNK_CHARS = 1 << 16
#: Transfer matrices that one task multiplies.
FAN = 64
#: Units that a worker keeps at hand (twice as many at most).
MOST_KEPT = 150_000
NONE = -np.inf
#: A run of this many characters, none worse than LEAST, has a sum that single precision holds exactly.
RUN, LEAST = 400, -40_000.0
MARK = "\u2581"
_LEAD = re.compile(r"[^ \n]*")
_UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


# ---- unigram lattices


class Lexicon:
    """Pieces with scores; a character that no piece covers costs *unknown*."""

    def __init__(self, scores: dict[str, float], unknown: float = -100.0):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)
        self.prefixes = frozenset(p[:n] for p in scores for n in range(1, len(p)))

    def arcs(self, text: str, i: int) -> Iterator[tuple[int, float]]:
        """Lengths and scores of what can start at i; a single character always can."""
        for n in range(1, min(self.longest, len(text) - i) + 1):
            part = text[i : i + n]
            s = self.scores.get(part, self.unknown if n == 1 else None)
            if s is not None:
                yield n, s
            if part not in self.prefixes:
                return

    def transfer(self, text: str, lo: int, hi: int) -> np.ndarray:
        """The chunk ``text[lo:hi]`` as a max-plus matrix of overhangs before and after; what follows may be looked at.

        One pass carries all overhangs before the chunk along: a row of best scores for every position.
        """
        k, n = self.longest, hi - lo
        best = np.full((n + 2 * k, k), NONE)
        best[np.arange(k), np.arange(k)] = 0.0
        for i in range(n):
            row = best[i]
            for length, s in self.arcs(text, lo + i):
                to = best[i + length]
                np.maximum(to, row + s, out=to)
        return best[n : n + k].T.copy()

    def backtrace(self, text: str, lo: int, hi: int, s: int, t: int) -> list[str]:
        """The pieces that begin in the chunk, given its states."""
        if lo + s >= hi:
            return []
        best, back = {lo + s: 0.0}, {}
        for i in range(lo + s, hi):
            if (at := best.get(i)) is not None:
                for n, x in self.arcs(text, i):
                    if at + x > best.get(i + n, NONE):
                        best[i + n], back[i + n] = at + x, i
        out, end = [], hi + t
        while end > lo + s:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], first: int = 0, last: int = 0) -> list[int]:
    """State at every cut on the best path between two overhangs: prefix products, then backwards."""
    prefix = [np.where(np.arange(len(matrices[0])) == first, 0.0, NONE)[None, :]]
    for m in matrices:
        prefix.append(max_plus(prefix[-1], m))
    at = [last]
    for p, m in zip(prefix[-2::-1], matrices[::-1], strict=True):
        at.append(int(np.argmax(p[0] + m[:, at[-1]])))
    return at[::-1]


def segment(lexicon: Lexicon, text: str, chunk: int = CHUNK_CHARS) -> list[str]:
    """Best segmentation of *text*, chunk by chunk (every chunk's two passes are independent of the others)."""
    cuts = [*range(0, len(text), chunk), len(text)]
    spans = list(zip(cuts, cuts[1:], strict=False))
    if not spans:
        return []
    at = states([lexicon.transfer(text, lo, hi) for lo, hi in spans])
    return [p for (lo, hi), s, t in zip(spans, at, at[1:], strict=False) for p in lexicon.backtrace(text, lo, hi, s, t)]


def best_states(chunks: DataFrame, lexicon: Lexicon, fan: int = FAN) -> DataFrame:
    """``(row, chunk, part, ahead)`` → ``(row, chunk, s, t)``: the overhangs of every chunk on its row's best path.

    *fan* neighbouring matrices are multiplied into one, level by level, until each row has one; on the way back every
    level fixes the states at its cuts. No task holds more than *fan* matrices of a row.
    """
    k = lexicon.longest
    summed = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("m", pa.binary())])
    fixed = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("s", pa.int32()), ("t", pa.int32())])
    matrix = lambda b: np.frombuffer(b).reshape(k, k)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(summed)
        for row, c, part, ahead in rows(batches):
            if out.add((row, c, lexicon.transfer(part + ahead, 0, len(part)).tobytes()), 8 * k * k):
                yield out.take()
        yield out.take()

    def ordered(t: pa.Table) -> list[dict]:
        return sorted(t.to_pylist(), key=lambda x: x["chunk"])

    def multiply(t: pa.Table) -> pa.Table:
        x = ordered(t)
        product = reduce(max_plus, [matrix(y["m"]) for y in x])
        return pa.Table.from_pylist([{"row": x[0]["row"], "chunk": x[0]["chunk"] // fan, "m": product.tobytes()}], summed)

    def fix(parent: pa.Table, children: pa.Table) -> pa.Table:
        (p,), x = parent.to_pylist(), ordered(children)
        at = states([matrix(y["m"]) for y in x], p["s"], p["t"])
        return pa.Table.from_pylist([{"row": y["row"], "chunk": y["chunk"], "s": s, "t": t} for y, s, t in zip(x, at, at[1:], strict=False)], fixed)

    dealt = chunks.select("row", "chunk", "part", "ahead").repartition("row", "chunk")
    levels = [materialise(map_arrow(dealt, sum_up, "row long, chunk long, m binary"), "matrices")]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        levels.append(materialise(levels[-1].groupBy("row", F.expr(f"chunk div {fan}").alias("up")).applyInArrow(multiply, "row long, chunk long, m binary"), "matrices"))
    known = levels.pop().select("row", "chunk", F.lit(0).alias("s"), F.lit(0).alias("t"))
    for level in reversed(levels):
        below = level.withColumn("up", F.expr(f"chunk div {fan}"))
        known = materialise(known.groupBy("row", "chunk").cogroup(below.groupBy("row", "up")).applyInArrow(fix, "row long, chunk long, s int, t int"), "states")
    return known


def segment_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, fan: int = FAN) -> DataFrame:
    """One row per input row: ``doc_id, pieces, n_chunks``, the best segmentation under a unigram lexicon.

    Texts beyond ``chunk_chars`` are cut, and their chunks summed up as transfer matrices all over the cluster. *fan*
    neighbouring matrices are multiplied into one, level by level, until each document has one; on the way back every
    level fixes the states at its cuts; then each chunk is backtraced where it lies. No task holds more than *fan*
    matrices of a document. Of equally good segmentations any may come. A null or empty text has no pieces; rows that
    repeat are segmented each.
    """
    base, k = text_of(docs, id_col, text_col), lexicon.longest
    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    whole = pa.schema([("doc_id", pa.int64()), ("pieces", pa.list_(pa.string()))])
    cut = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int64()), ("part", pa.string()), ("ahead", pa.string())])
    traced = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("pieces", pa.list_(pa.string()))])

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(whole)
        for doc_id, text in rows(batches):
            if out.add((doc_id, segment(lexicon, text or "", chunk_chars)), len(text or "")):
                yield out.take()
        yield out.take()

    def cut_giants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, row = Out(cut), TaskContext.get().partitionId() << 33
        for doc_id, text in rows(batches):
            row += 1
            for c, lo in enumerate(range(0, len(text), chunk_chars)):
                hi = lo + chunk_chars
                if out.add((doc_id, row, c, text[lo:hi], text[hi : hi + k]), chunk_chars):
                    yield out.take()
        yield out.take()

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(traced)
        for row, doc_id, c, part, ahead, s, t in rows(batches):
            if out.add((row, doc_id, c, lexicon.backtrace(part + ahead, 0, len(part), s, t)), len(part)):
                yield out.take()
        yield out.take()

    small = map_arrow(base.filter(~giant), at_once, "doc_id long, pieces array<string>").withColumn("n_chunks", F.lit(1))
    # Rows are numbered within a task: the numbers are written before anything is joined by them.
    chunks = materialise(map_arrow(base.filter(giant), cut_giants, "doc_id long, row long, chunk long, part string, ahead string"), "chunks")
    known = best_states(chunks, lexicon, fan)
    parts = map_arrow(chunks.join(known, ["row", "chunk"]).select("row", "doc_id", "chunk", "part", "ahead", "s", "t"), trace, "row long, doc_id long, chunk long, pieces array<string>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pieces"))), lambda x: x["pieces"]))
    large = parts.groupBy("row", "doc_id").agg(joined.alias("pieces"), F.count(F.lit(1)).cast("int").alias("n_chunks")).drop("row")
    return small.unionByName(large)


# ---- the model's own encoding


class ModelLexicon(Lexicon):
    """That of a model; tasks are told the model's path and have its pieces from there."""

    def __init__(self, path: str, scores: dict[str, float], unknown: float):
        super().__init__(scores, unknown)
        self.path = path

    def __reduce__(self):
        return _lexicon, (self.path,)


class PieceEncoder:
    """Ids of a SentencePiece BPE model whose normaliser leaves the text alone, each distinct unit encoded once.

    A unit is a run of spaces with the word behind it, or a line feed with what follows; no piece runs across the
    start of a unit. The library's own encoding of models without these properties goes text by text; their best
    paths are not offered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model_path = path
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.space = self.sp.piece_to_id(MARK)
        self.piece_ids = {p: i for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))}
        self.normal = frozenset(self.piece_ids.values())
        scores = {p: self.sp.get_score(i) for p, i in self.piece_ids.items()}
        #: As the library has it: what no piece covers costs ten more than the worst piece.
        self.lexicon = ModelLexicon(path, scores, min(scores.values(), default=0.0) - 10.0)
        #: Two characters next to each other in some piece; between any others no piece reaches across.
        self.bound = frozenset(p[i : i + 2] for p in self.piece_ids for i in range(len(p) - 1))
        plain = all("\u2581" not in p[1:] or not p.strip("\u2581") for p in pieces) and not any("\n" in p for p in pieces)
        probe = " a  b \n c \ufb01 \uff21 e\u0301"
        self.by_unit = plain and self.sp.decode(self.sp.encode(probe)) == probe and self.sp.encode("\n")[0] == self.space
        self.line_feed = self.sp.encode("\n")[-1]
        self.leads = np.array([p.startswith("\u2581") for p in pieces])
        self.byte_ids = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(self.sp.is_byte(i) for i in range(len(pieces))) else []
        self.bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]
        self.kept = TwoGenerations(MOST_KEPT)

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.sp.is_control(i):
            return b""
        if self.sp.is_unknown(i):
            return " \u2047 ".encode()
        return bytes([int(piece[1:-1], 16)]) if self.sp.is_byte(i) else piece.replace("\u2581", " ").encode()

    def _merged(self, units: list[str]) -> dict[str, bytes]:
        """The library's ids. Units of one space and a word are encoded in one run of text: only their first pieces hold the space."""
        out = {}
        spaced = [u for u in units if u[0] == " " and u[1:2] not in ("", " ")]
        if spaced:
            ids = np.array(self.sp.encode("".join(spaced)[1:]), "<u4")
            cuts = [*(np.flatnonzero(self.leads[ids]) * 4).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            for u, at, end in zip(spaced, cuts[:-1], cuts[1:], strict=True):
                out[u] = raw[at:end]
        for u in units:
            if u[0] != " ":  # the library's dummy space is one piece of its own before a line feed
                out[u] = np.array(self.sp.encode(u)[1:], "<u4").tobytes()
            elif u[1:2] in ("", " "):
                out[u] = np.array(self.sp.encode(u[1:]) if u[1:] else [self.space], "<u4").tobytes()
        return out

    def ids_of(self, pieces: list[str]) -> bytes:
        """A character that is no piece is spelled in bytes, or unknown to models without them."""
        out: list[int] = []
        for p in pieces:
            i = self.piece_ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.sp.unk_id())
        return np.array(out, "<u4").tobytes()

    def path(self, pieces: list[str]) -> tuple[bytes, float]:
        score = self.lexicon.scores.get
        return self.ids_of(pieces), sum([score(p, self.lexicon.unknown) for p in pieces])

    @cached_property
    def unigram(self):
        """The library's own search for the best path, for units alone: its single precision is exact for short runs.

        Scores that no path of a unit can use are raised, as single precision would lose the others beside them.
        """
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(self.model_path, "rb") as f:
            model.ParseFromString(f.read())
        model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
        self.costs = np.zeros(len(model.pieces))
        for i, p in enumerate(model.pieces):
            if i in self.normal:
                self.costs[i] = p.score
                p.score = max(p.score, LEAST)
        for b, i in enumerate(self.byte_ids):
            self.costs[i] = 0.0 if 0x80 <= b < 0xC0 else self.lexicon.unknown  # once a character
        return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def _best(self, units: list[str]) -> dict[str, tuple[bytes, float]]:
        """Ids and scores. Units of one space and a word are searched in runs of bounded cost, others one by one."""
        out, runs, size, rest = {}, [[]], 0, []
        for u in units:
            if u[0] != " " or u[1:2] in ("", " ") or len(u) > RUN or not self.byte_ids:
                rest.append(u)
                continue
            size += len(u)
            if size > RUN:
                runs.append([])
                size = len(u)
            runs[-1].append(u)
        unigram = self.unigram
        for run, found in zip(runs, unigram.encode(["".join(r)[1:] for r in runs], num_threads=1), strict=True):
            if not run:
                continue
            ids = np.array(found, "<u4")
            cuts = np.flatnonzero(self.leads[ids])
            scores = np.add.reduceat(self.costs[ids], cuts).tolist()
            raw, at = ids.tobytes(), [*(cuts * 4).tolist(), 4 * len(ids)]
            for u, lo, hi, score in zip(run, at[:-1], at[1:], scores, strict=True):
                out[u] = (raw[lo:hi], score)
        for u in rest:
            t = u.replace(" ", MARK)
            out[u] = self.path(self.lexicon.backtrace(t, 0, len(t), 0, 0))
        return out

    def encode_inner(self, t: str) -> bytes:
        """Ids of a chunk within a text: no space is put before it."""
        lead = _LEAD.match(t).end()  # the rest of a word; a line feed keeps the library's dummy space off it
        return (np.array(self.sp.encode("\n" + t[:lead])[2:], "<u4").tobytes() if lead else b"") + (self.encode_all([t[lead:]])[0] if lead < len(t) else b"")

    def encode_all(self, marked: list[str], best: list | None = None) -> list[bytes]:
        """Ids of texts that start with a space or a line feed, which stand for themselves.

        *best* gets ids and score of each text's best path, put together from those of its units.
        """
        self.kept.tidy()
        get, lost, out = self.kept.__getitem__, {}, [b""] * len(marked)
        paths: list[tuple[bytes, float]] = [(b"", 0.0)] * len(marked)

        def put(i: int, units: list[str]) -> None:
            found = list(map(get, units))
            out[i] = b"".join([f[0] for f in found])
            if best is not None:
                paths[i] = b"".join([f[1] for f in found]), sum([f[2] for f in found])

        for i, t in enumerate(marked):
            if "  " in t or " \n" in t or "\0" in t:
                units = _UNIT.findall(t)
            else:
                units = t.replace(" ", "\0 ").replace("\n", "\0\n")[1:].split("\0")
            try:
                put(i, units)
            except KeyError:
                lost[i] = units
        if lost:
            fetch = self.kept.fetch
            new = [u for u in set().union(*lost.values()).difference(self.kept) if fetch(u) is None]
            merged, path = self._merged(new), self._best(new)
            for u in new:
                ids, (best_ids, score) = merged[u], path[u]
                self.kept[u] = (ids, ids if ids == best_ids else best_ids, score)
            for i, units in lost.items():
                put(i, units)
        if best is not None:
            best += paths
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers, as the library gives them."""
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str | None], best: list | None = None) -> list[bytes]:
        """The space's own mark in a text is a space to the model. *best* gets each text's best path and score."""
        if not self.by_unit:
            return [np.array(self.sp.encode(t or ""), "<u4").tobytes() for t in texts]
        full = [i for i, t in enumerate(texts) if t]
        out, paths = [b""] * len(texts), []
        for i, ids in zip(full, self.encode_all([" " + texts[i].replace(MARK, " ") for i in full], None if best is None else paths), strict=True):
            out[i] = ids
        if best is not None:
            best += [(b"", 0.0)] * len(texts)
            for i, x in zip(full, paths, strict=True):
                best[i - len(texts)] = x
        return out

    def chunks(self, text: str, size: int) -> list[str]:
        """Cut at, or as soon as possible beyond, each multiple of *size*, where no piece reaches across."""
        out, lo, t = [], 0, text.replace(" ", MARK)
        while len(t) - lo > size:
            hi = next((i for i in range(lo + size, len(t)) if t[i - 1 : i + 1] not in self.bound), len(t))
            out.append(text[lo:hi])
            lo = hi
        return [*out, text[lo:]] if lo < len(text) or not out else out

    def decode(self, ids: bytes, inner: bool = False) -> str:
        """*inner*: a chunk within a text, whose first space is not the dummy one."""
        raw = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw if inner or raw[:1] != b" " else raw[1:]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _lexicon(path: str) -> Lexicon:
    return piece_encoder(path).lexicon


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, fan: int = FAN) -> DataFrame:
    """One row per input row: ``doc_id, ids, n_tokens, n_chunks, round_trip, best_ids, n_best, best_score``.

    ``ids`` are the library's, as little-endian unsigned 32-bit integers, ``round_trip`` tells that they decode to the
    text (null counts as empty). ``best_ids`` are those of the path with the largest sum of scores, which is
    ``best_score``; of equal paths one is chosen that depends on the text and *chunk_chars* alone. Texts beyond
    ``chunk_chars`` are cut and their chunks dealt over the cluster: for the best path into ``n_chunks`` of that
    length by the max-plus scan, for the library's ids where no merge can cross (a text without such a place, such as
    one character without end, stays whole there). A null or empty text has no ids and a score of 0. Rows that repeat
    are encoded each. Models whose normaliser changes texts are not taken.
    """
    encoder = piece_encoder(model_path)
    if not encoder.by_unit:
        raise ValueError("the model's normaliser changes texts, or its pieces cross words")
    lexicon = encoder.lexicon
    base = text_of(docs, id_col, text_col)
    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    whole = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("round_trip", pa.bool_()), ("best_ids", pa.binary()), ("best_score", pa.float64())])
    cut = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("merged", pa.bool_()), ("chunk", pa.int64()), ("part", pa.string()), ("ahead", pa.string())])
    done = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("ids", pa.string()), ("same", pa.bool_())])
    traced = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("ids", pa.string()), ("score", pa.float64())])

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = piece_encoder(model_path), Out(whole)
        for some in in_groups(rows(batches)):
            best: list[tuple[bytes, float]] = []
            for (doc_id, text), ids, path in zip(some, encoder.encode_texts([t for _, t in some], best), best, strict=True):
                if out.add((doc_id, ids, encoder.decode(ids) == (text or ""), *path), len(ids)):
                    yield out.take()
        yield out.take()
        encoder.kept.forget()

    def cut_giants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, row = piece_encoder(model_path), Out(cut), TaskContext.get().partitionId() << 33
        for doc_id, text in rows(batches):
            row += 1
            for c, part in enumerate(encoder.chunks(text, chunk_chars)):
                if out.add((doc_id, row, True, c, part, ""), len(part)):
                    yield out.take()
            t = MARK + text.replace(" ", MARK)
            for c, lo in enumerate(range(0, len(t), chunk_chars)):
                hi = lo + chunk_chars
                if out.add((doc_id, row, False, c, t[lo:hi], t[hi : hi + lexicon.longest]), chunk_chars):
                    yield out.take()
        yield out.take()

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = piece_encoder(model_path), Out(done)
        for row, k, part in rows(batches):
            ids = encoder.encode_inner(part.replace(MARK, " ")) if k else encoder.encode(part)
            if out.add((row, k, ids.hex(), encoder.decode(ids, k > 0) == part), len(ids)):
                yield out.take()
        yield out.take()

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = piece_encoder(model_path), Out(traced)
        for row, c, part, ahead, s, t in rows(batches):
            ids, score = encoder.path(lexicon.backtrace(part + ahead, 0, len(part), s, t))
            if out.add((row, c, ids.hex(), score), len(part)):
                yield out.take()
        yield out.take()

    small = map_arrow(base.filter(~giant), encode_whole, "doc_id long, ids binary, round_trip boolean, best_ids binary, best_score double").withColumn("n_chunks", F.lit(1))
    # Rows are numbered within a task: the numbers are written before anything is joined by them.
    chunks = materialise(map_arrow(base.filter(giant), cut_giants, "doc_id long, row long, merged boolean, chunk long, part string, ahead string"), "chunks")
    in_order = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]), ""))
    merged = map_arrow(chunks.filter("merged").select("row", "chunk", "part").repartition("row", "chunk"), encode_chunks, "row long, chunk long, ids string, same boolean")
    merged = merged.groupBy("row").agg(in_order.alias("ids"), F.bool_and("same").alias("round_trip"))
    cells = chunks.filter("NOT merged")
    paths = map_arrow(cells.join(best_states(cells, lexicon, fan), ["row", "chunk"]).select("row", "chunk", "part", "ahead", "s", "t"), trace, "row long, chunk long, ids string, score double")
    paths = paths.groupBy("row").agg(in_order.alias("best_ids"), F.sum("score").alias("best_score"), F.count(F.lit(1)).cast("int").alias("n_chunks"))
    numbers = chunks.filter("merged AND chunk = 0").select("row", "doc_id")
    both = small.unionByName(numbers.join(merged, "row").join(paths, "row").drop("row"))
    n = lambda c: (F.octet_length(c) / 4).cast("long")
    return both.select("doc_id", "ids", n("ids").alias("n_tokens"), "n_chunks", "round_trip", "best_ids", n("best_ids").alias("n_best"), "best_score")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids)`` → ``(doc_id, text)``; null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = piece_encoder(model_path), Out(schema)
        for doc_id, ids in rows(batches):
            text = encoder.decode(ids or b"")
            if out.add((doc_id, text), len(text)):
                yield out.take()
        yield out.take()

    return map_arrow(encoded.select("doc_id", "ids"), decode, "doc_id long, text string")
