"""Token ids in seekable files of independent zstandard frames.

A file is a run of zstandard frames, each complete in itself, then a skippable frame that lists for every frame its
compressed size, its decompressed size and the low half of the XXH64 of its content, in the layout of the public
seekable format. The last listed frame is the directory: ids and lengths of the documents. A reader of one document
reads the table, the directory and the frames that its ids lie in; every frame it opens is checked.
"""

from __future__ import annotations

import codecs
import os
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Out, TwoGenerations, in_groups, map_arrow, rows, text_of
from sparkloom.workspace import fresh_path, materialise

END_ID = 2
FRAME_TOKENS = 1 << 17
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Words that are not plain whose ids a worker keeps at hand (twice as many at most).
MOST_KEPT = 400_000
#: Characters of a word that is kept.
LONGEST_KEPT = 64
#: Characters of text that are encoded together, where a row counts as some, and words whose ids are gathered at once.
GROUP_CHARS, ROW_CHARS, GATHERED = 1 << 23, 256, 1 << 16
_TAIL = r"^([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)$"
#: Words whose ids the merges alone tell: letters, marks but the apostrophe, letters before marks.
_PLAIN = r"^(?:[a-zß-öø-ÿ]+[!-&(-/:-@\[-`{-~]*|[!-&(-/:-@\[-`{-~]+)$"


class FrameError(ValueError):
    """A frame whose content does not have its checksum."""


def _gathered(raw: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words with these numbers, where *raw* holds every distinct word's in turn, and how many come before each word and the end."""
    first = np.cumsum(length) - length
    ends = np.zeros(len(number) + 1, np.int64)
    np.cumsum(length[number], out=ends[1:])
    ids = np.empty(ends[-1], "<u4")
    for at in range(0, len(number), GATHERED):
        part, to = number[at : at + GATHERED], ends[at : at + GATHERED + 1]
        ids[to[0] : to[-1]] = raw[np.arange(to[0], to[-1]) + np.repeat(first[part] - to[:-1], length[part])]
    return ids, ends


class WordEncoder:
    """Whole-text ids of a word-level BPE tokenizer, with each distinct word of a group of texts encoded once.

    The tokenizer drops white space before it looks at words, so the ids of a text are those of its words in turn.
    Texts for which that could differ (not in normal form C, as they are or lower-cased, or holding a special token's
    string in any case) go to the library whole. Arrow splits the texts and numbers their words; the library encodes
    the distinct ones in one run, and the texts' ids are gathered by number.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kept = TwoGenerations(MOST_KEPT)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The same merges, for words that are lower-cased, split and written in the alphabet of bytes already.
        self._merges = Tokenizer.from_file(path)
        self._merges.normalizer, self._merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        alphabet = [chr(b) if b < 0x80 else "\ufffe" for b in range(256)]  # U+FFFE: no such byte in a plain word
        for c in range(0x80, 0x100):
            for byte, letter in zip(chr(c).encode(), by_bytes.pre_tokenize_str(chr(c))[0][0], strict=True):
                alphabet[byte] = letter
        self._alphabet = "".join(alphabet)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters and of words of marks, and where those of each end."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))[0]
        run, _ = codecs.charmap_decode(joined.as_buffer(), "strict", self._alphabet)
        ids = np.array(self._merges.encode_batch_fast([run], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError(f"{len(words)} words, {len(ends)} ends of words")
        return ids, ends

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words; letters with marks behind them are two words to the tokenizer."""
        lists = pc.split_pattern(pc.replace_substring_regex(words, _TAIL, r"\1 \2"), " ")
        told = lists.flatten().dictionary_encode()
        raw, ends = self._merged(told.dictionary)
        ids, ends = _gathered(raw, np.diff(ends, prepend=0), told.indices.to_numpy())
        return ids, ends[lists.offsets.to_numpy()[1:]]

    def _other(self, word: str) -> bytes:
        ids = self.kept.fetch(word)
        if ids is None:
            ids = self.whole(word)
            if len(word) <= LONGEST_KEPT:
                self.kept[word] = ids
        return ids

    def _of_words(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased texts."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        told = lists.flatten().dictionary_encode()
        plain = pc.match_substring_regex(told.dictionary, _PLAIN)
        self.kept.tidy()
        others = [self._other(w) for w in told.dictionary.filter(pc.invert(plain)).to_pylist()]
        is_plain, length = plain.to_numpy(zero_copy_only=False), np.zeros(len(plain), np.int64)
        raw, length[~is_plain] = np.frombuffer(b"".join(others), "<u4"), np.fromiter(map(len, others), np.int64, len(others)) // 4
        if is_plain.any():
            ids, ends = self._plain(told.dictionary.filter(plain))
            raw, length[is_plain] = np.concatenate((raw, ids)), np.diff(ends, prepend=0)
        order = np.argsort(is_plain, kind="stable")  # in raw the others come first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, ends = _gathered(raw, length[order], place[told.indices.to_numpy()])
        return [ids[lo:hi].tobytes() for lo, hi in pairwise(ends[lists.offsets.to_numpy()].tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; none of null."""
        out: list[bytes] = [b""] * len(texts)
        at: list[int] = []
        lows: list[str] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            # Lower-casing character by character knows no final sigma.
            low = text.lower() if (ascii_only := text.isascii()) else text.replace("Σ", "σ").lower()
            # The library looks for special strings before it lower-cases: here no word may become one. It composes
            # before it lower-cases and not again, but would compose a lower-cased word.
            if any(s in low for s in self.specials) or not (ascii_only or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))):
                out[i] = self.whole(text)
            else:
                at.append(i)
                lows.append(low)
        for i, ids in zip(at, self._of_words(lows) if lows else (), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Appends documents; ``close`` adds the directory and the seek table."""

    def __init__(self, uri: str, width: int = 4, frame_tokens: int = FRAME_TOKENS):
        import zstandard

        fs, at = _store(uri)
        fs.create_dir(os.path.dirname(at), recursive=True)
        self._out = fs.open_output_stream(at)
        self._zstd = zstandard.ZstdCompressor(level=3)
        self.width, self.limit = width, frame_tokens * width
        self._buffer, self._table = bytearray(), bytearray()
        self._ids: list[int] = []
        self._lengths: list[int] = []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self._zstd.compress(data)
        self._out.write(packed)
        self._table += struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """*ids*: unsigned 32-bit little-endian."""
        self._ids.append(-(2**63) if doc_id is None else doc_id)
        self._lengths.append(len(ids) // 4)
        self._buffer += ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        while len(self._buffer) >= self.limit:
            self._frame(bytes(self._buffer[: self.limit]))
            del self._buffer[: self.limit]

    def close(self) -> None:
        if self._buffer:
            self._frame(bytes(self._buffer))
        self._frame(struct.pack("<II", len(self._ids), self.width) + np.array(self._ids, "<i8").tobytes() + np.array(self._lengths, "<u8").tobytes())
        n = len(self._table) // 12
        self._out.write(struct.pack("<II", SKIPPABLE, len(self._table) + 9) + bytes(self._table) + struct.pack("<IBI", n, 0x80, SEEKABLE))
        self._out.close()


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        import zstandard

        fs, at = _store(uri)
        self._in = fs.open_input_file(at)
        self._zstd = zstandard.ZstdDecompressor()
        size = self._in.size()
        n, flags, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise FrameError(f"{uri} has no seek table")
        table = np.frombuffer(self._in.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self._packed = np.concatenate(([0], np.cumsum(table[:, 0], dtype=np.int64)))
        self._sums = table[:, 2]
        self._opened: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0
        head = self._frame(n - 1)
        count, self.width = struct.unpack("<II", head[:8])
        self.doc_ids = np.frombuffer(head, "<i8", count, 8)
        self.lengths = np.frombuffer(head, "<u8", count, 8 + 8 * count).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self._raw = np.concatenate(([0], np.cumsum(table[:-1, 1], dtype=np.int64)))

    def _frame(self, k: int) -> bytes:
        import xxhash

        if self._opened[0] != k:
            data = self._zstd.decompress(self._in.read_at(int(self._packed[k + 1] - self._packed[k]), int(self._packed[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self._sums[k]):
                raise FrameError(f"frame {k} is damaged")
            self._opened = (k, data)
            self.frames_read += 1
        return self._opened[1]

    def pieces(self, i: int) -> Iterator[np.ndarray]:
        """The ids of the i-th document, frame by frame."""
        lo, hi = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        k = int(np.searchsorted(self._raw, lo, "right")) - 1
        while lo < hi:
            end = min(hi, int(self._raw[k + 1]))
            data = self._frame(k)[lo - int(self._raw[k]) : end - int(self._raw[k])]
            yield np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")
            lo, k = end, k + 1

    def tokens(self, i: int) -> np.ndarray:
        return np.concatenate([np.empty(0, "<u4"), *self.pieces(i)])

    def find(self, doc_id: int) -> int:
        """Position of a document; ids ascend within a file."""
        i = int(np.searchsorted(self.doc_ids, doc_id))
        if i == len(self.doc_ids) or self.doc_ids[i] != doc_id:
            raise KeyError(doc_id)
        return i

    def close(self) -> None:
        self._in.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encode every text and write one file per range of ids; one row per file: ``part, path, n_docs, n_tokens``.

    The texts are range-partitioned by id once, so files and documents in them ascend. An attempt writes to a name of
    its own and only the attempt whose row comes back is listed, so lost executors leave no half file in use.
    """
    base = text_of(docs, id_col, text_col)
    folder = folder or fresh_path(base.sparkSession, "tokens")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = word_encoder(tokenizer_path)
        wide = encoder.tokenizer.get_vocab_size() > 65_536 or end_id > 65_535
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        writer, n_docs, n_tokens, end = None, 0, 0, struct.pack("<I", end_id)
        for chunk in in_groups(rows(batches), GROUP_CHARS, ROW_CHARS):
            writer = writer or TokenFileWriter(path, 4 if wide else 2, frame_tokens)
            for (doc_id, _), ids in zip(chunk, encoder.encode([t for _, t in chunk]), strict=True):
                writer.add(doc_id, ids + end)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": path, "n_docs": n_docs, "n_tokens": n_tokens}], schema)

    ordered = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(map_arrow(ordered, write, "part int, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the listed files, in full: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it, over all files in order of ``part``.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "base")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for path, base in rows(batches):
            f = TokenFile(path)
            for i, doc_id in enumerate(f.doc_ids.tolist()):
                crc = 0
                for piece in f.pieces(i):
                    crc = crc32(piece.tobytes(), crc)
                if out.add((None if doc_id == -(2**63) else doc_id, base + int(f.starts[i]), int(f.lengths[i]), crc)):
                    yield out.take()
            f.close()
        yield out.take()

    return map_arrow(placed.repartition(max(1, files.count())), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files and read them back, one row per input row.

    A null or empty text is the end id alone. Null ids come first; rows that repeat an id follow each other, by text.
    An empty table writes no file. Other columns are ignored.
    """
    return read_token_files(write_token_files(docs, tokenizer_path, None, id_col, text_col, end_id))
