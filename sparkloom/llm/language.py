"""Language identification by hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, drawn from its code point alone. A trigram is bound by
multiplying its letters' vectors, the first rotated twice and the second once, so that order matters; a text is the
bundle (sum) of its trigrams, a language's prototype the bundle of its training texts. A text belongs to the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import give_back, map_arrow, rows, ship, text_of

DIMENSIONS = 1024
SEED = 0x5EED
#: Trigram vectors kept at hand in a worker.
MOST_KEPT = 40_000
_IS_LETTER = np.zeros(0x110000, dtype=bool)
_READY = False


def _letters() -> np.ndarray:
    global _READY
    if not _READY:
        _IS_LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _READY = True
    return _IS_LETTER


class Encoder:
    """Trigram counts and vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letter: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self._codes = np.empty(0, np.int64)
        self._places = np.empty(0, np.int64)
        self._table = np.empty((1024, self.dimensions), np.int8)  # ones and minus ones

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letter:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            if len(self._letter) > 20_000:
                self._letter.clear()
            self._letter[code] = 2 * bits - 1
        return self._letter[code]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the lower-cased text and their counts; other characters than letters part words."""
        if not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = _letters()[points]
        if not is_letter.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a = np.where(is_letter, points, 32).astype(np.int64)
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
        a = np.concatenate(([32], a[keep], [32]))
        g = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
        return np.unique(g, return_counts=True)

    def _add(self, codes: np.ndarray) -> None:
        if len(self.at) + len(codes) > MOST_KEPT:
            self._clear()
        need = len(self.at) + len(codes)
        if need > len(self._table):
            grown = np.empty((max(need, 2 * len(self._table)), self.dimensions), np.int8)
            grown[: len(self.at)] = self._table[: len(self.at)]
            self._table = grown
        for g in codes.tolist():
            a, b, c = g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF
            self._table[len(self.at)] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            self.at[g] = len(self.at)
        self._codes = np.fromiter(self.at, np.int64, len(self.at))
        self._places = np.argsort(self._codes)
        self._codes = self._codes[self._places]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors; long lists are taken in parts, so memory stays bounded."""
        total = np.zeros(self.dimensions, np.float64)
        for i in range(0, len(codes), 2048):
            part, n = codes[i : i + 2048], counts[i : i + 2048]
            at = np.searchsorted(self._codes, part)
            known = (at < len(self._codes)) & (self._codes[np.minimum(at, len(self._codes) - 1)] == part) if len(self._codes) else np.zeros(len(part), bool)
            if not known.all():
                self._add(part[~known])
                at = np.searchsorted(self._codes, part)
                lost = (at >= len(self._codes)) | (self._codes[np.minimum(at, len(self._codes) - 1)] != part)
                if lost.any():  # the table was cleared
                    self._add(part[lost])
                    at = np.searchsorted(self._codes, part)
            total += n.astype(np.float32) @ self._table[self._places[at]].astype(np.float32)
        return total


#: crc32 of the id as text, modulo 4, is 2: such a document is never learned from.
HELD_OUT = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # a unit row for each language
    dimensions: int = DIMENSIONS
    seed: int = SEED


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> LanguageModel:
    """Prototypes from every labelled document that is not held out.

    Each partition bundles what it has of each language and sends that one vector; what reaches the driver is
    ``languages x dimensions`` numbers. A document's bundle is scaled to unit length first, so that a few very long
    texts do not make a prototype. Null ids, texts and languages teach nothing.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(f"doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND NOT ({HELD_OUT})")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, seed), {}
        for _, text, lang in rows(batches):
            codes, counts = encoder.trigrams(text)
            if len(codes):
                v = encoder.bundle(codes, counts)
                sums[lang] = sums.get(lang, 0) + v / (np.linalg.norm(v) or 1)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dimensions), "k": pa.array(np.arange(dimensions, dtype=np.int32)), "x": pa.array(v)})

    parts = map_arrow(base, learn, "lang string, k int, x double").groupBy("lang", "k").agg(F.sum("x").alias("x"))
    vectors: dict[str, np.ndarray] = {}
    for lang, k, x in parts.collect():
        vectors.setdefault(lang, np.zeros(dimensions))[k] = round(x, 6)
    names = tuple(sorted(vectors))
    proto = np.array([vectors[n] / (np.linalg.norm(vectors[n]) or 1) for n in names]).reshape(len(names), dimensions)
    return LanguageModel(names, proto, dimensions, seed)


def label(text: Column, model: LanguageModel) -> Column:
    """``struct<lang_pred, score>`` of a text column, for use on a table of any shape."""
    names, proto, dimensions, seed = model.languages, model.prototypes, model.dimensions, model.seed

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(dimensions, seed)
        for texts in batches:
            langs, scores = [], []
            for t in texts:
                codes, counts = encoder.trigrams(t)
                lang, score = "und", 0.0
                if len(codes) and names:
                    v = encoder.bundle(codes, counts)
                    cos = proto @ v / (np.linalg.norm(v) or 1)
                    best = int(np.argmax(cos))
                    lang, score = names[best], float(min(1.0, max(0.0, cos[best])))
                langs.append(lang)
                scores.append(score)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        give_back()

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def lettered(text: Column) -> Column:
    """Whether a text has a letter, as ``label`` counts them; false for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder()
        for texts in batches:
            yield pd.Series([len(encoder.trigrams(t)[0]) > 0 for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")(text)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``; only the text is looked at.

    ``score`` is the cosine with the winning prototype, within 0 and 1. A text that is null or without a letter, or a
    model without languages, gives ``und`` and 0. Equal cosines go to the first language in sort order. A null id
    counts as not held out; other columns are ignored.
    """
    base = text_of(docs, id_col, text_col)
    ship(base.sparkSession)
    out = base.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), label(F.col("text"), model).alias("l"))
    return out.select("doc_id", "held_out", "l.lang_pred", "l.score")
