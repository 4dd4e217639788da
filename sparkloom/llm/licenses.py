"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

Templates are token sets ordered from globally rarest to most frequent token; the frequencies are counted over the
whole corpus. A block's tokens are put in the same order, those of no template left out. A block that holds at least
the share ``THRESHOLD`` of a template's tokens must hold one of the first ``n - ceil(t n) + 1`` of them (prefix
filter) and have at least ``ceil(t n)`` tokens (length filter). The first token that both share stands somewhere in
both orders, and no more can be shared than the shorter of the two rests from there on (positional filter). The few
blocks that pass are verified on full token sets, so the join is exact. Blocks are windows of twice the longest template, half overlapping: any
run of words no longer than half a window lies whole in one of them, however its lines are wrapped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, Out, map_arrow, rows, text_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
THRESHOLD = 0.8
#: Well-known opening or grant passages, lower-cased; several may carry one label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)


def license_words(text: str | None) -> list[str]:
    """A-Z lower-cased, then runs of digits, a-z and anything beyond ASCII."""
    return WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower()) if text else []


def find_phrases(w: list[str], phrases: dict[str, str] = PHRASES) -> list[tuple[str, int, int]]:
    """``(label, first word, last word)`` of every place where a phrase's words stand in a row."""
    out = []
    for label, phrase in phrases.items():
        p = phrase.split()
        at = -1
        while True:
            try:
                at = w.index(p[0], at + 1)
            except ValueError:
                break
            if w[at : at + len(p)] == p:
                out.append((label, at, at + len(p) - 1))
    return out


class TemplateJoin:
    """The templates as frequency-ordered token lists with an index over their prefixes."""

    def __init__(self, frequency: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.templates, self.index = [], {}
        vocabulary = {t for _, text in templates for t in text.split()}
        #: Place of every template token in the global order.
        self.rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
        self.rejected = Counter()
        longest = 0
        for label, text in templates:
            longest = max(longest, len(text.split()))
            tokens = sorted(set(text.split()), key=self.rank.__getitem__)
            need = ceil(threshold * len(tokens))
            k = len(self.templates)
            self.templates.append((label, frozenset(tokens), need))
            for position, t in enumerate(tokens[: len(tokens) - need + 1]):
                self.index.setdefault(t, []).append((k, position))
        self.step = longest
        #: Without one of these words no block of a document can pass.
        self.any_prefix = frozenset(self.index)
        self.any_token = frozenset(self.rank)

    def join(self, w: list[str]) -> list[tuple[str, float, int]]:
        """``(label, containment, start of the block)`` of each template and block that meet the threshold."""
        if self.any_prefix.isdisjoint(w):
            return []
        out = []
        for start in range(0, max(1, len(w) - self.step), self.step):
            words = w[start : start + 2 * self.step]
            if self.any_prefix.isdisjoint(words):
                continue
            block = sorted(self.any_token.intersection(words), key=self.rank.__getitem__)
            first: dict[int, tuple[int, int]] = {}  # positions of the first shared token, in the template and in the block
            for at, t in enumerate(block):
                for k, position in self.index.get(t, ()):
                    first.setdefault(k, (position, at))
            for k, (position, at) in sorted(first.items()):
                label, tokens, need = self.templates[k]
                if len(block) < need:
                    self.rejected["length"] += 1
                elif min(len(tokens) - position, len(block) - at) < need:
                    self.rejected["position"] += 1
                else:
                    found = len(tokens.intersection(block))
                    if found >= need:
                        out.append((label, found / len(tokens), start))
                    else:
                        self.rejected["verified"] += 1
        return out


def template_frequency(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Occurrences over the whole corpus of every token that a template has; bounded by the templates' vocabulary."""
    vocabulary = frozenset(t for _, text in templates for t in text.split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for _, text in rows(batches):
            if text:
                hit = Counter(license_words(text))
                for t in vocabulary & hit.keys():
                    seen[t] += hit[t]
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    found = map_arrow(docs, count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in found.collect()}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks``.

    Null and empty texts have no words, no labels (empty strings) and score 0. ``score`` is 1 where a phrase stands,
    else the best containment among the matched templates. Repeated rows are scanned each; other columns are ignored.
    """
    base = text_of(docs, id_col, text_col)
    matcher = TemplateJoin(template_frequency(base, templates), templates, threshold)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for doc_id, text in rows(batches):
            w = license_words(text)
            hits, blocks = find_phrases(w), matcher.join(w)
            labels = {h[0] for h in hits}
            score = 1.0 if hits else max((b[1] for b in blocks), default=0.0)
            starts = [h[1] for h in hits]
            row = (doc_id, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {b[0] for b in blocks})), score, len(blocks))
            if out.add(row):
                yield out.take()
        yield out.take()

    return map_arrow(base, scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``license_scan``: every block beside every template, counted in full."""
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    step = max(len(text.split()) for _, text in templates)
    listed = ", ".join(f"('{label}', {tokens}, {ceil(threshold * len(tokens))})" for label, tokens in sets)
    places = " UNION ALL ".join(
        f"SELECT doc_id, rid, '{label}' AS label, i - 1 AS pos FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE " + " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(phrase.split())) for label, phrase in PHRASES.items()
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
p AS ({places}),
h AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM p GROUP BY rid),
t AS (SELECT * FROM (VALUES {listed}) AS t(label, tokens, need)),
b AS (SELECT rid, list_distinct(w[start + 1 : start + {2 * step}]) AS block FROM d, unnest(range(0, greatest(1, len(w) - {step}), {step})) AS u(start)),
m AS (SELECT rid, label, len(list_intersect(tokens, block)) AS found, need, len(tokens) AS n FROM b, t WHERE len(list_intersect(tokens, block)) >= need),
j AS (SELECT rid, count(*) AS n_blocks, max(found / n) AS best, list(DISTINCT label) AS labels FROM m GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(h.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(h.labels, []), coalesce(j.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN h USING (rid) LEFT JOIN j USING (rid)
"""
