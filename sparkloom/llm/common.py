"""Small pieces that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(WORD)


def words(text: str | None) -> list[str]:
    """Maximal runs of anything but ASCII white space."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def norm_text(text: str | Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty string."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, converted a slice at a time so that long texts are not all Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, whatever else the table carries."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """*name*, with underscores behind it as far as *df* has such columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Text in an Arrow batch, where nobody has set another size; one longer text is a batch of its own.
BATCH_BYTES = 2 << 20


class Out:
    """Collects rows and yields record batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 20_000, limit_bytes: int = 1 << 20):
        self.schema, self.limit, self.limit_bytes = schema, limit, limit_bytes
        self._rows: list[tuple] = []
        self._bytes = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """True if the batch is due."""
        self._rows.append(row)
        self._bytes += size
        return len(self._rows) >= self.limit or self._bytes >= self.limit_bytes

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self._rows, strict=True)) or [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.schema.types, strict=True)], schema=self.schema)
        self._rows, self._bytes = [], 0
        return out


#: Tasks among which the rows of one key are dealt.
SALTS = 256


def with_totals(rows: DataFrame, keys: list[str], spread: str, aggregates: dict[str, tuple[Column, Column]] | None = None, kept: str = "n > 1") -> DataFrame:
    """Rows whose key passes *kept*, with ``n``, the rows of their key, and the *aggregates* over all of them.

    A key that holds a third of the table must not land in one task: rows are dealt by key and a salt from *spread*.
    What is summed up by key and salt (the first of an aggregate's two steps) is summed up by key (the second), SALTS
    rows of one at most, and comes back by key and salt. Null keys are dropped.
    """
    more = aggregates or {}
    dealt = rows.withColumn("salt__", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    part = dealt.groupBy(*keys, "salt__").agg(F.count(F.lit(1)).alias("n"), *[f.alias(c) for c, (f, _) in more.items()])
    total = part.groupBy(*keys).agg(F.collect_list("salt__").alias("salts__"), F.sum("n").alias("n"), *[g.alias(c) for c, (_, g) in more.items()]).filter(kept)
    back = total.withColumn("salt__", F.explode("salts__")).drop("salts__")
    return dealt.join(back, [*keys, "salt__"]).drop("salt__")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it; once per Spark context."""
    sc = spark.sparkContext
    # Batches of texts go through the memory of both processes; ten thousand long ones are too many at once.
    for what, default, ours in (("Records", "10000", "2000"), ("Bytes", "67108864", str(BATCH_BYTES))):
        name = f"spark.sql.execution.arrow.max{what}PerBatch"
        if spark.conf.get(name, default).lower().removesuffix("b") == default:
            spark.conf.set(name, ours)
    if getattr(sc, "_sparkloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="sparkloom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = f"{folder}/sparkloom-{os.path.basename(folder)[-8:]}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(at)
    sc._sparkloom_shipped = True


def give_back() -> None:
    """Return a finished task's memory to the system: the worker process lives on, idle or for other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` on workers that have this package."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


class TwoGenerations(dict):
    """A bounded cache: once *most* entries are young, they become old and the old ones are dropped."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def fetch(self, key):
        """The value or None; a hit among the old ones is young again."""
        got = self.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self[key] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def tidy(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def in_groups(items: Iterable[tuple], limit: int = 1 << 19, each: int = 0) -> Iterator[list[tuple]]:
    """Rows in lists of about *limit* characters of their second value; a row counts as *each* more."""
    chunk, size = [], 0
    for x in items:
        chunk.append(x)
        size += len(x[1] or "") + each
        if size >= limit:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk
