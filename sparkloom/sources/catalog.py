"""A directory of files as a set of named tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.csv import read_typed_csv

SUFFIXES = (".parquet", ".csv.gz", ".csv", ".json.gz", ".json", ".jsonl")


class Catalog:
    """Tables by name, each registered as a temporary view.

    Listing goes through the Hadoop file system of the path, so any store that Spark reads will do. Names are
    case-insensitive, as in Spark SQL. A missing table is an error, never an empty result.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, directory: str) -> Catalog:
        """Every supported file or folder of *directory* becomes a table named by its stem."""
        out = cls(spark)
        for table, file, suffix in cls._files(spark, directory):
            out.register(table, out.read(f"{directory.rstrip('/')}/{file}", suffix))
        return out

    @classmethod
    def names_in(cls, spark: SparkSession, directory: str) -> list[str]:
        """The tables that *directory* would give, without reading any."""
        return sorted({table for table, _, _ in cls._files(spark, directory)})

    @staticmethod
    def _files(spark: SparkSession, directory: str) -> list[tuple[str, str, str]]:
        """``(table, file, suffix)`` of every supported file or folder."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = [status.getPath().getName() for status in fs.listStatus(at)]
        suffixes = [next((s for s in SUFFIXES if f.lower().endswith(s)), None) for f in files]
        return [(f[: -len(s)], f, s) for f, s in zip(files, suffixes, strict=True) if s]

    @classmethod
    def from_model(cls, spark: SparkSession, model: str, base: str = "") -> Catalog:
        """A JSON model: ``{"schemas": [{"operand": {"directory": ...}, "tables": [{"name", "operand": {"file"}}]}]}``.

        An operand has a ``file``, relative to *base*, or a ``url`` of any scheme that Spark's file systems read.
        """
        spec = json.loads("\n".join(r[0] for r in spark.read.text(model).collect()))
        out = cls(spark)
        for schema in spec.get("schemas", []):
            where = schema.get("operand", {}).get("directory")
            if where:
                out._tables |= cls.of(spark, base + where)._tables
            for t in schema.get("tables", []):
                at = t["operand"]
                out.register(t["name"], out.read(at["url"] if "url" in at else base + at["file"]))
        return out

    def read(self, path: str, suffix: str | None = None) -> DataFrame:
        suffix = suffix or next((s for s in SUFFIXES if path.lower().endswith(s)), None)
        if suffix == ".parquet":
            return self.spark.read.parquet(path)
        if suffix in (".csv", ".csv.gz"):
            return read_typed_csv(self.spark, path)
        if suffix in (".json", ".json.gz"):
            return self.spark.read.json(path, multiLine=True)
        if suffix == ".jsonl":
            return self.spark.read.json(path)
        raise ValueError(f"no reader for {path!r}")

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self._tables[name.lower()] = df
        return df

    def table(self, name: str) -> DataFrame:
        if name.lower() not in self._tables:
            raise KeyError(f"no table {name!r}")
        return self._tables[name.lower()]

    def exists(self, name: str) -> bool:
        return name.lower() in self._tables

    def names(self) -> list[str]:
        return sorted(self._tables)

    def count(self, name: str) -> int:
        return self.table(name).count()
