"""The two front doors: SQL text and DataFrame operators, over one catalog."""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, Row, SparkSession

from sparkloom.operators.index import ClusteredIndex
from sparkloom.sources.catalog import Catalog


class Engine:
    """Tables of one directory, queries over them, and the clustered indexes built on them."""

    def __init__(self, spark: SparkSession, directory: str | None = None, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or (Catalog.of(spark, directory) if directory else Catalog(spark))
        self._indexes: dict[str, ClusteredIndex] = {}

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def parse(self, text: str) -> str:
        """The unresolved plan; a syntax error is raised here."""
        return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()

    def plans(self, query: str | DataFrame) -> dict[str, str]:
        """parsed, analyzed, optimized and physical plan text."""
        df = self.sql(query) if isinstance(query, str) else query
        q = df._jdf.queryExecution()
        return {"parsed": q.logical().toString(), "analyzed": q.analyzed().toString(), "optimized": q.optimizedPlan().toString(), "physical": q.executedPlan().toString()}

    def explain(self, query: str | DataFrame, mode: str = "formatted") -> str:
        df = self.sql(query) if isinstance(query, str) else query
        with redirect_stdout(io.StringIO()) as out:
            df.explain(mode)
        return out.getvalue()

    def execute(self, query: str | DataFrame) -> list[tuple]:
        return [tuple(r) for r in (self.sql(query) if isinstance(query, str) else query).collect()]

    def iterate(self, query: str | DataFrame) -> Iterator[Row]:
        """A cursor: one partition at a time reaches the driver."""
        return (self.sql(query) if isinstance(query, str) else query).toLocalIterator()

    def create_index(self, table: str, column: str, partitions: int | None = None) -> bool:
        """False if the table is missing or the index exists already.

        The first index of a table becomes what SQL reads under the table's name: the rows are the same, and a filter
        on the column skips row groups without being asked for.
        """
        name = f"{table}_{column}_index".lower()
        if not self.catalog.exists(table) or name in self._indexes:
            return False
        first = not any(x.table.lower() == table.lower() for x in self._indexes.values())
        self._indexes[name] = ClusteredIndex.create(self.catalog.table(table), table, column, partitions)
        if first:
            self.catalog.register(table, self._indexes[name].scan())
        return True

    def index_exists(self, table: str, column: str) -> bool:
        return f"{table}_{column}_index".lower() in self._indexes

    def index(self, table: str, column: str) -> ClusteredIndex:
        return self._indexes[f"{table}_{column}_index".lower()]

    def delete(self, table: str, column: str, value: object) -> bool:
        """Delete by key from an indexed table: the table and its index become a new version; false if no row matched.

        Other indexes of the table are dropped, since they still hold the old rows.
        """
        if not self.index_exists(table, column):
            return False
        old = self.index(table, column)
        if old.lookup("=", value).isEmpty():
            return False
        self._renew(table, old.delete(value))
        return True

    def insert(self, table: str, column: str, rows: DataFrame) -> bool:
        """Insert into an indexed table: the table and its index become a new version; other indexes are dropped."""
        if not self.index_exists(table, column):
            return False
        self._renew(table, self.index(table, column).insert(rows))
        return True

    def _renew(self, table: str, new: ClusteredIndex) -> None:
        self._indexes = {k: v for k, v in self._indexes.items() if v.table.lower() != table.lower()} | {new.name.lower(): new}
        self.catalog.register(table, new.scan())

    def close(self) -> None:
        for name in self.catalog.names():
            self.spark.catalog.dropTempView(name)
