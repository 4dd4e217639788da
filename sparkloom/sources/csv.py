"""CSV files whose header names each column as ``name`` or ``name:type``.

The header alone fixes the schema: one line is read, no values are sampled. A column without a type is a string.
An empty field is NULL for every type except strings, where it stays the empty string; files written here tell NULL
(nothing) from the empty string (``""``), and are read with ``null_strings`` to keep the two apart.
"""

from __future__ import annotations

from csv import reader

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: NULL in a table of one column.
LONE_NULL = "\\N"
#: What the reader puts for nothing; were it the empty string, ``""`` would be taken for it.
NO_TEXT = "\0"
TYPES = {
    "string": T.StringType(),
    "varchar": T.StringType(),
    "char": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "tinyint": T.ByteType(),
    "short": T.ShortType(),
    "smallint": T.ShortType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "timestamp": T.TimestampNTZType(),
}


def column_type(name: str) -> T.DataType:
    """The Spark type of a header's type name; ``decimal(p,s)`` is accepted, an unknown name is an error."""
    low = name.strip().lower()
    if low.startswith("decimal"):
        p, s = (low[len("decimal") :].strip("() ") or "38,2").split(",")
        return T.DecimalType(int(p), int(s))
    if low not in TYPES:
        raise ValueError(f"unknown column type {name!r}")
    return TYPES[low]


def parse_header(line: str, sep: str = ",") -> T.StructType:
    """``id:int,name`` → the schema of the file."""
    fields: list[str] = []
    for f in next(reader([line], delimiter=sep)):
        if fields and fields[-1].count("(") > fields[-1].count(")"):  # decimal(p,s) without quotes
            fields[-1] += sep + f
        else:
            fields.append(f)
    parts = [f.partition(":") for f in fields]
    return T.StructType([T.StructField(n.strip(), column_type(t) if c else T.StringType(), True) for n, c, t in parts])


def read_typed_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False, strict: bool = True, null_strings: bool = False) -> DataFrame:
    """Read one typed-header file, or a folder of them, plain or gzipped.

    BOOLEAN follows the header's own rule: only ``true`` (any case) is true, any other non-empty text is false.
    A number that does not parse, or a row with too few or too many fields, is an error when its columns are read, or
    NULL if not *strict*; dates and times that do not parse are NULL. With *null_strings* an empty field without quotes is NULL for strings too, as
    ``write_typed_csv`` writes it. Columns come in declared order.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    schema = parse_header(head[0][0], sep)
    timely = (T.DateType, T.TimestampNTZType)
    text = lambda t: isinstance(t, T.BooleanType) or strict and isinstance(t, timely)
    as_text = T.StructType([T.StructField(f.name, T.StringType() if text(f.dataType) else f.dataType, True) for f in schema])
    raw = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("emptyValue", "")
        .option("nullValue", (LONE_NULL if len(schema) == 1 else NO_TEXT) if null_strings else "")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .csv(path)
    )
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = c if null_strings else F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c != "", F.lower(F.trim(c)) == "true")
        elif strict and isinstance(f.dataType, timely):
            c = c.try_cast(f.dataType)
        out.append(c.alias(f.name))
    return raw.select(*out)


def write_typed_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write a folder of CSV files, each with the typed header that ``read_typed_csv`` understands.

    NULL is written as nothing, the empty string as ``""``. A table of one column writes NULL as ``\\N``, since
    readers skip blank lines.
    """
    back = {T.IntegerType: "int", T.LongType: "long", T.ShortType: "short", T.ByteType: "byte", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.DateType: "date", T.TimestampNTZType: "timestamp"}
    names = []
    for f in df.schema:
        kind = f"decimal({f.dataType.precision},{f.dataType.scale})" if isinstance(f.dataType, T.DecimalType) else back.get(type(f.dataType))
        names.append(f"{f.name}:{kind}" if kind else f.name)
    renamed = df.toDF(*names)
    null = LONE_NULL if len(names) == 1 else ""
    renamed.write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", '""').option("nullValue", null).csv(path)
