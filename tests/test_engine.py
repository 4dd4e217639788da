import gzip
import json
import os
import subprocess
import sys

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom import Catalog, Engine, workspace
from sparkloom import operators as ops
from sparkloom.sources.csv import parse_header, read_typed_csv, write_typed_csv


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "people.csv").write_text('id:int,name,score:double,ok:boolean\n1,Ann,1.5,TRUE\n2,"Bo, Jr",,no\n,"",-2.5,\n4,  pad  ,0,true\n')
    with gzip.open(tmp_path / "pets.csv.gz", "wt") as f:
        f.write("pet_id:int,owner:int,kind\n10,1,cat\n11,1,dog\n12,,cat\n13,9,\n")
    (tmp_path / "things.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    return tmp_path


@pytest.fixture
def engine(spark, folder):
    e = Engine(spark, str(folder))
    yield e
    e.close()


def test_header():
    s = parse_header("a:int,b,c:decimal(9,2),d:boolean")
    assert s.simpleString() == "struct<a:int,b:string,c:decimal(9,2),d:boolean>"
    with pytest.raises(ValueError):
        parse_header("a:blob")


def test_csv_typing(engine):
    assert engine.catalog.names() == ["people", "pets", "things"]
    rows = engine.execute("SELECT * FROM people ORDER BY id NULLS LAST")
    assert rows == [(1, "Ann", 1.5, True), (2, "Bo, Jr", None, False), (4, "  pad  ", 0.0, True), (None, "", -2.5, None)]
    assert engine.catalog.count("PEOPLE") == 4 and engine.catalog.exists("Pets") and not engine.catalog.exists("no")
    with pytest.raises(KeyError):
        engine.catalog.table("no")


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "", True), (None, 'q"u,o', None)], "i int, s string, b boolean")
    write_typed_csv(df, str(tmp_path / "t"))
    assert sorted(map(str, read_typed_csv(spark, str(tmp_path / "t")).collect())) == sorted(map(str, df.collect()))
    for name, rows, schema in (("two", [(1, None), (2, ""), (3, "x"), (None, None)], "i int, s string"), ("one", [(None,), ("",), ("x",)], "s string"), ("num", [(None,), (3,)], "k long")):
        df = spark.createDataFrame(rows, schema)
        write_typed_csv(df, str(tmp_path / name))
        assert sorted(map(str, read_typed_csv(spark, str(tmp_path / name), null_strings=True).collect())) == sorted(map(str, df.collect()))


def test_csv_strict(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a:int,b:double,d:date,s\n1,2.5,2024-01-02,x\nx1,,no,\n")
    assert read_typed_csv(spark, str(tmp_path / "n.csv")).select("b", "s").collect() == [(2.5, "x"), (None, "")]
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_typed_csv(spark, str(tmp_path / "n.csv")).collect()
    loose = read_typed_csv(spark, str(tmp_path / "n.csv"), strict=False).collect()
    assert [r.a for r in loose] == [1, None] and [str(r.d) for r in loose] == ["2024-01-02", "None"]


def test_empty_inputs(spark, tmp_path):
    (tmp_path / "e.csv").write_text("k:int,v\n")
    e = read_typed_csv(spark, str(tmp_path / "e.csv"))
    other = spark.createDataFrame([(1, "x")], "k int, w string")
    assert e.columns == ["k", "v"] and e.count() == 0
    for how, n in (("inner", 0), ("left", 0), ("right", 1), ("full", 1)):
        assert ops.join(e, other, ["k"], how).count() == n
    assert ops.aggregate(e, n="count(*)", s="sum(k)").collect()[0] == (0, None)


def test_model_file(spark, folder):
    (folder / "model.json").write_text(json.dumps({"schemas": [{"operand": {"directory": str(folder)}, "tables": [{"name": "animals", "operand": {"file": str(folder / "pets.csv.gz")}}]}]}))
    c = Catalog.from_model(spark, str(folder / "model.json"))
    assert {"people", "pets", "animals"} <= set(c.names())
    (folder / "urls.json").write_text(json.dumps({"schemas": [{"tables": [{"name": "far", "operand": {"url": (folder / "people.csv").as_uri()}}]}]}))
    assert Catalog.from_model(spark, str(folder / "urls.json"), "/nowhere/").count("far") == 4


def test_workspace(spark, monkeypatch):
    with workspace.scope(spark):
        t = workspace.materialise(spark.range(5), "t")
        path = t.inputFiles()[0].rsplit("/", 1)[0]
        assert t.count() == 5 and os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    conf = type("C", (), {"get": lambda *_: None})()
    far = type("S", (), {"sparkContext": type("X", (), {"master": "spark://far:7077", "getConf": lambda _: conf, "getCheckpointDir": lambda _: None})(), "conf": conf})()
    with pytest.raises(RuntimeError):
        workspace.shared_dir(far)


def test_entry_without_the_corpus_part():
    """A subpackage that cannot be imported takes nothing else with it."""
    code = "import sys; sys.modules['sparkloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_null_logic_and_nary(engine):
    assert engine.execute("SELECT id FROM people WHERE NOT (score = 1.5)") == [(None,), (4,)] or len(engine.execute("SELECT id FROM people WHERE NOT (score = 1.5)")) == 2
    assert engine.execute("SELECT id FROM people WHERE id > 0 AND id < 5 AND id <> 2 AND name <> 'Ann'") == [(4,)]
    assert len(engine.execute("SELECT id FROM people WHERE id = 1 OR id = 2 OR id = 4")) == 3


def test_null_keys_and_flipped_on(engine):
    assert len(engine.execute("SELECT * FROM people JOIN pets ON owner = id")) == 2
    assert len(engine.execute("SELECT * FROM people FULL JOIN pets ON id = owner")) == 7


def test_unsupported_is_an_error(engine):
    with pytest.raises(PySparkException):
        engine.sql("SELECT nothing FROM people").collect()
    with pytest.raises(PySparkException):
        engine.parse("SELEC 1")
    with pytest.raises(PySparkException):
        engine.execute("SELECT 1 / 0")


def test_plans(engine):
    p = engine.plans("SELECT name FROM (SELECT * FROM people WHERE id > 1) t WHERE id < 4")
    assert set(p) == {"parsed", "analyzed", "optimized", "physical"}
    assert p["optimized"].count("Filter") == 1
    assert "PushedFilters" in engine.explain("SELECT name FROM people WHERE id > 1")
    assert [r[0] for r in engine.iterate("SELECT id FROM people WHERE id < 3 ORDER BY id")] == [1, 2]


def scan_rows(df):
    """Rows that the scans gave out, from the executed plan's metrics."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        n = todo.pop()
        if n.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(n.executedPlan())
        if n.nodeName().startswith("Scan parquet"):
            found += n.metrics().apply("numOutputRows").value()
        todo += [n.children().apply(i) for i in range(n.children().size())]
    return found


def test_index(spark):
    e = Engine(spark, "/root/testdata/sf0.1")
    assert e.create_index("orders", "o_orderkey", 8) and not e.create_index("orders", "o_orderkey") and not e.create_index("none", "x")
    ix = e.index("orders", "o_orderkey")
    total = e.catalog.count("orders")
    assert e.index_exists("ORDERS", "o_orderkey") and ix.name == "orders_o_orderkey_index"
    for op, v in (("=", 777), (">", 149_000), (">=", 149_000), ("<", 900), ("<=", 900)):
        hit = ix.lookup(op, v)
        assert hit.count() == e.catalog.table("orders").filter(f"o_orderkey {op} {v}").count()
        assert scan_rows(ix.lookup(op, v)) < total / 4
    assert ix.between(10, 20).count() == 11
    assert scan_rows(e.sql("SELECT o_custkey FROM orders WHERE o_orderkey < 900")) < total / 4  # by SQL, without asking
    again = ix.insert(e.catalog.table("orders").filter("o_orderkey = 5").withColumn("o_orderkey", F.lit(149_999_999)))
    assert again.scan().count() == total + 1 and again.lookup(">", 149_000_000).count() == 1 and ix.lookup(">", 149_000_000).isEmpty()
    assert e.delete("orders", "o_orderkey", 777) and not e.delete("orders", "o_orderkey", 777)
    assert e.catalog.count("orders") == total - 1 and e.index("orders", "o_orderkey").lookup("=", 777).isEmpty()
    assert [r[0] for r in ix.keys().limit(3).collect()] == sorted(r[0] for r in ix.keys().limit(3).collect())
    with pytest.raises(ValueError):
        ix.lookup("<>", 1)
