"""The pipeline's stages one by one against the straightforward versions, and the whole of it."""

import time
from pathlib import Path
from urllib.parse import urlparse

import brute
import numpy as np
import pytest
from oracle import duck
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import language, mixing, neardup, queries
from sparkloom.workspace import materialise, shared_dir

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    """A test table with rows that only the first stages see."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(10_001, None, "en", "x", 0), (10_002, "", None, None, None), (10_003, " 123 ... \n", "de", "x", 9), (10_004, "the same words again", None, None, 20), (10_005, "the  same words\tagain", "en", "x", 20)]
    return df.unionByName(spark.createDataFrame(more, df.schema)).cache()


def test_stages_are_named():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and list(STAGES) == ["language", "exact", "near", "mix", "pieces"]


def test_language_stage_drops_what_has_no_language(spark, docs):
    out = corpus_pipeline.language_stage(spark, docs, SF)
    want = {r.doc_id for r in language.predict(docs, language.fit(docs)).collect() if r.lang_pred != "und"}
    assert out.columns == COLUMNS and {r.doc_id for r in out.collect()} == want
    assert {10_001, 10_002, 10_003}.isdisjoint(want) and {10_004, 10_005} <= want
    assert want >= {d for d, t in plain(docs) if t and any(c.isalpha() for c in t)}


def test_language_stage_without_labels_drops_only_what_has_no_letter(spark, docs):
    want = sorted(d for d, t in plain(docs) if t and any(c.isalpha() for c in t))
    out = corpus_pipeline.language_stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF)
    assert out.columns == COLUMNS and sorted(d for d, _ in plain(out)) == want and len(want) > 100


def test_stages_equal_the_straightforward_versions(spark, docs, tmp_path):
    out = corpus_pipeline.exact_stage(spark, docs, SF)
    rows = plain(out)
    assert out.columns == COLUMNS and sorted(d for d, _ in rows) == sorted(r[0] for r in brute.exact(plain(docs)) if r[3])
    out = corpus_pipeline.near_stage(spark, docs, SF)
    assert out.columns == COLUMNS and sorted(d for d, _ in plain(out)) == sorted(d for d, (n, c) in brute.near(plain(docs), 5, 80).items() if c == d)

    docs.write.parquet(f"file://{tmp_path}/in")
    (tmp_path / "sf").mkdir()
    sql = mixing.ORACLE.replace("FROM documents", f"FROM read_parquet('{tmp_path}/in/*.parquet')")
    names, mixed = duck(SF, sql)
    at = {n: names.index(n) for n in ("doc_id", "size", "taken")}
    want = sorted(r[at["doc_id"]] for r in mixed if r[at["taken"]] for _ in range(r[at["taken"]] // r[at["size"]]))
    out = corpus_pipeline.mix_stage(spark, docs, SF)
    assert out.columns == COLUMNS and sorted(d for d, _ in plain(out)) == want


def test_near_stage_finds_pairs_at_its_own_threshold(spark, docs):
    """A pair of similarity just above 0.8 that meets in no band of four registers."""
    stem = " ".join(f"c2531x{i}" for i in range(400))
    pair = [(i, stem + " " + " ".join(f"{s}2531x{k}" for k in range(49)), "en", "x", 1) for i, s in ((1, "a"), (2, "b"))]
    assert [r.doc_id for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(pair, docs.schema), SF).collect()] == [1]
    for t in range(20, 100):
        k = neardup.band_size(t)
        assert (1 - (t / 100) ** k) ** (neardup.BUCKETS // k) <= 1e-5, t
    assert neardup.band_size(85) == 4 and neardup.band_size(80) == 3


def test_dedup_stages_keep_one_row_of_each_group_with_repeated_and_null_ids(spark, docs):
    """Ids that repeat, over one text and over two, and null ids, alone and beside a real one."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    near = lambda t: t + " tail"
    table = lambda rows: spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], docs.schema).repartition(3)
    rows = [(5, a), (5, a), (7, a), (None, b), (None, b), (None, c), (3, c), (8, d), (8, c)]
    assert sorted(plain(corpus_pipeline.exact_stage(spark, table(rows), SF)), key=str) == sorted([(5, a), (None, b), (3, c), (8, d)], key=str)
    rows += [(4, near(a)), (None, near(b)), (None, near(c)), (8, near(d))]
    got = corpus_pipeline.near_stage(spark, table(rows), SF)
    assert got.columns == COLUMNS
    out = sorted(((i, t.removesuffix(" tail")) for i, t in plain(got)), key=str)
    assert out == sorted([(4, a), (None, b), (3, c), (8, d)], key=str)


def test_dedup_stages_leave_no_texts_where_ids_are_unique(spark, docs):
    """Once a stage's result is there, the shared folder has only the ids that it chose, and no copy of the table."""
    folder = Path(urlparse(shared_dir(spark)).path)
    for name in ("exact", "near"):
        before = set(folder.iterdir())
        assert STAGES[name](spark, docs, SF).count() > 100
        assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["chosen"], name


def test_dedup_stages_shuffle_no_texts_for_their_choice(spark, docs):
    """What goes is told from what stays without a shuffle of all texts, however long the list is."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.bytes(6).hex() for _ in range(150)) for _ in range(600)]
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(texts)] + [(1000 + i, t, "en", "x", 1) for i, t in enumerate(texts[:40])]
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    held, sc = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.sparkContext
    at, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("exact", "near"):
            out = STAGES[name](spark, materialise(df, "table"), SF)
            sc.setJobGroup(f"choice-{name}", name)
            got = out.collect()
            sc.setLocalProperty("spark.jobGroup.id", None)
            stages = {s for j in at.getJobIdsForGroup(f"choice-{name}") for s in at.getJobInfo(j).stageIds if at.getStageInfo(s)}
            written = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
            assert sorted(r.doc_id for r in got) == list(range(600)), name
            assert stages and written < sum(map(len, texts)) / 8, (name, written)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_rows_that_share_a_bit_with_one_that_goes_stay(spark, docs, monkeypatch):
    ids = list(range(-300, 300))
    df = spark.createDataFrame([(i, f"t{i}", "en", "x", 1) for i in ids], docs.schema).withColumn("own", F.col("doc_id"))
    gone = materialise(spark.createDataFrame([(i,) for i in ids if i % 3 == 0], "own long"), "gone")
    for most in (1, 40, corpus_pipeline.MOST_BITS):
        monkeypatch.setattr(corpus_pipeline, "MOST_BITS", most)
        got = corpus_pipeline._without(df, "own", gone)
        assert got.columns == df.columns and sorted(plain(got)) == [(i, f"t{i}") for i in ids if i % 3], most
    assert corpus_pipeline._without(df, "own", gone.filter("own > 1000")).count() == len(ids)


def test_dedup_stages_drop_shuffle_files_query_by_query(spark, docs):
    """Shuffle files of what the operator wrote are gone before it ends, without waiting for the driver's garbage collection."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in disk.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_") and b.endswith(".data")}
    name, left = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    held = spark.conf.get(name, None)

    def operator(df, key):
        before = shuffled()
        materialise(df.select(key).repartition(7, key), "own")
        for _ in range(100):
            left[:] = shuffled() - before
            if not left:
                break
            time.sleep(0.1)
        return df.select(F.col(key).alias("doc_id"), F.col(key).alias("group"))

    for table in (docs, docs.unionByName(docs)):
        assert corpus_pipeline._one_of_each(table, operator, "group").count() == table.count()
        assert left == [] and spark.conf.get(name, None) == held


def test_mix_stage_judges_each_row_by_its_own_source(spark, docs):
    """An id in two sources, rows that repeat, null ids and sources, columns with the names used inside."""
    words = " ".join(["w"] * 40)
    rows = [(1, words, "en", s, 1) for s in ("a", "b", "c")] + [(i, words, "en", "c", 1) for i in range(2, 8)] * 2 + [(i, words, "en", "a", 1) for i in range(10, 60)] + [(None, words, "en", None, 1), (None, None, None, None, None), (3, "", "en", "b", 1)]
    df = spark.createDataFrame(rows, docs.schema)
    clash = df.withColumns({c: F.lit(c) for c in ("row", "id", "group", "cut", "copy", "copy_", "times", "taken", "size", "h", "key")})
    got = corpus_pipeline.mix_stage(spark, clash, SF)
    assert got.columns == clash.columns and {r.copy for r in got.select("copy").distinct().collect()} == {"copy"}
    count = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    each = {r.source_size: r.target for r in mixing.mix(df).collect()}
    size = {s: 40 * sum(1 for x in rows if x[3] == s and x[1]) for s in ("a", "b", "c", None)}
    for s in size:
        assert abs(40 * count.get(s, 0) - each[size[s]]) <= 40 * 2, s
    for name in ("exact", "near"):
        out = STAGES[name](spark, clash, SF)
        assert out.columns == clash.columns and out.count() >= 1


def test_whole_pipeline(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(queries.PIECES))
    got = corpus_pipeline.run(spark, SF).collect()
    texts = dict(plain(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got and len({r.doc_id for r in got}) <= len(texts)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r["ids"]) // 4
        assert r.round_trip == (sp.decode(sp.encode(texts[r.doc_id])) == texts[r.doc_id])
    kept = [(r.doc_id, texts[r.doc_id]) for r in {r.doc_id: r for r in got}.values()]
    assert all(r[3] for r in brute.exact(kept)) and all(c == d for d, (_, c) in brute.near(kept, 5, 80).items())


def test_empty_table(spark, docs):
    none = docs.filter(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(queries.QUERIES) <= set(q) and q["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLE) <= set(e.oracle_sql())
