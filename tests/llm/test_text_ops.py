"""The text operators against the straightforward versions, on a test table and on hand-made rows."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact, graph, language, licenses, mixing, neardup, pieces, queries, substring, tokenfile
from sparkloom.llm.common import WORD as WORD_PATTERN

SF = "/root/testdata/sf0.01"
#: Ids, nulls, empty and blank texts, one word, repeats of a text, odd spaces, marks beyond ASCII, a very long text.
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "a  b\tc"), (7, "a b c"), (8, "A b C"), (9, " x y \x1cz"), (10, "Über İstanbul ß"),
    (11, LONG), (12, LONG), (13, LONG + " tail"), (14, "The MIT License, and the mit-license; Apache  License 2.0"), (15, "\u0000 nul"), (16, "▁mark ▁▁ of the space"), (17, "x " * 50), (18, "x " * 50), (19, "é ﬁ ΣΣ Σ"), (20, "<|endoftext|> </s>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def hard(spark):
    """Columns that no operator asked for, with the names they use inside."""
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    extra = ["did", "th", "n", "fp", "rep", "key", "size", "h", "name", "kept", "keep_id", "text_sha256", "component_id", "bucket", "target"]
    return df.withColumns({c: F.lit(c) for c in extra}).withColumns({"source": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))), "lang": F.lit("en")})


@pytest.fixture(scope="module")
def empty(hard):
    return hard.filter("doc_id < 0")


def both(docs, hard, plain):
    return ((docs, plain), (hard, HARD))


def test_license_phrases(docs, plain, hard):
    for df, rows in both(docs, hard, plain):
        got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
        want = brute.licenses(rows)
        assert {d: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for d, r in got.items()} == want
        for r in got.values():
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
            assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_license_templates_are_joined_exactly(spark):
    """Against counting every template's words in every block."""
    rng = np.random.default_rng(7)
    tokens = sorted({t for _, x in licenses.TEMPLATES for t in x.split()}) + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        label, x = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = [t if rng.random() < 1 - 0.05 * (i % 7) else str(rng.choice(tokens)) for t in x.split()]
        rows.append((i, " ".join([*rng.choice(tokens, int(rng.integers(0, 90))), *w, *rng.choice(tokens, int(rng.integers(0, 90)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    matcher = licenses.TemplateJoin(licenses.template_frequency(df))
    for _, text in rows:
        w, want = licenses.license_words(text), set()
        for start in range(0, max(1, len(w) - matcher.step), matcher.step):
            block = set(w[start : start + 2 * matcher.step])
            for label, x in licenses.TEMPLATES:
                t = set(x.split())
                if len(t & block) >= licenses.ceil(licenses.THRESHOLD * len(t)):
                    want.add((label, start))
        assert {(label, start) for label, _, start in matcher.join(w)} == want
    assert matcher.rejected["position"] > 0  # blocks that share a rare token too late are not verified
    assert {r.labels for r in licenses.license_scan(df).collect()} >= {"bsd", "isc"}


def test_language(docs, hard, empty):
    model = language.fit(docs)
    assert model.languages == ("de", "en", "es", "fr")
    got = language.predict(docs, model)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in got.collect() if r.held_out]
    assert len(held) > 150 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())
    odd = {r.doc_id: r for r in language.predict(hard, model).collect()}
    assert len(odd) == len(HARD) and {odd[i].lang_pred for i in (1, 2, 3)} == {"und"} and odd[1].score == 0
    none = language.fit(empty)
    assert none.languages == () and {r.lang_pred for r in language.predict(hard, none).collect()} == {"und"}


def test_prediction_looks_at_the_text_alone(docs):
    model = language.fit(docs)
    some = docs.limit(50)
    a = language.predict(some, model).select("doc_id", "lang_pred", "score").collect()
    b = language.predict(some.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")}), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_trigrams_are_bound_in_order():
    e = language.Encoder(256)
    one, two = (e.bundle(np.array([a << 42 | b << 21 | c]), np.array([1])) for a, b, c in ((97, 98, 99), (99, 98, 97)))
    assert abs(one @ two) < 80 and one @ one == 256
    a, b, c = map(e.letter, (97, 98, 99))
    assert (one == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_exact_dedup(docs, plain, hard, empty):
    for df, rows in both(docs, hard, plain):
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(df).collect())
        assert got == sorted(brute.exact(rows))
    assert exact.exact_dedup(empty).count() == 0


def test_exact_dedup_names_blocks_of_any_size(spark):
    rows = [(i, "ab" * (i % 9) + "c" * (i % 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 3, 16):
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(df, block_chars=size).collect())
        assert got == sorted(brute.exact(rows))


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, None), (3, "y")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (None, None, 1, True), (3, 3, 1, True)], key=str)


def test_substring_dedup(docs, plain, hard, empty):
    for df, rows in both(docs, hard, plain):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df).collect()}
        assert got == brute.repeats(rows)
    assert substring.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [4, 7, 20])
def test_substring_dedup_of_few_words(spark, length):
    """Two words only, so windows repeat everywhere, overlap themselves and each other."""
    rng = np.random.default_rng(length)
    rows = [(int(i), " ".join(rng.choice(["a", "b"], int(n), p=[0.8, 0.2]))) for i, n in zip(rng.permutation(150), rng.integers(0, 80, 150), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, length=length).collect()}
    assert got == brute.repeats(rows, length)


def test_substring_dedup_settles_in_parts(spark, plain, docs, monkeypatch):
    """One-row slices and tiny buffers must not change anything."""
    monkeypatch.setattr(substring, "HELD", 500)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs.repartition(5)).collect()}
    assert got == brute.repeats(plain)


def test_near_dedup(docs, plain, hard, empty):
    for df, rows in both(docs, hard, plain):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
        assert got == brute.near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle=5, threshold=80).collect()}
    assert got == brute.near(plain, 5, 80)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_dedup_of_chains_and_large_groups(spark):
    """Drifting copies (a chain whose ends differ), one large group around a text, and short texts with one word changed."""
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(500)]
    rows, w = [], list(rng.choice(words, 120))
    for _ in range(60):
        rows.append(" ".join(w))
        w[int(rng.integers(0, 120))] = str(rng.choice(words))
    base = list(rng.choice(words, 90))
    for _ in range(150):
        v = list(base)
        for at in rng.integers(0, 90, int(rng.integers(0, 4))):
            v[int(at)] = str(rng.choice(words))
        rows.append(" ".join(v))
    rows += [" ".join(rng.choice(words[:6], int(rng.integers(1, 12)))) for _ in range(150)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute.near(rows)


def test_prefixes_leave_out_what_many_sets_hold_whatever_the_hashes(spark):
    """Rare tokens that lie close together, as the many tokens of a large table do, still come before frequent ones."""
    often = np.arange(1, 21, dtype=np.uint64) << np.uint64(58)  # in all sets, far from each other
    sets = [np.concatenate([np.arange(80, dtype=np.uint64) + np.uint64(1 + 80 * i), often]) for i in range(40)]
    sets.append(np.concatenate([sets[0][:79], often]))
    held = spark.createDataFrame([(i, i, s.tobytes()) for i, s in enumerate(sets)], "rep long, comp long, s binary")
    got = {}
    for r in neardup._prefixes(held, 85).collect():
        got.setdefault(r.rep, {})[r.pos] = r.token
    assert got.keys() == set(range(41)) and all(sorted(p) == list(range(len(s) - -(-85 * len(s) // 100) + 1)) for p, s in zip((got[i] for i in range(41)), sets, strict=True))
    assert all({*p.values()}.isdisjoint(often.tolist()) and {*p.values()} <= {*sets[i].tolist()} for i, p in got.items())
    assert {*got[0].values()} & {*got[40].values()}  # the two that are alike meet


@pytest.mark.parametrize("small", [2, 16])
def test_near_dedup_of_pages_from_one_template(spark, monkeypatch, small):
    """What most pages share alone is not compared; pairs among them are found, by rare tokens and by frequent ones."""
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = np.random.default_rng(8)
    stem = [f"t{i}" for i in range(170)]
    own = lambda i, n: [f"u{i}x{k}" for k in range(n)]
    rows = [(i, " ".join([*stem, *own(i, 30)])) for i in range(200)]
    rows += [(1000 + i, " ".join([*stem, *own(i, 28), f"z{i}"])) for i in range(0, 200, 9)]
    for g in range(4):  # sections that many pages have, each page with some
        part = [f"s{g}x{k}" for k in range(25)]
        rows += [(2000 + 100 * g + i, " ".join([*stem, *part[: int(rng.integers(15, 25))], *own(2000 + 100 * g + i, int(rng.integers(4, 14)))])) for i in range(25)]
    met = []
    links = neardup._links
    monkeypatch.setattr(neardup, "_links", lambda p, *a: (met.append(p.distinct().count()), links(p, *a))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute.near(rows)
    assert sum(met) < len(rows) * len(rows) / 8, met


@pytest.mark.parametrize("most", [0, 150, 1 << 16])
def test_components(spark, monkeypatch, most):
    """By rounds to the end, by some rounds and one task, and by one task alone, which writes no tables on its way."""
    monkeypatch.setattr(graph, "ONE_TASK", most, raising=False)
    written, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (written.append(name), write(df, name))[1])
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [tuple(p) for p in rng.integers(300, 400, (80, 2)).tolist()]
    edges = [*edges, *((b, a) for a, b in edges[::3]), (7, 7), (-(2**63), 2**63 - 1)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert most < len(edges) or not written
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_dedup_of_small_tables_takes_few_tasks(spark):
    """Where tasks are many and small, rounds and shuffles are what takes the time."""
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(3):
        base = list(rng.choice(words, 60))
        for _ in range(30):
            base[int(rng.integers(0, 60))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("few", "few")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == brute.near(rows)
    at = sc.statusTracker()
    infos = {s: at.getStageInfo(s) for j in at.getJobIdsForGroup("few") for s in at.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in infos.values() if i)
    assert 100 < tasks < 1600, tasks


def test_near_dedup_in_many_parts_and_blocks(spark, monkeypatch):
    """Hubs of many parts, and a cluster of many blocks: every one has rows of its own, and no link is lost."""
    monkeypatch.setattr(neardup, "FAN", 5)
    monkeypatch.setattr(neardup, "BLOCK", 12)
    monkeypatch.setattr(neardup, "SMALL", 2)
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for n, most in ((90, 3), (60, 9)):  # all near the first, and many that just are not
        base = list(rng.choice(words, 80))
        for _ in range(n):
            v = list(base)
            for at in rng.integers(0, 80, int(rng.integers(0, most + 1))):
                v[int(at)] = str(rng.choice(words))
            rows.append((len(rows), " ".join(v)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.near(rows)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
            cut = int(3000 * (1 - share) / 2)
            a, b = np.unique(pool[: 3000 - cut]), np.unique(pool[cut:])
            n, m = np.array([len(a)]), np.array([len(b)])
            j, _ = neardup.estimate(neardup.registers(a)[None, :], neardup.registers(b)[None, :], n, m)
            errors.append(float(j[0]) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_source_mix(docs, hard, empty, spark, tmp_path):
    from oracle import assert_same

    assert_same(mixing.mix(docs), SF, mixing.ORACLE)
    got = mixing.mix(hard).collect()
    assert len(got) == len(HARD)
    sizes = {d: len(brute.WORD.findall(t or "")) for d, t in HARD}
    for r in got:
        assert r["size"] == sizes[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        assert r.target <= 3 * r.source_size + 1e-6
    assert abs(sum({r.source_size: r.target for r in got}.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values()) + 1
    again = mixing.mix(hard.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(empty).count() == 0
    assert WORD_PATTERN == brute.WORD.pattern


def test_source_mix_comes_near_its_targets(docs):
    """Within half the largest document of each source."""
    m = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.max("size").alias("most")).collect():
        assert abs(r.t - r.goal) <= r.most / 2 + 1


def test_mixes_of_growing_budgets_are_nested(docs):
    small = {r.doc_id for r in mixing.mix(docs, weights=(1, 2, 2)).filter("taken > 0").collect()}
    more = mixing.mix(docs.withColumn("source", F.when(F.col("source") == sorted(r.source for r in docs.select("source").distinct().collect())[0], F.col("source")).otherwise(F.lit("rest"))), weights=(1, 1))
    assert small and more.filter("taken > 0").count() > 0


def test_token_files(docs, plain, hard, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer(queries.WORD_BPE)
    tok = Tokenizer.from_file(path)
    for df, rows in both(docs, hard, plain):
        start, want = 0, {}
        for d, t in sorted(rows):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            want[d] = (start, len(ids), brute.crc_of(ids))
            start += len(ids)
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_output(df, path).collect()} == want
    assert tokenfile.token_output(empty, path).count() == 0


def test_special_strings_in_any_case_get_the_librarys_ids():
    encoder = tokenfile.WordEncoder(queries.tokenizer(queries.WORD_BPE))
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "x<|STARTOFTEXT|>y", "<|endoftext|> Σ", "plain words"]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


def test_composing_happens_before_lower_casing_and_only_there():
    """Some capitals with a mark have no composed form while the small letter has one."""
    encoder = tokenfile.WordEncoder(queries.tokenizer(queries.WORD_BPE))
    texts = ["J\u030c x", "a H\u0331 b", "T\u0308 W\u030a Y\u030a", "e\u0301", "plain words"]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


def test_each_distinct_word_is_encoded_once_in_a_group_of_texts(monkeypatch):
    encoder = tokenfile.WordEncoder(queries.tokenizer(queries.WORD_BPE))
    odd = ["don't stop, don't", "a\tb\x0bc\r\nd", "naïve (naïve) naïve...", "'s it''s !'s x's", " lead", "trail ", "\n", "|", "2024 a1b2 ###", "日本 語 дом", "x\xa0y \x85 z", "\u2028", "Ünder|über", "end.", "end", "."]
    assert encoder.encode([*odd, None, ""]) == [*map(encoder.whole, odd), b"", b""]
    runs, merged = [], encoder._merged
    monkeypatch.setattr(encoder, "_merged", lambda words: runs.append(words.to_pylist()) or merged(words))
    texts = [" ".join(f"{'abc'[(i + k) % 3]}{'xyz'[k % 2]}{',' * (k % 5 == 0)}" for k in range(300)) for i in range(40)]
    want = [encoder.whole(t) for t in texts]
    assert encoder.encode(texts) == want
    assert len(runs) == 1 and sorted(runs[0]) == [",", "ax", "ay", "bx", "by", "cx", "cy"]
    monkeypatch.setattr(tokenfile, "GATHERED", 7)
    assert encoder.encode(texts) == want


def test_long_words_are_not_kept():
    encoder = tokenfile.WordEncoder(queries.tokenizer(queries.WORD_BPE))
    text = "don't " + "1" * 1000
    assert encoder.encode([text]) == [encoder.whole(text)] and set(encoder.kept) == {"don't"}


def test_token_file_reads_only_what_it_needs_and_finds_damage(tmp_path):
    uri = f"file://{tmp_path}/x.tok"
    w = tokenfile.TokenFileWriter(uri, 2, frame_tokens=100)
    docs = [(i * 3, np.arange(i * 7 % 250, dtype="<u4")) for i in range(200)]
    for d, ids in docs:
        w.add(d, ids.tobytes())
    w.close()
    f = tokenfile.TokenFile(uri)
    opened = f.frames_read
    assert (f.tokens(f.find(300)) == docs[100][1]).all() and f.frames_read - opened <= 4
    assert all((f.tokens(i) == ids).all() for i, (_, ids) in enumerate(docs))
    with pytest.raises(KeyError):
        f.find(301)
    raw = bytearray((tmp_path / "x.tok").read_bytes())
    raw[60] ^= 255
    (tmp_path / "x.tok").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  by the frame's own format or by its checksum
        g = tokenfile.TokenFile(uri)
        [g.tokens(i) for i in range(200)]


def test_pieces(docs, plain, hard, empty):
    import sentencepiece

    path = queries.tokenizer(queries.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df, rows, chunk in ((docs, plain, 4000), (docs, plain, pieces.CHUNK_CHARS), (hard, HARD, 1000)):
        got = {r.doc_id: r for r in pieces.encode_documents(df, path, chunk_chars=chunk).collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            assert np.frombuffer(got[d]["ids"], "<u4").tolist() == sp.encode(t or ""), d
            assert got[d].round_trip == (sp.decode(sp.encode(t or "")) == (t or "")), d
        back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(df, path, chunk_chars=chunk), path).collect()}
        assert all(back[d] == sp.decode(sp.encode(t or "")) for d, t in rows)
    assert pieces.encode_documents(empty, path).count() == 0


def test_max_plus_chunks_give_the_best_path():
    """Against one Viterbi pass over the whole text, for chunks shorter and longer than the longest piece."""
    rng = np.random.default_rng(11)
    scores = {c: float(-rng.integers(20, 60)) / 8 for c in "abcd"}
    for n in (2, 3, 5, 6):
        for _ in range(25):
            scores["".join(rng.choice(list("abcd"), n))] = float(-rng.integers(20, 160)) / 8
    lex = pieces.Lexicon(scores)
    for _ in range(25):
        text = "".join(rng.choice(list("abcde"), int(rng.integers(0, 90))))
        best = [0.0] + [-np.inf] * len(text)
        for i in range(len(text)):
            for n, s in lex.arcs(text, i):
                best[i + n] = max(best[i + n], best[i] + s)
        for chunk in (1, 4, 17, 1000):
            out = pieces.segment(lex, text, chunk)
            assert "".join(out) == text
            assert abs(sum(lex.scores.get(p, lex.unknown) for p in out) - best[-1]) < 1e-9


def test_max_plus_over_the_cluster(spark):
    """Levels of products and back, for documents of one to many chunks."""
    rng = np.random.default_rng(2)
    scores = {c: float(-rng.integers(20, 60)) / 8 for c in "abcd"} | {"".join(rng.choice(list("abcd"), n)): float(-rng.integers(20, 160)) / 8 for n in (2, 3, 5) for _ in range(25)}
    lex = pieces.Lexicon(scores)
    rows = [(1, None), (2, ""), (3, "a"), (4, "abcde"), (5, "abcde")] + [(i, "".join(rng.choice(list("abcde"), int(n)))) for i, n in enumerate(rng.integers(0, 900, 20), 10)] * 2
    got = pieces.segment_documents(spark.createDataFrame(rows, "doc_id long, text string"), lex, chunk_chars=40, fan=3).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows) and max(r.n_chunks for r in got) > 9
    texts, total = dict(rows), lambda ps: sum(lex.scores.get(p, lex.unknown) for p in ps)
    for r in got:
        assert "".join(r.pieces) == (texts[r.doc_id] or "")
        assert abs(total(r.pieces) - total(pieces.segment(lex, texts[r.doc_id] or "", 1 << 20))) < 1e-9


def _viterbi(lex, t):
    """Best score of *t*, one position after the other."""
    best = [0.0] + [-np.inf] * len(t)
    for i in range(len(t)):
        for n in range(1, min(lex.longest, len(t) - i) + 1):
            s = lex.scores.get(t[i : i + n], lex.unknown if n == 1 else None)
            if s is not None:
                best[i + n] = max(best[i + n], best[i] + s)
    return best[-1]


def test_best_paths_of_the_public_pieces(spark, docs, plain, hard, empty):
    """The scan's scores against one pass over the whole text, whatever the chunks; ids decode to the text."""
    encoder = pieces.piece_encoder(queries.tokenizer(queries.PIECES))
    lex = encoder.lexicon
    odd = [(30, "x" * 7000), (31, "日本語" * 900), (32, "▁" * 3000), (33, "a" * 500 + "☃" * 900 + " tail"), (34, "internationalisation" * 300), (34, "internationalisation" * 300), (None, "two words"), (None, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"row": F.lit(1), "chunk": F.lit("c"), "merged": F.lit(2), "ids": F.lit(3)})
    some = [(d, t) for d, t in plain if t and len(t) < 3000][:300]
    few = docs.filter(F.col("doc_id").isin([d for d, _ in some]))
    for df, rows, chunk in ((more, odd, 100), (more, odd, 1 << 16), (few, some, 400), (hard.filter("doc_id NOT IN (11, 12, 13)"), HARD[:10] + HARD[13:], 37)):
        got = pieces.encode_documents(df, queries.tokenizer(queries.PIECES), chunk_chars=chunk, fan=3).collect()
        texts = {r: set() for r, _ in rows}
        for r, t in rows:
            texts[r].add(t)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r) for r, _ in rows)
        for r in got:
            t = next((t for t in texts[r.doc_id] if len(texts[r.doc_id]) == 1 or (t or "") == encoder.decode(r.best_ids)), None) or ""
            marked = "▁" + t.replace(" ", "▁") if t else ""
            assert r.best_score == _viterbi(lex, marked), (r.doc_id, chunk)
            assert encoder.decode(r.best_ids) == t.replace("▁", " ") and encoder.decode(r["ids"]) == t.replace("▁", " ")
            assert r.n_best == len(r.best_ids) // 4 and r.n_chunks == (max(1, -(-len(marked) // chunk)) if len(t) > chunk else 1)
            assert np.frombuffer(r["ids"], "<u4").tolist() == encoder.sp.encode(t), r.doc_id


def test_best_paths_equal_the_librarys_unigram_scores(plain):
    """The same pieces loaded as a unigram model: short texts, for which its single precision is exact.

    The pieces of several spaces have a score of -1e9, beside which single precision loses the others; no text here
    can use them, so the library gets a milder score for them.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = queries.tokenizer(queries.PIECES)
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)
    unigram = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder = pieces.piece_encoder(path)
    covered = {c for p in encoder.piece_ids for c in p}
    texts = [" ".join(t.split()[:12]) for _, t in plain if t][:400]
    texts = [t for t in texts if set(t.replace(" ", "▁")) <= covered]
    best = []
    encoder.encode_texts(texts, best)
    assert len(texts) > 200
    for t, (ids, score) in zip(texts, best, strict=True):
        library = sum(encoder.lexicon.scores[p] for p in unigram.encode(t, out_type=str))
        assert score == library and encoder.decode(ids) == t


def test_texts_without_spaces_are_cut():
    encoder = pieces.piece_encoder(queries.tokenizer(queries.PIECES))
    for t in ("日本語" * 5000, "".join(chr(0x4E00 + i % 2000) for i in range(9000)), ("abcdefghijklmnop" * 9 + "☃") * 60):
        parts = encoder.chunks(t, 1000)
        assert "".join(parts) == t and len(parts) > 4
        assert b"".join([encoder.encode(parts[0]), *map(encoder.encode_inner, parts[1:])]) == np.array(encoder.sp.encode(t), "<u4").tobytes()
