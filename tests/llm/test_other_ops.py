"""Pages, vectors, the pipeline, and what holds for all queries."""

import brute
import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import ann, html, queries

SF = "/root/testdata/sf0.01"


def test_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute.neighbours(vectors)
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(brute.neighbours([(q, dict(vectors)[q]), *((i, v) for i, v in vectors if i != q)], k=len(vectors)).get(q, [])) for q in list(want)[:5]}
    assert all(abs(exact[q][i] - s) < 1e-9 for q in exact for i, s in got[q])


def test_neighbours_of_odd_and_equal_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 16))
    rows = [(i, v[i].tolist()) for i in range(300)] + [(i, v[7].tolist()) for i in range(300, 400)]
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan"), *[1.0] * 15]), (460, [None, *[1.0] * 15]), (480, [float("inf")] * 16), (500, []), (520, [1.0, 2.0]), (541, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "d", "b", "g", "rank", "score")})
    want = brute.neighbours(rows)
    got = {}
    for r in ann.nearest(df, block=64, query_block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and [i for i, _ in got[520]] == [541]
    equal = [q for q in want if len({s for _, s in want[q]}) < 20]
    assert equal
    for q in want:
        assert len(got[q]) == len(want[q])
        if q in equal or q == 520:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]  # ties to the smaller id, in whichever block they lie
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    assert ann.nearest(df.filter("vec_id < 0")).count() == 0
    assert ann.nearest(df.filter("vec_id = 0")).count() == 0


def test_neighbours_in_many_blocks(spark):
    """Recall over many cells and blocks, whatever the order of the rows; repeated rows and ids, one hot vector."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    hot = df.filter("vec_id = 3").select(F.explode(F.expr("sequence(5000L, 5600L)")).alias("vec_id"), "embedding", "label")
    more = df.unionByName(hot).unionByName(df.filter("vec_id IN (7, 40)")).unionByName(df.filter("vec_id = 7"))
    want = brute.neighbours([(r.vec_id, r.embedding) for r in more.collect()])
    run = lambda x: ann.nearest(x, block=256, query_block=32).orderBy("query_id", "rank").collect()
    rows = run(more)
    assert rows == run(more.repartition(7, "label").sortWithinPartitions(F.desc("vec_id")))
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    near = {q: [i for i, _ in want[q]] for q in want}
    assert np.mean([len({i for i, _ in got[q]} & set(near[q])) / len(set(near[q])) for q in want]) >= 0.9
    copies = [q for q in want if q >= 5000]
    assert copies and all([i for i, _ in got[q]] == near[q] for q in copies)


def test_the_index_spares_most_vectors():
    """Rings count every vector in the windows once; far fewer than half of all vectors are verified."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    v = np.array(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    ids = t.column("vec_id").to_numpy()
    x = ann.BlockIndex.build(ids, np.ones(len(ids), int), v, np.linalg.norm(v, axis=1).max())
    x.search(ids[:100], v[:100], np.full(100, -np.inf), 20)
    assert x.verified < 0.4 * 100 * len(ids)
    seen = ann.Bounds(np.array([0, 1]), np.array([[-4.0] * 96, [3.0] * 96]), np.array([[4.0] * 96, [4.0] * 96])).touched(v[:50], np.full(50, 0.4))
    assert seen[:, 0].all() and not seen[:, 1].any()  # a far cell is not visited


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header class="top"><a href="/">Home</a></header>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>{0}
<aside class="sidebar"><p>Related stories that are long enough to look like content, really long enough.</p></aside>
<div id="comments"><p>First! A reader wrote this comment, which is fairly long as comments go.</p></div>
<form><label>Name</label><input name="q"><button>Send</button></form><script>var x = "<p>no</p>";</script>
<footer>&copy; 2024 All rights reserved</footer></body></html>"""
WANT = "A title\nFirst paragraph &  with an entity, and enough words to be read.\nShort.\nItem one\nItem two".replace("&  with", "& with")
BODY = "<h1>A title</h1><p>First   paragraph &amp;\n with an <b>entity</b>, and enough <a href='/x'>words</a> to be read.<p>Short.</p><ul><li>Item one<li>Item two</ul>"


def test_pages():
    for shell in ("<article>{0}</article>", "<main>{0}</main>", "<div class='article-body'>{0}</div>"):
        assert html.main_text(PAGE.format(shell.format(BODY))) == WANT, shell
    assert html.main_text(None) == html.main_text("") == html.main_text("<html><body></body></html>") == ""
    assert html.main_text("<p>broken <b>markup") == "broken markup"
    assert html.main_text("<script>x</script><!-- c -->") == ""


def test_nested_and_split_articles():
    """Everything below the outermost article is its text, and parts of one body are one article."""
    text = [f"Paragraph {i} has enough words in it to be read as a part of the article." for i in range(8)]
    p = [f"<p>{t}</p>" for t in text]
    title, first, rest = "<h1>A title</h1>", "".join(p[:3]), "".join(p[3:])
    want = "\n".join(["A title", *text])
    for shell in (
        f"<article>{title}{first}<div class='entry-content'>{rest}</div></article>",
        f"<article>{title}<div class='post-body'>{first}</div><div class='post-body'>{rest}</div></article>",
        f"<div>{title}<div class='post-body'>{first}</div><div class='ad'>Buy</div><div class='post-body'>{rest}</div></div>",
        f"<div>{title}<div itemprop='articleBody'>{p[0]}</div>{p[1]}{p[2]}<section itemprop='articleBody'>{rest}</section></div>",
        f"<main>{title}<article>{first}{rest}</article></main>",
        f"<article>{title}<article>{first}</article>{rest}</article>",
        f"<article>{title}{first}<section class='story-content'>{rest}</section></article>",
    ):
        assert html.main_text(PAGE.format(shell)) == want, shell


def test_unmarked_pages():
    """Without a marked article all content runs count, with what lies between and next to them."""
    para = lambda n: "<p>" + ("some words of the article " * n)[:n] + ".</p>"
    title = "<h1>A title</h1>"
    items = "<ul>" + "".join(f"<li>{('an item of the list %d ' % i * 3)[:40]}." for i in range(12)) + "</ul>"
    box = "<div class='related'><ul>" + "<li><a href='/r'>Another story</a>" * 12 + "</ul></div>"
    for body, n in (
        (title + para(300) * 20 + para(20_000) + para(300) * 19, 41),
        (title + para(600) * 10 + items + para(600) * 9, 32),
        (title + para(20) + para(600) * 5 + "<h2>Part</h2>" + para(400) * 5 + para(15), 14),
        (title + para(400) * 8 + box + para(400) * 8 + para(20), 18),
        ("<p>Equal words here.</p>" * 7, 7),
    ):
        got = html.main_text(PAGE.format(body)).split("\n")
        want = html.main_text(f"<article>{body}</article>").split("\n")
        assert len(want) == n and got == want, (n, len(got))
        assert html.main_text(PAGE.format(f"<div>{body}</div>")).split("\n") == want
    menu = "<div><a href='/'>Home</a> <a href='/b'>About</a></div>"
    assert html.main_text(f"<body>{menu}{title}{para(500) * 5}{menu}</body>").split("\n")[0] == "A title"
    assert len(html.main_text(f"<body>{menu}{title}{para(500) * 5}{menu}</body>").split("\n")) == 6


def test_content_lines_decide_between_marked_and_unmarked_text():
    para = "<p>" + "some words of the article " * 20 + ".</p>"
    teaser = "<article><h3>Another story</h3><p>A line on it.</p></article>"
    title = "<h1>A title</h1>"
    for page in (teaser * 2 + f"<div>{title}{para * 6}</div>", f"<div>{title}{para * 6}</div>" + teaser):
        got = html.main_text(PAGE.format(page)).split("\n")
        assert got[0] == "A title" and len(got) == 7 and not any("Another" in g for g in got)
    got = html.main_text(PAGE.format(f"<article>{title}{para * 6}<p>Short.</p></article><div>An unmarked line.</div>" + teaser)).split("\n")
    assert len(got) == 8 and got[0] == "A title" and got[-1] == "Short."


def test_the_threshold_decides_what_is_content(monkeypatch):
    """Many lines full of tags or few of text, the former longer together: the threshold alone tells which are the text."""
    links = "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(8))
    para = [f"Paragraph {i} " + "with some words of the article " * 12 for i in range(6)]
    ticks = "".join(f"<div><b>Tick</b> <i>no.</i> <em>{i}</em></div>" for i in range(300))
    box = "<div class='related'><ul>" + "<li><a href='/r'>Another story</a>" * 12 + "</ul></div>"
    page = f"<body><section>{ticks}</section>{box}<section>{links}{''.join(f'<p>{x}</p>' for x in para)}{links}</section></body>"
    want = "\n".join(x.strip() for x in para)
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "threshold", lambda _: -1.0)
    assert html.main_text(page).startswith("Tick no. 0\nTick no. 1\n") and "Paragraph" not in html.main_text(page)


def test_smoothing_and_threshold_against_plain_loops():
    """Lines of real pages: the Gaussian as a weighted mean, the threshold as the fixed point between two means."""
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()[:60]:
        p = html.Blocks()
        p.feed(page)
        p.close()
        p.flush()
        x = [0.0 if b[3] else float(np.log1p(b[1])) for b in p.blocks]
        flat = []
        for i in range(len(x)):
            near = [j for j in range(len(x)) if abs(i - j) <= 3 * html.SIGMA]
            g = [np.exp(-((i - j) ** 2) / (2 * html.SIGMA**2)) for j in near]
            flat.append(sum(a * x[j] for a, j in zip(g, near, strict=True)) / sum(g))
        assert np.allclose(flat, html.smooth(np.array(x)))
        t = html.threshold(np.array(flat))
        hi, lo = [v for v in flat if v >= t], [v for v in flat if v < t]
        assert not lo or abs(t - (sum(hi) / len(hi) + sum(lo) / len(lo)) / 2) < 1e-6


def test_end_tags_without_a_partner_cost_no_walk():
    """Time in proportion to the page, whatever is left open."""
    import time

    def seconds(n):
        t = time.process_time()
        html.main_text("<p>" + "<font size=1>word </b>" * n)
        html.main_text("<b><div>" + "<font size=1>" * n + "word</b>" * n)
        html.main_text("<div>" * n + "<li>x</li>" * n)
        return time.process_time() - t

    assert seconds(16_000) < 20 * max(seconds(2000), 0.02)


def test_page_rows(spark):
    rows = [(1, "u", PAGE.format(f"<article>{BODY}</article>")), (2, None, None), (3, "u", ""), (1, "u", PAGE.format(f"<article>{BODY}</article>")), (None, "z", "<p>x</p>" + "<div>" * 3000), (5, "w", "<article>" + "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("c")})
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == [WANT, WANT] and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html.extract_pages(df.filter("page_id < 0")).count() == 0


def test_every_page_of_the_table_has_a_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html.extract_pages(pages).collect()
    assert len(got) == pages.count() and np.mean([r.n_chars > 0 for r in got]) > 0.95


def test_threshold_and_smoothing():
    x = np.array([1, 1, 1, 9, 9, 9, 9, 1.0])
    assert 4 < html.threshold(x) < 6 and abs(html.smooth(np.ones(20)) - 1).max() < 1e-12


def test_every_query_is_named_and_whole(spark):
    """The ten, in order; each gives one row per row of its table (neighbours: 20 per query)."""
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    n = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    for name, f in queries.QUERIES.items():
        rows = f(spark, "/root/testdata/sf0.001").count()
        assert rows == {"op5": n["pages"], "op6": 20 * -(-n["embeddings"] // 20)}.get(name.split("_")[0], n["documents"]), name
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_oracles(spark):
    from oracle import assert_same

    for name, sql in queries.ORACLE.items():
        assert_same(queries.QUERIES[name](spark, SF), SF, sql)
