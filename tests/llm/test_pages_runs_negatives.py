"""Main text, periodic runs and hard negatives: on odd rows, on no rows, against brute force and held-out labels."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import labelled_pages, main_text, periodic_runs, queries, rtree_negatives
from ledgerloom.llm.dom import parse

# -- main text

PAGES = {
    "template": ('<head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now please.</div>'
                 "<article><h1>Title &amp; more</h1><p><b>One\n  two&nbsp;three.<br><p>Four &lt;five&gt;, six.</p><p>Short.</p></article><footer>&copy; x.example</footer></body>", "Title & more\n\nOne two three.\n\nFour <five>, six.\n\nShort."),
    "blog": ('<div id="page"><header id="masthead"><a href="/">Blog</a><p>Just a site</p></header><div id="content"><div class="post"><h1>A day</h1><div class="entry-content"><p>First of all with a <a href=x>link</a> inside.</p><div class="adsbygoogle">Buy!</div><p>Second, and last.</p></div></div>'
             '<div id="comments"><h3>2 thoughts</h3><ol><li><p>Great post, I really enjoyed it.</p></li></ol><form><p>Leave a reply</p></form></div></div><aside><h2>Recent</h2><ul><li><a href=x>Foo</a></ul></aside><footer><p>&copy; me</p></footer></div>', "A day\n\nFirst of all with a link inside.\n\nSecond, and last."),
    "plain": ("no markup at\tall", "no markup at all"),
    "unclosed comment": ("<p>before, we said.</p><!-- <p>never", "before, we said."),
    "script only": ("<script>alert('<p>no</p>')</script><style>x</style>", ""),
}


def test_pages_of_known_text(spark):
    model = main_text.standard_model()
    rows = [(i, name, page, "old") for i, (name, (page, _)) in enumerate(PAGES.items())]
    rows += [(100, None, None, None), (101, "u", "", None), (None, "u", PAGES["plain"][0], None), (0, "again", PAGES["template"][0], None), (102, "long", "<article>" + "<p>" + "word, " * 40_000 + "</p>" * 2 + "</article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = {(r["page_id"], r["url"]): r for r in main_text.extract(pages, model).collect()}
    assert len(got) == len(rows)
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        assert got[i, name]["text"] == want, name
    assert got[100, None]["text"] == got[101, "u"]["text"] == "" and got[100, None]["blocks"] == 0
    assert got[None, "u"]["text"] == PAGES["plain"][1] and got[0, "again"]["text"] == PAGES["template"][1]
    assert len(got[102, "long"]["text"]) == 6 * 40_000 - 1
    assert main_text.extract(spark.createDataFrame([], pages.schema), model).collect() == []


def test_main_text_of_held_out_pages():
    model = main_text.standard_model()
    trees = [parse(p) for p in labelled_pages.write_pages(200, seed=977)]
    wrong = total = 0
    for tree, content in zip(trees, model.content(trees)):
        leaf = np.array([n.text is not None for n in tree])
        wrong += int((((content >= 0.5) != main_text.labels_of(tree)) & leaf).sum())
        total += int(leaf.sum())
    assert wrong <= 0.01 * total


def test_marginals_against_all_assignments():
    page = '<div class="ad"><p>a b</p>c</div><article><h1>t</h1><p>x, y z.</p></article>'
    forest = main_text.Forest([parse(page), parse("<p>one")])
    rng = np.random.default_rng(3)
    weights, pairs = rng.normal(size=main_text.WIDTH), rng.normal(size=(main_text.KINDS, 2, 2))
    single, joint = forest.marginals(weights, pairs)
    n = forest.starts[1]
    own = np.bincount(forest.row, weights[forest.column], len(forest.parent))
    total, p, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for bits in range(2**n):
        y = [bits >> i & 1 for i in range(n)]
        w = math.exp(sum(own[i] * y[i] for i in range(n)) + sum(pairs[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, n)))
        total += w
        p += w * np.array(y)
        for i in range(1, n):
            both[i, y[forest.parent[i]], y[i]] += w
    assert np.allclose(single[:n, 1], p / total) and np.allclose(joint[1:n], both[1:] / total)


def test_main_text_of_the_tables_pages(spark, sf):
    """These pages have one article each, whose blocks can be told by plain patterns."""
    import html
    import re

    for r in queries.op11_main_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").drop("url"), "page_id").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        parts = re.sub(r"</?(?:p|h1|article)\b[^>]*>", "\x00", re.sub(r"<(?:br|/?b)>", " ", inner)).split("\x00")
        want = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


# -- periodic runs


def plain_runs(words, exponent=4, least=6):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_words(rng):
    words = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        block = [rng.randrange(9) for _ in range(rng.randint(1, 13))]
        at = rng.randint(0, len(words))
        words[at:at] = (block * 20)[: rng.randint(1, 9 * len(block))]
    return words


def test_catchers_find_all_runs_however_words_are_appended():
    rng = random.Random(12)
    for _ in range(400):
        words = periodic_words(rng)
        for exponent, least in ((4, 6), (2, 2)):
            params = periodic_runs.RunParams(least_exponent=exponent, least_length=least, segment=rng.choice((7, 64, 65_536)), long_run=rng.choice((8, 256)))
            want = plain_runs(words, exponent, least)
            assert periodic_runs.word_runs(words, params) == want
            online = periodic_runs.SquareCatchers(params)
            for i, w in enumerate(words):  # word by word; the runs so far are those of the words so far
                online.append(np.array([w]))
                if i % 40 == 0:
                    assert online.runs() == plain_runs(words[: i + 1], exponent, least)
            assert online.runs() == want


def test_long_periodic_texts_take_linear_time():
    assert periodic_runs.word_runs([0] * 300_000) == [(0, 300_000, 1)]
    assert periodic_runs.word_runs(list(range(5_000)) * 8) == [(0, 40_000, 5_000)]
    assert len(periodic_runs.word_runs([i // 6 % 2 for i in range(24_000)])) == 4_001


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"w{w}" for w in periodic_words(rng)) for _ in range(150)] + [None, "", " \t\n ", "one", "a a a a a a", "é É é é x", " ".join(["aa bb"] * 9_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (3, "again again again again again again")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        words = [w.decode() for w in words]
        runs = plain_runs(words) if n < 5_000 else [(0, n, 2)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        want.append((doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x x x x x x y", "old", 5)], "doc_id long, text string, runs string, n_runs int")
    row = periodic_runs.find_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 1)] and row["collapsed"] == "x y" and row["n_runs"] == 5
    assert periodic_runs.find_runs(docs.where("false")).collect() == []


# -- hard negatives


def _vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim)) * 40
    rows = [(i, (centres[i % 10] + rng.normal(size=dim) * 90).round().tolist(), int(i % 10) if i % 3 else 4) for i in range(n)]
    return rows + [(n + i, rows[1][1], rows[1][2]) for i in range(copies)]


def plain_negatives(rows, params, every=20):
    rows = {i: (label, v) for i, v, label in sorted(rows, key=lambda r: (r[2], r[1]), reverse=True)}
    out = []
    for a in (a for a in rows if a % every == 0):
        dot = {i: int(sum(int(x) * int(y) for x, y in zip(v, rows[a][1]))) for i, (_, v) in rows.items() if i != a and len(v) == len(rows[a][1])}
        order = sorted(dot, key=lambda i: (-dot[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][: params.positives]:
            fits = [i for i in order if rows[i][0] != rows[a][0] and params.least * dot[p] <= 100 * dot[i] <= params.most * dot[p]]
            out += [(a, p, k, i, dot[p], dot[i]) for k, i in enumerate(fits[: params.negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("params", [rtree_negatives.NegativeParams(), rtree_negatives.NegativeParams(tile=40, leaf=4, fanout=3, sample=300), rtree_negatives.NegativeParams(positives=2, negatives=9, least=50, most=120)])
def test_hard_negatives_against_brute_force(spark, params):
    rows = _vectors(700, 6, 1, copies=150)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = rtree_negatives.mine(vectors, F.col("vec_id") % 20 == 0, params).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, params)


def test_hard_negatives_of_odd_rows(spark):
    big = 2.0**40
    rows = [(0, [1.0, 2.0], 1), (20, [big, -big], 1), (1, [2.0, 2.0], 1), (2, [2.0, 1.0], 2), (3, [3.0, 1.0], 3), (4, [1.0, 1.0], 2), (21, [big, big - 1], 1), (22, [big, big - 1], 2), (5, [1.0, 2.0, 3.0], 1), (6, [1.0, 2.0, 2.0], 2), (40, [1.0, 2.0, 3.0], 2), (7, [5.0, 5.0], 9)]
    odd = [(None, [1.0, 1.0], 1), (8, None, 1), (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [float("inf"), 1.0], 2), (12, [2.0, 1.0], None), (13, [], 1), (2, [2.0, 1.0], 2), (7, [1.0, 2.0], 3)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, id int, tile string")
    got = sorted(map(tuple, rtree_negatives.mine(vectors, F.col("vec_id") % 20 == 0).collect()))
    assert got == plain_negatives([*rows, (7, [1.0, 2.0], 3)], rtree_negatives.NegativeParams()) and {0, 20} <= {r[0] for r in got}
    assert rtree_negatives.mine(vectors.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_tiles_hold_every_vector_and_split_copies(spark):
    rows = _vectors(3_000, 8, 2, copies=1_500)
    vectors = spark.createDataFrame([(i, label, v) for i, v, label in rows], "id long, label int, v array<double>")
    sizes = [r["count"] for r in rtree_negatives.placed(vectors, rtree_negatives.NegativeParams(tile=200, sample=2_000)).groupBy("dim", "label", "tile").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 3 * 200


def test_boxes_leave_out_leaves():
    """With vectors in clusters the queue opens few leaves, and the answers stay those of a full search."""
    rng = np.random.default_rng(8)
    points = (np.repeat(rng.normal(size=(40, 4)) * 200, 50, 0) + rng.normal(size=(2_000, 4)) * 4).round()
    tree = rtree_negatives.RTree(np.arange(2_000), points, rtree_negatives.NegativeParams())
    for q in points[::97]:
        known = {}
        got = tree.best(q, tree.bounds(q[None]), 0, -(2**63), 2**63 - 1, 5, None, known)
        scores = points @ q
        assert [s for s, _ in got] == sorted(scores.astype(int).tolist(), reverse=True)[:5] and len(known) < len(tree.levels[0][0]) / 3


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, found)) and found
