"""Main text, ranked lexical search and the dataset manifest against brute force."""

import hashlib
import html as markup
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import lexical, maintext, manifest
from notelake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- main text ---


def article(html):
    """The given pages' article, by its tags alone."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    blocks = [" ".join(markup.unescape(re.sub(r"<[^>]*>", "", part.replace("<br>", " "))).split()) for part in re.split(r"</?(?:p|h1)>", found[1] if found else "")]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_all_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op11_maintext"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "This sentence is long enough to be content, as it has many words and hardly any tag in it. "
PARTS = [
    '<nav class="main"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>',
    "<header><h1>Site</h1><p>The site of many words, whose motto is told on each and every page of it, again and again.</p></header>",
    '<div id="cookie-notice"><p>We use cookies on this site, and go on telling you so for as long as you like it or not.</p></div>',
    '<aside><h2>Read on</h2><p>Other things that one could read, told at some length so that one may well want to read them.</p></aside>',
    '<div class="sidebar"><p>Also beside the text, with a sentence that could well be part of it if it were elsewhere.</p></div>',
    '<form action="/s"><label>Search this site for words</label><input name="q"><button>Go</button></form>',
    '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I read all of this and agree with most of what it says about the matter in hand.</p></div></section>',
    '<div class="ad banner"><p>Buy this thing now, as it is cheap and good and will never be as cheap and good again.</p></div>',
    "<footer><p>All rights reserved by those who have reserved them, in all countries that know such rights.</p></footer>",
    "<script>var p = '<p>not a text</p>';</script><style>p{}</style><!-- <p>nor this</p> --><noscript><p>Turn it on</p></noscript>",
]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main><div>{}</div></main>", '<div id="content">{}</div>', "<div>{}</div>", '<div role="main"><section>{}</section></div>', "{}"])
def test_main_text_without_what_stands_around_it(shell):
    body = f"<h1>A  title &amp; more</h1><p>{LONG}<b>Bold</b>&nbsp;and\n <a href='x'>linked</a> words.</p><h2>Next</h2><ul><li>{LONG}</li><li>{LONG}one</li></ul><p>{LONG}&#8211; &eacute;</p><p>Short end.</p>"
    page = "<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>" + "".join(PARTS[:6]) + shell.format(body) + "".join(PARTS[6:]) + "</body></html>"
    one = LONG.strip()
    assert maintext.main_text(page).split("\n") == ["A title & more", f"{one} Bold and linked words.", "Next", one, f"{one} one", f"{one} – é", "Short end."]


def test_main_text_drops_parts_within_the_article():
    page = f"<article><header><h1>Title</h1><p>by someone</p></header><p>{LONG}</p>{PARTS[7]}<p>{LONG}</p><ul><li><a href='a'>Other page</a></li><li><a href='b'>One more</a></li></ul><p>Ok.</p>{PARTS[6]}<footer>tags</footer></article>"
    assert maintext.main_text(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}\nOk."
    form = f"<form id='aspnet'><div><article><p>{LONG}</p></article></div></form>"
    assert maintext.main_text(form) == LONG.strip()


def test_smoothing_and_threshold():
    assert np.allclose(maintext.smoothed(np.ones(9))[2:-2], 1)
    page = maintext.Lines()
    page.feed("<p><a>a</a> <a>b</a> <a>c</a></p>" * 6 + f"<p>{LONG}</p>" * 4 + "<p><a>a</a> <a>b</a> <a>c</a></p>" * 6)
    page.close()
    assert np.flatnonzero(maintext.content_lines(page.lines)).tolist() == [6, 7, 8, 9]


def test_main_text_odd_pages(spark):
    rows = [(1, None, None, 1), (2, "u", "", 2), (3, "u", "plain  text & more", 3), (3, "u", "plain  text & more", 3), (None, "u", "<p>a<p>b<![x[ y ]]>c<!-- never ends", 4), (5, "u", "<nav>menu</nav>", 5), (6, "u", "<div>" * 3000 + "deep" + "<a " * 30000, 6), (7, "u", "<p>" + "wort " * 200_000, 7)]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert [(r["page_id"], r["text"]) for r in got.collect()][:6] == [(1, ""), (2, ""), (3, "plain text & more"), (3, "plain text & more"), (None, "a\nbc"), (5, "")]
    assert {r["page_id"]: r["n_chars"] for r in got.collect()}[6] == 4 and got.filter("page_id = 7").first()["n_chars"] == 999_999
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- lexical search ---


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best_by_scoring(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    many, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked, out = {}, []
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    for item, own in asked.items():
        scores = []
        for i, c, n in counted:
            m = 10 + 90 * n * many // length
            if s := sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t]):
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def db(sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_lexical_search_of_all_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows_of(QUERIES["op12_lexical"](spark, SF))
    assert got == best_by_scoring(docs, items) == sorted(db().execute(ORACLES["op12_lexical"]).fetchall(), key=str)


DOCS = [
    (1, None), (2, ""), (3, "..."), (4, "Größe größe GRÖSSE 中文"), (5, "a b c"), (5, "a b c"), (6, "A B C"), (None, "a b c"), (7, "c " * 70_000 + "rare"), (8, "x" * 100_000 + " rare"),
    *[(100 + k, " ".join(f"w{j % 53}" for j in range(k * 7, k * 11))) for k in range(60)],
]


def test_lexical_search_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_TERMS", 5)
    items = [(1, "a"), (2, "rare größe w1 w2"), (2, "W3"), (3, None), (4, "unknown"), (None, "a"), (5, "c"), (6, "w5 w6 w7 w8"), (-7, "w10 w11")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, term string, rank int").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = lexical.index(frame)
    assert rows_of(lexical.search(found, asked)) == best_by_scoring(DOCS, items)
    assert lexical.search(found, asked.limit(0)).collect() == [] and lexical.search(lexical.index(frame.limit(0)), asked).collect() == []


def test_bounds_hold_and_most_documents_are_excluded():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(20, 400)) % 5000) for _ in range(3000)]
    counted = [Counter(t.split()) for t in texts]
    known, block = lexical.Hashes(), lexical.Block(9)
    for i, c in enumerate(counted[: block.room]):
        counts = np.array(list(c.values()))
        block.add(i, sum(c.values()), Counter({t.encode(): n for t, n in c.items()}), lexical.keys_of(np.array([known[t.encode()] for t in c], np.uint64), counts), counts)
    row, n = block.row(), len(block.ids)
    length = sum(block.lengths)
    pairs = [(item, f"t{int(t)}".encode(), int(rng.integers(1, 6000))) for item in range(20) for t in {*rng.integers(0, 400, 8)}]
    query = lexical.Query(pairs, n, length, 10)
    bounds = query.bounds(*query.marks(row), 0, 20)
    for item in range(20):
        for j in range(n):
            m = 10 + 90 * block.lengths[j] * n // length
            score = sum(w * lexical.gain(counted[j][t.decode()], m) for i, t, w in pairs if i == item and counted[j][t.decode()])
            assert bounds[item, j] >= score
    ranking = lexical.Ranking(query)
    ranking.add(row)
    print("bounded", ranking.bounded, "scored", ranking.scored)
    assert ranking.scored < 0.35 * ranking.bounded


# --- manifest ---


def fields(row):
    texts = [None if v is None else str(v) for v in row]
    return hashlib.sha256("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts).encode()).hexdigest()


def climb(nodes):
    """Root of nodes, and each one's siblings left and right, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = a // 8 * 8
            paths[k].append((nodes[run:a], nodes[a + 1 : run + 8]))
        nodes = [hashlib.sha256("".join(nodes[k : k + 8]).encode()).hexdigest() for k in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], paths


def manifest_by_hand(rows):
    """Rows ``doc_id, source, lang, n_chars, text``."""
    lower = lambda s: s and "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, fields(r)))
    trees = {lang: climb([fields(r) for r in groups[lang]]) for lang in langs}
    root, tops = climb([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        subroot, paths = trees[lang]
        for r, path in zip(groups[lang], paths):
            way = path + top
            proof = hashlib.sha256("".join("".join(a) + "".join(b) for a, b in way).encode()).hexdigest()
            at = fields((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else fields(r)
            for a, b in way:
                at = hashlib.sha256("".join([*a, at, *b]).encode()).hexdigest()
            out.append((r[0], fields(r), subroot, root, proof, at, at == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_of_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(QUERIES["op13_manifest"](spark, SF).select(*COLUMNS)) == manifest_by_hand(rows) == sorted(db().execute(ORACLES["op13_manifest"]).fetchall(), key=str)


@pytest.mark.parametrize(("count", "levels"), [(1, 1), (2, 1), (9, 1), (70, 1), (300, 2)])
def test_manifest_of_any_number_of_rows_and_tiers(spark, tmp_path, monkeypatch, count, levels):
    monkeypatch.setattr(manifest.with_tampered, "__defaults__", (levels,))
    rows = [(k if k % 9 else None, "s", [None, "", "de", "ü", "z"][min(4, k % 11)], k, ["Text", None, "", "ß A"][k % 4], "p", 1) for k in range(count)]
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, path string, key int").repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(QUERIES["op13_manifest"](spark, str(tmp_path)).select(*COLUMNS))
    want = manifest_by_hand([r[:5] for r in rows])
    # the order of rows that are wholly the same is free
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want] and sorted(r[4] for r in got) == sorted(r[4] for r in want)


def test_manifest_finds_changed_rows(spark):
    rows = [(k, "s", "en", 1, f"text {k}") for k in range(40)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema)
    entries = manifest.manifest(docs)
    root = entries.first()["root"]
    now = docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "s", "en", 1, "new")], schema))
    assert {r["doc_id"] for r in manifest.verify(entries, now, root).collect() if not r["verified"]} == {7, 99}
    assert manifest.manifest(docs.limit(0)).collect() == []


def test_appender_extends_witnesses_as_subtrees_close():
    tree = manifest.Appender(2)
    for k in range(9):
        tree.append(str(k))
    assert [len(w) for w in tree.witness] == [1] * 8 + [0] and tree.witness[2][0] == ("01", "34567")
    tree.finish()
    assert [len(w) for w in tree.witness] == [2] * 9 and tree.witness[8] == [("", ""), (manifest.digest("01234567"), "")]
