"""Vector and page operators against brute force, and the pipeline."""

import math

import numpy as np
from pyspark.sql import functions as F

from corvid.llm import ann, components, html_extract, vector_dedup
from corvid.storage import ship

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=260, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    x = centres[rng.integers(0, 20, n)] + rng.normal(0, 0.09, (n, d))
    x[50:90] = x[50]
    x[90:95] = x[50] * 3
    return [(int(i), [float(v) for v in r], int(rng.integers(0, 3)) if not 50 <= i < 95 else 1) for i, r in enumerate(x)]


ODD = [
    (900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] + [1.0] * 11, 1), (903, [float("inf")] + [1.0] * 11, 1), (904, [None] + [1.0] * 11, 1), (905, [1.0] * 12, None),
    (906, [1.0, 2.0], 1), (950, [1.0, 2.1], 1), (None, [1.0] * 12, 1), (907, [], 1),
]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_vector_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", 40)
    monkeypatch.setattr(vector_dedup, "BLOCK", 32)
    ship(spark)
    rows = vectors() + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(1), "weight": F.lit("x")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(np.float32(v), float), lab) for i, v, lab in rows if i is not None and lab is not None and fine(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[:a]:
            if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                f, g = find(i), find(j)
                root[max(f, g)] = min(f, g)
    assert got == {i: (links[i], find(i) if i is not None else None, True if i is None else find(i) == i) for i, _, _ in rows}
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_ann_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 100)
    monkeypatch.setattr(ann, "QUERIES", 3)
    ship(spark)
    rows = vectors(4, 400) + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit(1), "rank": F.lit("x")})
    got = ann.search(df, keep=60).collect()
    ok = {i: np.array(np.float32(v), float) for i, v, _ in rows if i is not None and fine(v)}
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in ok if i % 50 == 0}
    hit = total = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        cos = {i: ok[q] @ y / (np.linalg.norm(ok[q]) * np.linalg.norm(y)) for i, y in ok.items() if i != q and len(y) == len(ok[q])}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert [r.rank for r in found] == list(range(1, len(want) + 1))
        assert all(abs(r.score - cos[r.vec_id]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit, total = hit + len({r.vec_id for r in found} & set(want)), total + len(want)
    assert hit / total >= 0.95
    assert ann.search(df.limit(0)).count() == 0


def test_ann_finds_all_in_a_group_of_near_copies(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=16) + rng.normal(0, 1e-3, (10_000, 16)), rng.normal(size=(2000, 16))])
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u, by = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for r in ann.search(df, every=500).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(by[q] & set(np.argsort(-np.where(np.arange(len(x)) == q, -2, u @ u[q]))[:5].tolist())) for q in range(0, len(x), 500))
    assert hit / (5 * len(by)) >= 0.99 and len(by) == 24


def test_ann_every_length_is_searched(spark):
    ship(spark)
    df = spark.createDataFrame([(i, [1.0 + i % 2] + [1.0] * (i // 2), 0) for i in range(140)], "vec_id long, embedding array<double>, label int")
    assert {r.query_id for r in ann.search(df, every=2).collect()} == set(range(0, 140, 2))


def test_components(spark):
    rng = np.random.default_rng(2)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        f, g = find(a), find(b)
        root[max(f, g)] = min(f, g)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    want = {x: find(x) for x in list(root)}
    linked = {x for a, b in e if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def test_ann_ties_at_the_last_place_and_ids_that_stand_for_two(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ann, "ROWS", 7)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 4)).round(1)
    flips = np.array([[1, -1, 1, 1], [1, 1, -1, 1], [1, 1, 1, -1], [1, -1, -1, 1]])
    rows = [(0, [2.0, 0.0, 0.0, 0.0])] + [(1 + 4 * i + j, (x * f).tolist()) for i, x in enumerate(base) for j, f in enumerate(flips)]  # all mirror images are as near to row 0
    rows += [(100, [0.0, 1.0, 0.0, 0.0]), (100, [0.0, 0.0, 1.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    twice = [sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, every=50, k=6).collect()) for _ in range(2)]
    assert twice[0] == twice[1]
    q = np.array(rows[0][1])
    cos = {}
    for i, v in rows[1:]:
        cos[i] = max(cos.get(i, -2), float(np.dot(q, v) / (np.sqrt(np.dot(q, q)) * np.sqrt(np.dot(v, v)))))
    want = sorted(cos, key=lambda i: (-cos[i], i))[:6]
    assert [v for query, _, v, _ in twice[0] if query == 0] == want
    assert {query for query, *_ in twice[0]} == {0, 100} and all(v != query for query, _, v, _ in twice[0])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="site-notice-page"><header><h1>Site</h1></header><nav><a>{0}</a></nav>
<div class="wrap"><div class="ad">buy {0}</div><article><header><h1>Head {0}</h1></header><p>First {0} &amp; <b>bold<br>next<p>Second\n part &lt;x&gt;<div class="byline">By staff</div>
<ul><li>one<li>two</ul><section class="comments"><p>rude</p></section><form>Mail</form></article><aside>links</aside></div><footer>(c) {0}</footer><script>var a="</p>";</script></body></html>"""


def test_html_extraction(spark):
    ship(spark)
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"n{i}")) for i in range(8)] + [
        (20, None, None), (21, "http://x", ""), (22, "nope", "just text"), (23, "http://lone.example/", "<body><main><p>Only &eacute;<p>two</main><footer>f"), (0, "http://h.example/0", PAGE.format("n0")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit("x"), "text": F.lit("clash")})
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).count() == len(rows)
    assert got[3].text == "Head n3\n\nFirst n3 & bold next\n\nSecond part <x>\n\none\n\ntwo"
    assert got[20].text == "" and got[21].text == "" and got[22].text == "just text" and got[23].text == "Only é\n\ntwo"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_wrapper_finds_region_and_template():
    w = html_extract.induce([PAGE.format(f"n{i}") for i in range(5)])
    assert w["region"].endswith("article\x01") and any(p.endswith("div.byline\x01") for p in w["template"])
    plain = "<body><div id=top>Menu of site</div><div id=main><p>{0} story</p><p>{0} more</p></div><div id=end>Same</div></body>"
    w = html_extract.induce([plain.format(c * 30) for c in "abcd"])
    assert w["region"].endswith("div.main\x01")
    assert html_extract.main_text(plain.format("new"), w) == "new story\n\nnew more"


def test_the_wrapper_changes_pages(spark):
    ship(spark)
    # nothing but div and p, no names: only the alignment tells the constant text and the region
    page = "<body><div><div>Welcome to the site</div><div><p>Story {0} begins.</p><p>Please read our terms.</p><p>More of {0} and its long end, which tells in so many words how all of it went on from there to the very last day.</p></div><div>All rights</div></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(f"tale{i}")) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story tale{i} begins.\n\nMore of tale{i} and its long end, which tells in so many words how all of it went on from there to the very last day." for i in range(12)}
    assert all(html_extract.main_text(h, None) != got[i] for i, _, h in rows)


def test_generated_sites_equal_what_was_put_in(spark):
    import random

    ship(spark)
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta rho sigma".split()) + str(rng.randrange(999)) for _ in range(n))
    rows, want = [], {}
    for site in range(6):
        box, menu, legal = rng.choice(["article", "div", "section class=story", "main"]), "".join(f"<li><a href=/{i}>{say(1)}</a>" for i in range(rng.randint(3, 30))), say(6)
        for i in range(rng.randint(5, 9)):
            parts = [say(rng.randint(8, 30)) for _ in range(rng.randint(2, 6))]
            body = "".join(f"<p>{x}{rng.choice(['</p>', ''])}" for x in parts)
            side = rng.choice([f"<div class='ad-slot'>{say(4)}</div>", f"<aside>{say(5)}</aside>", f"<div class=comments><p>{say(9)}</p></div>", ""])
            html = f"<html><head><title>{say(3)}</title></head><body><div id=top><ul>{menu}</ul></div><{box}><h1>{parts[0]}</h1>{body}{side}</{box.split()[0]}><div>{legal}</div><footer>{say(3)}</footer></body></html>"
            key = site * 100 + i
            rows.append((key, f"https://s{site}.example/{i}", html))
            want[key] = "\n\n".join([parts[0], *parts])
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_nothing_of_an_article_is_lost_to_names_or_quotes():
    text = lambda h: html_extract.main_text(h, None)
    article = "<article><h2 id='related-work'>Related work</h2><p>a</p><h2 id=\"menu-design\">Menu design</h2><div class='menu-design'>b</div><div class='related-posts'>x</div><div class=ad-300x250>x</div></article>"
    assert text(article) == "Related work\n\na\n\nMenu design\n\nb"
    assert text("<p>one <a title=don't>two</a> three</p><p>it's four</p>") == "one two three\n\nit's four"
    assert text("<datalist><option value=1><option value=2></datalist><p>two</p>") == "two"
    assert text("<p data-id='comments' title='class=ad'>kept</p><p class=ad>gone</p>") == "kept"
    assert text("a < b and <b>c</b> 3<4 <i") == "a < b and c 3<4 <i"
    assert text("<p>x<!-- <p>no --><![CDATA[no]]><?php no ?>y</p><script>var a='<p>no</p>'</script>z</ p>") == "xy\n\nz"


def test_no_text_is_lost_to_forms_inline_elements_or_names(spark):
    text = lambda h: html_extract.main_text(h, None)
    assert text("<form id=aspnetForm><nav>menu</nav><article><p>The <b>text</b></p></article><input name=x></form>") == "The text"
    assert text("<div>top</div><form><h1>Title</h1><p>Most of the page stands in its form.</p><button>Send</button></form>") == "top\n\nTitle\n\nMost of the page stands in its form."
    assert text("<p>Long enough to be the text of the page.</p><form>Mail <p>Subscribe</p></form><form>Name</form>") == "Long enough to be the text of the page."
    assert text("<form>User Password</form>") == ""
    assert text("<article><p>kept</p><form><p>This form inside an article is longer than the article's own text.</p></form></article><p>and so much more text around them that it isn't most</p>") == "kept"
    assert text("<p>E = <math><mi>m</mi><mi>c</mi></math> holds</p><p><svg><title>t</title><text>drawn</text></svg> and <object>shown</object></p>") == "E = mc holds\n\ndrawn and shown"
    assert text("<p>x<![CDATA[no > y]]>z</p>") == "x y]]>z"
    assert text("a<xmp>1 &lt; <b>2</b></xmp>b") == "a\n\n1 &lt; <b>2</b>\n\nb"
    assert text("<p>Hello <button>x</button> world</p><p>one<script>no</script>two</p>") == "Hello world\n\nonetwo"
    assert text("<article><p>by <a class='author social'>Jane</a> today</p><p class='notice-text'>n</p><p class='related text'>r</p><blockquote class='promoted page'>q</blockquote><p class=ad>gone</p><div class=ad>gone</div></article>") == "by Jane today\n\nn\n\nr\n\nq"
    assert text("<div>one <span class=ad>gone</span> two</div><p>three <span class=share>kept</span></p>") == "one two\n\nthree kept"
    ship(spark)
    pages = [(i, f"http://f.example/{i}", f"<body><form id=aspnetForm><div class=menu>Menu</div><article><h1>T{i}</h1><p>Story {i} {'w' * i}</p></article><div>Same end</div></form></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\n\nStory {i} {'w' * i}".rstrip() for i in range(8)}


def test_broken_and_deep_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    began = time.time()
    for bad in ('<a "', "<a x='", '<a x="', "<", "<p", "</", "<!--", "<a b=", "</span>", "<p>x"):
        html_extract.main_text(bad * (1_000_000 // len(bad)), None)
    assert time.time() - began < 60
    tracemalloc.start()
    assert html_extract.main_text("<div>" * 100_000 + "deep", None) == "deep"
    deep = "<div>t" * 10_000
    assert html_extract.main_text(deep, None).count("t") == 10_000
    assert html_extract.main_text(deep + "e", html_extract.induce([deep + c for c in "abcd"])) == "te"
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_pipeline_stages(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "some", "words", "here"]) + str(rng.randrange(50)) for _ in range(8))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts += [texts[3], texts[5] + " tail", "WIN!! $$$ | CASH!! " * 20, "WIN!! $$$ | CASH!! " * 30]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 82), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        if name == "line dedup":
            kept = {r.doc_id for r in now.collect()}
            assert (80 not in kept) == (texts[3].count("\n") >= 2) and kept >= set(range(80))
    from corvid.storage import held

    before = held(spark)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert held(spark) == before + 1  # what the stages were made from is gone
    assert out and all(r.round_trip and len(r.ids) == r.n_pieces for r in out)


def test_pipeline_stages_on_nulls_repeats_and_nothing(spark, tmp_path):
    import corpus_pipeline

    ship(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    same, near = "one two three four five six seven eight nine ten " * 3, "one two three four five six seven eight nine ten " * 3 + "more"
    rows = [(1, same), (1, same), (1, "another text under the same id as before it"), (2, near), (None, near), (None, "a text without an id that nothing is like"), (3, None), (4, ""), (4, " \n"), (5, "w " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", None if t is None else "s", len(t or "")) for i, t in rows], schema)
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted(
        [("1", same), ("1", rows[2][1]), ("None", rows[5][1]), ("3", ""), ("4", ""), ("4", " \n"), ("5", rows[9][1])]
    )
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert name == "piece encoding" or out.columns == docs.columns, name
        assert out.count() > 0, name


def brute_matching(a, b):
    """The most pairs (an equal text one more) that simple tree matching can make of two trees (label, text, kids)."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_matching(x, y))
    return 1 + (a[1] == b[1]) + best[-1][-1]


def test_matching_is_the_best_there_is(monkeypatch):
    import random

    rng = random.Random(3)

    def grown(depth):
        return (rng.randrange(3), rng.randrange(2), [grown(depth - 1) for _ in range(rng.randrange(4))] if depth else [])

    def flat(tree):
        parent, label, text = [], [], []

        def walk(node, above):
            at = len(parent)
            parent.append(above)
            label.append(node[0])
            text.append(node[1])
            for k in node[2]:
                walk(k, at)

        walk(tree, 0)
        return html_extract.Tree(parent, label, text)

    for _ in range(300):
        x, y = (0, 0, grown(3)[2]), (0, 0, grown(3)[2])
        a, b = flat(x), flat(y)
        to = html_extract.Matching(a, b).partners()
        pairs = [(t, i) for i, t in enumerate(to) if t >= 0]
        assert to[0] == 0 and len({t for t, _ in pairs}) == len(pairs)
        for t, i in pairs[1:]:  # parents are matched, order is kept, labels are equal
            assert to[b.parent[i]] == a.parent[t] and a.label[t] == b.label[i]
        assert [t for t, _ in pairs] == sorted(t for t, _ in pairs)
        if not any(a.shape[t] == b.shape[i] and a.kids[t] for t, i in pairs):  # equal shapes match as they are
            assert sum(1 + (a.text[t] == b.text[i]) for t, i in pairs) == brute_matching(x, y)
        again = html_extract.Tree.loads(a.dumps())
        assert again.shape == a.shape and again.full == a.full
    wide = [html_extract.Tree([0] * (n + 1), [9] + [rng.randrange(4) for _ in range(n)], [0] * (n + 1)) for n in (1500, 1400)]
    long = html_extract.Matching(*wide).partners()
    assert sum(t >= 0 for t in long) == 1 + int(html_extract.Matching(*wide)._last(wide[0].kids[0], wide[1].kids[0])[-1]) // 2


def test_a_passage_of_some_articles_is_no_template(spark):
    ship(spark)
    said = "Released under a license that several articles of this host quote at their end."
    page = "<body><div class=ad>x</div><article><h1>T{0}</h1>{1}<p>Its own long story {0} {0} {0}.</p>{2}</article></body>"
    rows = [(i, f"http://h.example/{i}", page.format(f"n{i}", f"<p>more {i}</p>" * (i % 4), f"<p>{said}</p>" if i % 3 == 0 else "")) for i in range(30)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == "\n\n".join([f"Tn{i}", *[f"more {i}"] * (i % 4), f"Its own long story n{i} n{i} n{i}.", *([said] if i % 3 == 0 else [])])


def test_region_keeps_title_and_lead():
    page = "<body><article><h1>Title {0}</h1><div class=lead>Lead {0}</div><div class=body><p>{1}</p></div></article></body>"
    w = html_extract.induce([page.format(c, c * 900) for c in "abcd"])
    assert w["region"].endswith("article\x01")
    assert html_extract.main_text(page.format("x", "long"), w) == "Title x\n\nLead x\n\nlong"


def test_template_is_a_repeated_text_on_any_layout(spark):
    ship(spark)
    page = '<body><div class="main"><h1>Head {0}</h1><div class="byline">{1}</div><p>Story {0}</p></div></body>'
    other = '<body><div class="left">Left {0}</div><div class="right"><section><p>Right {0}</p></section></div></body>'
    said = {i: f"By guest {i} <b>here</b>" if i % 10 == 3 else "By staff <b>here</b>" for i in range(40)}
    rows = [(i, f"http://h.example/{i}", page.format(i, said[i])) for i in said] + [(i, f"http://h.example/{i}", other.format(i)) for i in range(40, 44)]
    # a host where most pages are copies of one: its text is no template
    copied = '<body><div class="main"><div class="lead">Lead {0}</div><div class="body">Body {0}</div></div></body>'
    rows += [(100 + i, f"http://c.example/{i}", copied.format(max(0, i - 16))) for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert got[i] == (f"Head {i}\n\nBy guest {i} here\n\nStory {i}" if i % 10 == 3 else f"Head {i}\n\nStory {i}")
    assert all(got[i] == f"Left {i}\n\nRight {i}" for i in range(40, 44))
    assert all(got[100 + i] == f"Lead {max(0, i - 16)}\n\nBody {max(0, i - 16)}" for i in range(20))


def test_content_beyond_many_elements(spark):
    ship(spark)
    links = "".join(f"<p><a href=/{i}>Link {i}</a></p>" for i in range(500))
    page = f'<body><div class="links">{links}</div><div class="one"><p>First {{0}}</p></div><div class="two"><p>Second {{0}}</p></div></body>'
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"First {i}\n\nSecond {i}" for i in range(6)}
