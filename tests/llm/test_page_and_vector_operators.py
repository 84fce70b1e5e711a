"""Pages, archives, vectors and the pipeline against plain versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from samplewright.llm import ann, html, warc
from samplewright.llm.common import ORACLES, QUERIES
from samplewright.llm.queries import tokenizer_path
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    assert difference(connect(SF_DIR), QUERIES[name](spark, SF_DIR), ORACLES[name]) is None


# ---- op6


def plain_article(page):
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>|<br>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op6_main_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text)


OTHER = """<html><body><header><h1>Site</h1></header><div class=menu><a href=/>Home</a></div><div id="page"><div class="story">
<h2>Title {n}</h2><p>First {n} &amp; more<br>on a line<p>Second   {n} <a href=x>link</a> text that goes on for a while {n}{n}{n}
<div class="share-buttons">Share this</div><form><p>Your mail</p><input></form><ul><li>one {n}<li>two {n}</ul></div>
<aside>About</aside><div class="comments"><p>Reader {n} says something long that is no article {n} {n} {n}</p></div></div>
<div class="cookie-notice">We use cookies</div><script>if (a < b) {{ x("</p>") }}</script><footer>&copy; {n}</footer></body>"""


def test_main_text_of_another_template():
    pages = [OTHER.format(n=n) for n in (1, 22, 333)]
    roots = [html.parse(p) for p in pages]
    wrapper = html.infer([html.json.dumps(html.skeleton(r)) for r in roots])
    text: dict[str, list] = {}
    for root in roots:
        for path, chars, links, code in html.masses(root):
            entry = text.setdefault(path, [0, 0, set()])
            entry[0], entry[1] = entry[0] + chars, entry[1] + links
            entry[2].add(code)
    place = html.region(wrapper, [(p, c, n, len(h) > 1) for p, (c, n, h) in text.items()])
    assert place == "/html/body/div.page/div.story"
    assert html.read_out(roots[1], place) == "Title 22\nFirst 22 & more on a line\nSecond 22 link text that goes on for a while 222222\none 22\ntwo 22"


def test_wrappers_find_repeats_and_options():
    def items(page):
        return html.skeleton(html.parse(page))

    assert items("<ul><li>a<li>b<li>c</ul>") == [["ul", False, False, [["li", True, False, [["#", False, False, []]]]]]]
    assert items("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>")[0][:2] == ["*", True]
    left, right = items("<div><h1>t</h1><p>a</p></div>"), items("<div><p>a</p><p>b</p><hr><table></table></div>")
    assert [i[:3] for i in html.align(left, right)[0][3]] == [["h1", False, True], ["p", True, False], ["table", False, True]]
    assert html.align(left, left) == left


def test_main_text_of_odd_rows(spark):
    texts = [None, "", "   ", "plain text", "a < b & c &amp; d", "<p>open <b>bold", "<article></article>", "<" * 3000, "<div>" * 3000 + "deep", "<p>" + "long " * 30_000, "</p></div>x"]
    rows = [(i, None if i % 2 else f"http://h{i % 3}.example/p", t, i) for i, t in enumerate(texts)] + [(None, "http://h0.example", "<p>no id</p>", 1), (3, "http://h0.example", "plain text", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    out = [(r.page_id, r.text) for r in html.main_text(pages).collect()]
    assert len(out) == len(rows)
    found = dict(out[::-1])
    assert found[0] == found[1] == found[2] == found[6] == "" and found[3] == "plain text" and found[4] == "a < b & c & d"
    assert found[5] == "open bold" and found[8] == "deep" and len(found[9]) == 5 * 30_000 - 1 and found[10] == "x" and found[None] == "no id"
    assert html.main_text(pages.limit(0)).count() == 0


def test_wrappers_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP", 4)
    rows = [(i, "http://h.example/x", "<body>" + "".join(f"<div class=c{chr(97 + (i >> k) % 2)}{chr(97 + k)}>t</div>" for k in range(5)) + f"<article>text {i}</article>") for i in range(32)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    (row,) = html.wrappers(pages).collect()
    assert row.region == "/body/article" and len(set(re.findall(r"div\.c..", row.wrapper))) == 10


def test_wrappers_of_random_classes_stay_small():
    pages = ["<body>" + "".join(f"<div class='x{chr(97 + i % 26)}{chr(97 + k)}{chr(97 + (i * k) % 26)}'>t</div>" for k in range(26)) + "</body>" for i in range(40)]
    wrapper = html.json.loads(html.infer([html.json.dumps(html.skeleton(html.parse(p))) for p in pages]))
    assert len(wrapper[0][3]) <= html.WIDEST


@pytest.mark.parametrize("count", (40, 300, 700))
@pytest.mark.parametrize("label", ("class='post category-{x}'", "id='{x}'"))
def test_main_text_beside_a_block_where_each_article_has_its_own_class(spark, count, label):
    def page(i):
        x = "".join(chr(97 + i // 26 ** k % 26) for k in range(3))
        return (f"<html><body><div class=block>Unlabelled words of page {i} that are no article and run on and on, as blocks do</div>"
                f"<article {label.format(x=x)}><h1>Title {i}</h1><div class='w-1/2'><p>Text {i} of it.</p></div></article></body></html>")

    pages = spark.createDataFrame([(i, "http://h.example/x", page(i)) for i in range(count)], "page_id long, url string, html string")
    assert {r.text for r in html.main_text(pages).collect()} == {f"Title {i}\nText {i} of it." for i in range(count)}


def test_main_text_in_elements_named_like_boilerplate(spark):
    story = "<h1>Title {i}</h1><p>Text {i} of the page, which is all of it and long enough.</p>"
    around = "<div class=menu>Home</div>{}<div class=sidebar>Other words {{i}}</div><div id=comments>Reader {{i}} says so</div>"
    article, cards = f"<article>{story}</article>", "<article class=card><h2>Card</h2></article>" * 3
    templates = [
        "<html><body class='single has-sidebar comments-open'>" + around.format(article),
        "<html class='no-comments'><body id='no-comments'>" + around.format(f"<main class=with-sidebar>{story}</main>"),
        "<body>" + around.format(f"<div class='content-sidebar-wrap'>{article}<div class=sidebar>More</div></div>"),
        "<body>" + around.format(f"<div class='content-sidebar-wrap'><main>{story}</main></div>") + f"<div class=related>{cards}</div>",
        "<body>" + around.format(f"<div class='content-sidebar-wrap'><div class=entry>{story}</div></div>"),
        "<body>" + around.format(f"<article class='post category-social'>{story}</article>") + f"<div class=related>{cards}</div>",
        "<body>" + around.format(f"<div class=no-sidebar>{article}<div class=related>{cards}</div></div>"),
        # an article's comments stay out, also where they are longer, and articles themselves
        "<body>" + around.format(article) + "<div class=comments>" + "<article class=comment>A reader's view {i}, longer than it should be</article>" * 5 + "</div>",
        "<body>" + around.format(f"<article>{story}<section class=comments><article class=comment>I agree {{i}}</article></section></article>"),
        "<body>" + around.format(article) + "<div class=comments>" + "Nobody asked for that much {i} " * 30 + "</div>",
    ]
    rows = [(t * 100 + i, f"http://h{t}.example/x", template.replace("{i}", f"{i}")) for t, template in enumerate(templates) for i in range(6)]
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Title {k % 100}\nText {k % 100} of the page, which is all of it and long enough." for k, *_ in rows}


def one_host(spark, template, count=6):
    """Texts of pages made from a template, by number."""
    rows = [(i, "http://h.example/x", template.replace("{i}", str(i))) for i in range(count)]
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_main_text_beside_cards_that_are_articles(spark):
    story = "<h1>Title {i}</h1><p>The text {i} of this page, longer than any card beside it.</p><p>It goes on {i} for another block.</p>"
    cards = "<div class=cards>" + "<article><h2>Other story {i}</h2></article>" * 2 + "</div>"
    want = "Title {i}\nThe text {i} of this page, longer than any card beside it.\nIt goes on {i} for another block."
    found = one_host(spark, f"<html><body><main>{story}{cards}</main></body></html>")
    assert all(found[i].startswith(want.replace("{i}", str(i))) for i in found)
    found = one_host(spark, f"<html><body><main>{story}</main>{cards}</body></html>")
    assert all(found[i] == want.replace("{i}", str(i)) for i in found)
    found = one_host(spark, f"<html><body><main><p>Lead</p><article>{story}</article></main></body></html>")
    assert all(found[i] == want.replace("{i}", str(i)) for i in found)


@pytest.mark.parametrize("markup, text", [
    ('<p class="a"">Hello first block</p><p>Second</p>', "Hello first block\nSecond"),
    ("<p data-x=it's>Hello first</p><p>Second it's</p><p>Third</p>", "Hello first\nSecond it's\nThird"),
    ('<p title="a > b">One</p><p x=a="b>c">Two</p>', 'One\nc">Two'),
    ("<p title = 'a > \"b'>One</p><p\n\tid\n=\nx>Two</p>", "One\nTwo"),
    ('<p title="never closed>One</p><p>Two</p>', "One\nTwo"),
    ("<p class=notice-period>Three months</p><p class='share-price up'>12</p><p id=reply-rate>9</p><section class=social-history>Then</section>", "Three months\n12\n9\nThen"),
    ("<p>One</p><div class=notice>Out</div><div class='box cookie-banner'>Out</div><div id=sidebar-left>Out</div><ul class=relatedPosts><li>Out</ul><p>Two</p>", "One\nTwo"),
])
def test_main_text_of_odd_tags_and_class_words(spark, markup, text):
    assert one_host(spark, f"<html><body><article>{markup}</article></body></html>", 3) == {i: text for i in range(3)}


def test_main_text_at_any_depth(spark):
    for depth in (150, 3000):
        deep = "<div>" * depth + "<p>one {i}</p><p>two</p>" + "</div>tail" * 3 + "</div>" * (depth - 3)
        assert one_host(spark, f"<html><body><article>{deep}</article></body></html>", 3) == {i: f"one {i}\ntwo\ntail\ntail\ntail" for i in range(3)}
        nav = "<div>" * depth + "<div class=sidebar>" + "<div>" * depth + "out</div>" + "</div>" * depth + "in {i}"
        assert one_host(spark, f"<html><body><article>{nav}</article></body></html>", 3) == {i: f"in {i}" for i in range(3)}


def test_tags_are_read_in_linear_time():
    begin = time.perf_counter()
    for piece in ("= ", "a='", '="', "x=y ", "='\"", "\t=\n"):
        html.parse("<p " + piece * 60_000)
    html.parse("<div>" * 30_000 + "<li>" * 30_000 + "</ul>" * 30_000 + "<b>x" * 30_000 + "</div>" * 30_000)
    assert time.perf_counter() - begin < 20


def test_text_is_gathered_by_the_wrappers_paths(spark, monkeypatch):
    lengths = spark.sparkContext.accumulator(0)
    plain, written = html.region, html.written
    monkeypatch.setattr(html, "region", lambda w, text: (lengths.add(len(text)), plain(w, text))[1])
    kept = {}
    monkeypatch.setattr(html, "written", lambda df, name: kept.setdefault(name, written(df, name)) if name in ("outlines", "merged") else written(df, name))
    rows = []
    for i in range(1500):
        x = "".join(chr(97 + i // 26 ** k % 26) for k in range(3))
        rows.append((i, f"http://{'one' if i % 3 else 'two'}.example/x", f"<body><div id={x}><section class=s{x}><p>Text {i}</p></section><i>{i}</i></div><p id=end>Same</p></body>"))
    pages = spark.createDataFrame([*rows, (-1, "http://small.example", "<body><div id=a><p>Text</p></div></body>")], "page_id long, url string, html string")
    assert {r.host: r.region for r in html.wrappers(pages).collect()}["small.example"] == "/body/div.a"
    assert lengths.value <= 2 * 4 + 1
    sums = {(r.host, r.path): (r.chars, r.varies) for r in html.path_sums(kept["outlines"], kept["merged"]).collect()}
    assert set(sums) == {(f"{h}.example", f"/body/{p}") for h in ("one", "two") for p in ("div.*", "div.*/section.*/p", "p.*")} | {("small.example", "/body/div.a/p")}
    assert sums["one.example", "/body/div.*/section.*/p"] == (sum(len(f"Text {i}") for i in range(1500) if i % 3), True)
    assert sums["two.example", "/body/p.*"] == (500 * 4, False)
    for path in ("", "/body", "/body/div.a.b/section@x/p.c"):
        for narrow in ({""}, {"/body"}, {"/body", "/body/div.*"}):
            assert html.narrow_path(html.narrow_path(path, narrow), narrow) == html.narrow_path(path, narrow)


def test_wrappers_keep_a_narrow_level_narrow():
    one, other = ([html.json.dumps(html.skeleton(html.parse(f"<body><p class={c}{chr(97 + i % 26)}{chr(97 + i // 26)}><b>t</b></p></body>"))) for i in range(n)]
                  for c, n in (("x", 300), ("y", 150)))
    wide, thin = html.infer(one), html.infer(other)
    for wrapper in (html.infer([wide, thin]), html.infer([thin, wide]), html.infer(one + other)):
        assert [p for p, _ in html.levels(html.json.loads(wrapper))] == ["", "/body", "/body/p.*"]


# ---- op7


def test_archives_hold_whole_records(spark, tmp_path):
    payloads = [None, "", "<p>same</p>", "<p>same</p>", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "<p>same</p>", "", "x" * 200_000, "line\nline"]
    rows = [(i, f"http://h/ {i}" if i % 2 else None, p, "x") for i, p in enumerate(payloads)] + [(None, "http://none", "<p>same</p>", "x"), (5, "http://again", "<p>same</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, file_bytes=1000)
    out = warc.read_archives(spark, path).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next((p or "" for i, _, p, _ in rows if i == r.page_id), "")
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert r.html == (text if r.record_type == "response" else None)
    assert sorted((r.page_id, r.refers_to) for r in out if r.record_type == "revisit") == [(0, 6), (1, 6), (2, 5), (3, 5)]
    assert sum(r.page_id == 5 and r.record_type == "response" for r in out) == 2
    parts = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*.gz")]
    assert len(parts) > 1 and all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts if p)
    large = {r.page_id: r.record_type for r in warc.archived(pages, least_bytes=5).collect()}
    assert large[0] == large[1] == "response" and large[2] == "revisit"
    assert warc.archived(pages.limit(0)).count() == 0


def test_damaged_archives_raise(tmp_path):
    with pytest.raises(ValueError):
        list(warc._records(b"WARC/1.1\r\nWARC-Record-ID: x\r\nContent-Length: 10\r\n\r\nshort\r\n\r\n"))


# ---- op10


def plain_nearest(rows, k):
    """Every query against all rows, the sums taken component by component."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            scored = []
            for j, v in good:
                if j != i:
                    total = 0.0
                    for a, b in zip(v, q):
                        total += a * b
                    scored.append((-total, j))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_nearest_recall_and_scores(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    wanted = plain_nearest(rows, 20)
    got = [tuple(r) for r in QUERIES["op10_nearest"](spark, "/root/testdata/sf0.1").collect()]
    assert len(got) == len(wanted)
    scores = {(q, v): s for q, _, v, s in plain_nearest(rows, len(rows))}
    assert all(scores[q, v] == s for q, _, v, s in got)
    found = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in wanted}
    assert len(found) / len(wanted) >= 0.95


def test_nearest_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    grid = [(i, [float(x) for x in rng.integers(-1, 2, 4)], 1) for i in range(100)]
    odd = [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf"), 0.0, 0.0, 0.0], 1), (204, [0.0] * 4, 1),
           (None, [1.0, 1.0, 1.0, 1.0], 1), (205, [1.0, 1.0], 1), (40, grid[40][1], 1)]
    vectors = spark.createDataFrame(grid + odd, "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0, block=8, queries_block=2).collect())
    # all lists are probed on so few rows, so the result is exact; the repeated row counts twice as a candidate
    wanted = plain_nearest([(i, v) for i, v, _ in grid + odd if v is None or len(v) == 4], 20)
    assert got == sorted(set(wanted))
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 1, 0.5)]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_are_copied_in_proportion(spark, monkeypatch):
    """Twice the vectors and queries: about twice the rows meet, since strips are counted for each list."""
    copied = []
    dealt = ann.dealt
    monkeypatch.setattr(ann, "dealt", lambda *a: copied.append(dealt(*a)) or copied[-1])
    monkeypatch.setattr(ann, "MOST_LISTS", 64)
    random = np.random.default_rng(1)
    centres = random.standard_normal((40, 16)) * 5
    rows = spark.createDataFrame([(i, (centres[i * 7919 % 40] + random.standard_normal(16)).tolist()) for i in range(8000)], "vec_id long, embedding array<double>")
    copies = []
    for n in (2000, 4000, 8000):
        ann.nearest(rows.where(F.col("vec_id") < n), F.col("vec_id") % 20 == 0, k=5, queries_block=60)
        copies.append(copied[-1][0].count() / n)
    # strips of all queries would be 2, 4 and 7 copies of every vector
    assert copies[1] < 1.5 * copies[0] and copies[2] < 2 * copies[0]


def test_nearest_goes_on_until_there_are_enough(spark, monkeypatch):
    plain = ann.fit

    def one_probe(*args):
        index = plain(*args)
        index.probes = 1
        return index

    monkeypatch.setattr(ann, "fit", one_probe)
    rng = np.random.default_rng(8)
    # small groups far apart, one list or two each, none of which has k others
    rows = [(i, [float(x) for x in rng.standard_normal(8) + 40 * np.eye(8)[i % 8]]) for i in range(1024)]
    rows += [(0, [float(x) for x in rng.standard_normal(8) + 40 * np.eye(8)[0]])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, each in ((20, 20), (300, 300), (2000, None)):
        got: dict = {}
        for r in ann.nearest(vectors, F.col("vec_id") % 100 == 0, k=k).collect():
            got[r.query_id] = got.get(r.query_id, 0) + 1
        # id 0 is asked with two vectors
        assert got == {i * 100: 2 * (each or 1023) if i == 0 else each or 1024 for i in range(11)}


def test_scan_abandons_and_keeps_near_all():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((5000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    ids = np.arange(5000)
    exact = ann.scan(vectors, ids, vectors[:50], ids[:50], rotation, 20, deviations=1e9)
    fast = ann.scan(vectors, ids, vectors[:50], ids[:50], rotation, 20)
    assert len(exact[0]) == len(fast[0]) == 1000
    assert len(set(zip(*exact[:2])) & set(zip(*fast[:2]))) >= 980


# ---- pipeline


def test_pipeline_against_plain_stages(spark):
    """Each stage on its own input, by the plain versions of the operators' tests."""
    from tokenizers import Tokenizer

    from samplewright.llm import decontam
    from tests.llm.test_text_operators import plain_base, plain_components, plain_form, plain_sets

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    for name, stage in stages.items():
        out = stage(spark, docs, "/root/testdata/sf0.01")
        seen[name] = [r.asDict() for r in out.collect()]
        if name != "bpe":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert sum(i in kept for i, t in toxic.items() if t) <= 0.2 * sum(toxic.values())
    assert sum(i in kept for i, t in toxic.items() if not t) >= 0.98 * sum(not t for t in toxic.values())
    groups = plain_components(plain_sets([(r["doc_id"], r["text"]) for r in seen["toxicity"]]))
    assert {r["doc_id"] for r in seen["near_duplicates"]} == {i for i, c in groups.items() if i == c}
    items = [plain_form(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in seen["near_duplicates"] if not any(i in plain_form(r["text"]) for i in items)}
    left = {r["doc_id"] for r in seen["decontamination"]}
    assert left <= clean and len(clean - left) <= 2
    assert decontam.EDIT_RATE == 0.05
    assert len(seen["secrets"]) == len(left) and not any(plain_base(r["text"]) for r in seen["secrets"])
    library = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in seen["secrets"]}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in seen["bpe"])
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()}
    assert whole == {r["doc_id"]: r["ids_sha256"] for r in seen["bpe"]}
