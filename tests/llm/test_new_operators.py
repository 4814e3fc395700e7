"""Spelling variants, importance resampling and HTML extraction against plain versions, and their edge cases."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrework.llm import html_extraction as H
from acrework.llm import importance as I
from acrework.llm import spelling_variants as S
from acrework.llm import wrappers as W
from acrework.llm.html_tokens import Page
from acrework.llm.queries import op11_spelling_variants, op12_importance_resampling, op13_html_extraction
from tests.llm.test_operators import EDGE, frame

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans(S.UPPER, S.LOWER)


def plain_variants(counts: dict[str, int]) -> dict[str, tuple]:
    letters = sorted({c for w in counts for c in w})
    form, near_count = {}, {}
    for w, n in counts.items():
        near = {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        near = [x for x in near - {w} if x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w], near_count[w] = best if best is not None and counts[best] >= 2 * n else None, len(near)
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], near_count[w], counts[form[w]] if form[w] is not None else None)
    return out


def variant_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_of_documents(spark):
    counts = Counter()
    for doc_id, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert variant_rows(op11_spelling_variants(spark, SMALL)) == plain_variants(counts)


def test_variants_at_every_place_and_length(spark):
    rng = np.random.default_rng(4)
    words = {"ab", "b", "a", "aab", "aaab", "baaa", "é", "éa", "ÿ" * 9, "ÿ" * 10}
    for size in (1, 2, 3, 5, 8, 17, 40):
        for _ in range(6):
            w = "".join(rng.choice(list("abé"), size))
            at, c = int(rng.integers(0, size)), str(rng.choice(list("abéz")))
            words |= {w, w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :] + c, w + c, c + w}
    counts = {w: int(rng.integers(1, 40)) for w in sorted(words) if w}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert variant_rows(S.spelling_variants(df)) == plain_variants(counts)


def test_variants_of_very_long_words_and_edge_rows(spark):
    long = "".join(np.random.default_rng(5).choice(list("abcdefgh"), 200_000))
    counts = {long: 9, long[:150_000] + "zz" + long[150_001:]: 3, long[:70] + long[71:]: 4, long + "q": 2, "other": 1}
    found = variant_rows(S.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found[long][3] == 2 and found[long + "q"][0] == long and found["other"] == (None, "other", 1, 0, None)
    noisy = S.noisy_words(frame(spark, EDGE + [(11, "word " * 3, "en", "a")]))
    assert {"same", "éü", "x" * 30_000} & {r["word"] for r in noisy.distinct().collect()}
    assert S.noisy_words(frame(spark, [])).count() == 0
    assert S.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def plain_features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % I.BUCKETS for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(docs, target):
    raw, wanted, each = Counter(), Counter(), {}
    for doc_id, text in docs:
        each[doc_id] = plain_features(text)
        raw.update(each[doc_id][1])
    for text in target:
        wanted.update(plain_features(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[k] + 1) * (s + I.BUCKETS) / ((raw[k] + 1) * (t + I.BUCKETS)))) for k in range(I.BUCKETS)]
    out = {}
    for doc_id, (n, found) in each.items():
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out[doc_id] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    enough = sorted((d for d in out if out[d][4] >= 20), key=lambda d: (-out[d][2], d))
    for rank, d in enumerate(enough[: 5 * len(enough) // 100], 1):
        out[d][3] = rank
    return {d: tuple(v[:4]) for d, v in out.items()}


def test_draw_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in op12_importance_resampling(spark, SMALL).collect()}
    assert found == plain_draw(docs, target)


def test_features_of_odd_texts():
    texts = ["", "a", "A b\x00C\x7fd e1 2É漢 字", "é" * 5_000 + " end", ("long" * 90 + " ") * 3, "\n\n", "x y " * 500, "Zz" * 100 + " zz"]
    encoded = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    got = [[] for _ in texts]
    for text, bucket in I.features(np.frombuffer(b"".join(encoded), np.uint8), offsets):
        for t, b in zip(text.tolist(), bucket.tolist()):
            got[t].append(b)
    assert [sorted(g) for g in got] == [sorted(plain_features(t)[1]) for t in texts]
    crc = lambda *parts: np.asarray([zlib.crc32(p) for p in parts], np.uint32)
    parts = [b"", b"x", b"some bytes" * 1_000]
    lengths = np.asarray([len(p) for p in parts])
    assert (I.compose(crc(b"ab", b"", b"cd"), crc(*parts), lengths) == crc(*(a + b for a, b in zip((b"ab", b"", b"cd"), parts)))).all()


def test_draw_edge_rows(spark):
    docs = frame(spark, EDGE)
    gains = I.bucket_gains(I.bucket_counts(docs), I.bucket_counts(frame(spark, [])))
    rows = I.draw(I.weigh(docs, gains), percent=50).collect()
    assert len(rows) == len(EDGE) and {r["doc_id"]: r["weight"] for r in rows}[2] == 0
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(r["n_words"] >= 20 for r in rows) // 2
    assert I.draw(I.weigh(frame(spark, []), gains)).count() == 0


def expression(html):
    return W.dump(W.fold(Page(html).root.kids))


def shown(nested):
    mark = {0: "", 1: "?", 2: "+", 3: "*"}
    return " ".join(key + (f"[{shown(kids)}]" if kids and not key.startswith("(") else "") + mark[occ] for key, occ, kids in nested)


def test_folding_and_alignment():
    assert shown(expression("<ul><li>a<li>b<li>c</ul>")) == "ul[li[#]+]"
    assert shown(expression("<h2>a</h2><p>b<p>c<h2>d</h2><p>e")) == "(h2 p)+"
    assert shown(expression("<div class='b a'>x</div><div id=c>y</div>")) == "div.a.b[#] div.c[#]"
    merge = lambda *pages: shown(json.loads(H._merged([json.dumps(expression(p)) for p in pages])))
    assert merge("<h1>a</h1><p>b", "<h1>a</h1><div>x</div><p>b") == "h1[#] div[#]? p[#]"
    assert merge("<ul><li>a</ul>", "<ul><li>a<li>b</ul>") == "ul[li[#]+]"
    assert merge("<div><p>a</div>", "<div><p>a</p><ul><li>b</ul></div>", "<div><ul><li>b<li>c</ul></div>") == "div[p[#]? ul[li[#]+]?]"


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<p>a <b>b</b>c<br>d<p>e", ["a bc d", "e"]),
        ("<script>var t='</p><p>x';</script>y", ["y"]),
        ("<!-- a > b --><p title='a>b'>c</p>", ["c"]),
        ("<p>1 < 2 &amp;&lt; &am &nbsp; x", ["1 < 2 &< &am x"]),
        ("<div>a<div>b</div>c", ["a", "b", "c"]),
        ("<p class=\"open>a</p>b", ["a", "b"]),
        ("<!-- never closed <p>a", []),
        ("<script>never closed <p>a", []),
        ("text<", ["text<"]),
        ("</p></div>a</b>", ["a"]),
        ("<" * 50, ["<" * 50]),
    ],
)
def test_blocks(html, blocks):
    assert Page(html).blocks == blocks


def test_scan_grows_with_the_page():
    for piece in ("<a \"", "<!--", "<script>", "<p '", "<div>", "</p>", "<b>x", "<p>x", "<x"):
        page = Page(piece * 100_000)
        W.fold(page.root.kids)


def template(k, body, extra=""):
    return f"""<html><head><title>T{k}</title></head><body><div class="top">Site name</div><div class="menu"><a href="/a">Home</a> <a href="/b">About us</a></div>
    <div>{extra}<div>{body}</div><div><a href="/x">More {k}</a> <a href="/y">Others</a></div><div>All rights reserved</div></div>
    <div class="comments"><p>Great post number {k}, thank you very much for it</p></div></body></html>"""


def test_wrapper_without_article(spark):
    rows, expected = [], {}
    for k in range(12):
        paragraphs = [f"Paragraph {j} of page {k} says something that no other page says, &amp; more" for j in range(k % 4 + 1)]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((k, f"https://News.example.org/{k}", template(k, body, "<p><a href='/q'>Teaser</a></p>" if k % 3 == 0 else "")))
        expected[k] = " ".join(p.replace("&amp;", "&") for p in paragraphs)
    found = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == expected


LAYOUTS = {
    "classes": "<body><div class='topnav'><a href=/>Home</a> News</div><div class='wrap has-sidebar'><h1>Title {k}</h1><div class='post'>{body}</div><ol class='commentlist'><li>First of {k}! A long comment that says very much about all of this and more</ol></div><div id='siteFooter'>Text of {k} at the end</div>",
    "form": "<body><form action=/><div class=header><b>Site</b></div><div><h1>Title {k}</h1>{body}</div><div class=promo>Buy {k} now</div></form>",
    "table": "<body><table><tr><td class=menu><a href=/a>A</a><td><h1>Title {k}</h1>{body}<td class=ads>Ad {k}</table>",
    "main": "<body class=with-sidebar><main class='content sidebar-right'><div class='entry-header'><h1>Title {k}</h1></div>{body}<div class='share-buttons'>Share {k}</div></main><aside>Elsewhere {k}</aside>",
    "article": "<body><div class='page no-sidebar'><article class='post-{k}'><h1>Title {k}</h1>{body}<section class='comments'><p>Comment of {k}</p></section></article></div><noscript>Please enable {k}</noscript>",
    "plain": "<body><div><img src=x alt=y></div><div><h1>Title {k}</h1></div><div>{body}</div><div>All rights reserved</div>",
}


@pytest.mark.parametrize("n", [1, 6])
def test_layouts_of_hosts(spark, n):
    rows, expected = [], {}
    for i, (host, layout) in enumerate(LAYOUTS.items()):
        for k in range(n):
            paragraphs = [f"{host} paragraph {j} of page {k} has words of its own, {j * 7 + k} of them" for j in range(2 + k % 3)]
            rows.append((100 * i + k, f"http://{host}.example/{k}", layout.format(k=k, body="".join(f"<p>{p}</p>" for p in paragraphs))))
            expected[100 * i + k] = " ".join([f"Title {k}", *paragraphs]) + (" All rights reserved" if host == "plain" and n == 1 else "")
    found = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == expected


def test_article_parts_and_edge_pages(spark):
    article = """<body><header>Site</header><div class="cookie-notice">We use cookies</div><main><article><header><h1>Title</h1></header><p>One&nbsp;<i>two</i></p>
    <aside>See also</aside><form>Name <input></form><div class="share">Share</div><blockquote>Three</blockquote><ul><li>Four<li>Five</ul></article>
    <section id="comments"><article class="comment">Nice</article></section></main><footer>F</footer>"""
    rows = [(1, "http://a.example/", article), (2, "http://a.example/2", None), (3, None, ""), (4, None, "<p>only</p>"), (4, None, "<p>only</p>"), (None, "no address", "x" * 300_000), (5, "http://a.example/5", "<" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "text", "kept", "blocks", "leaf", "slot")})
    found = {}
    for r in H.extract_main_text(df).collect():
        found.setdefault(r["page_id"], []).append((r["url"], r["text"], r["n_chars"]))
    assert found[1] == [("http://a.example/", "Title One two Three Four Five", 29)]
    assert found[2] == [("http://a.example/2", "", 0)] and found[3] == [(None, "", 0)]
    assert found[4] == [(None, "only", 4)] * 2 and found[None][0][2] == 300_000 and len(found[5]) == 1
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_pages_of_all_hosts(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    expected = {r[0]: r[2:] for r in con.execute(H.OP13_SQL).fetchall()}
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in op13_html_extraction(spark, SMALL).collect()}
    assert found == expected


def test_many_expressions_of_one_host(spark):
    """More expressions than one round takes: all go into one wrapper, which covers each of them."""
    nested = [json.dumps(expression("".join(f"<{t}>x</{t}>" for k, t in enumerate(("h1", "p", "ul", "table", "pre", "h2", "dl", "h3", "h4")) if bits >> k & 1))) for bits in range(1, 400)]
    df = spark.createDataFrame([("h", str(k), n) for k, n in enumerate(nested)], "host string, expression string, nested string")
    (wrapper,) = H.infer_wrappers(df).collect()
    assert wrapper["host"] == "h"
    assert all(-1 not in H.slots_of(n, wrapper["wrapper"]) for n in nested[::7])


def test_neighbours_of_extreme_vectors_and_many_equal_queries(spark):
    from acrework.llm.neighbours import nearest_neighbours

    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 2e-201]), (3, [0.0, 5e-324]), (4, [-1.0, 0.0]), (5, [3.0, 1e-308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = [(r["rank"], r["vec_id"], r["score"]) for r in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    close = 1 / math.sqrt(1.01)
    assert [f[:2] for f in found] == [(1, 5), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert [f[2] for f in found] == pytest.approx([1, close, 1 / math.sqrt(1.04), 0, -1], abs=1e-15)
    hot = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    few = spark.createDataFrame([(200_000 + i, [1.0, float(i)]) for i in range(9)], "vec_id bigint, embedding array<double>")
    got = nearest_neighbours(hot.union(few), F.col("vec_id") >= 0)
    counted = got.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    assert counted.count() == 100_009 and counted.filter("n <> 5").isEmpty()
    ids = {r["query_id"]: r["ids"] for r in counted.filter("query_id in (0, 3, 99999)").collect()}
    assert ids == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 99999: [0, 1, 2, 3, 4]}


def test_secret_rules_take_linear_time():
    import time

    import pyarrow as pa

    from acrework.llm.secrets import RULES, Scanner

    part = "A" * 9
    texts = ["eyJ" * 200_000, f"eyJ{part}.eyJ{part}.{part}", f"xeyJ{part}.eyJ{part}", f"eyJ{part}.eyJ{part}.eyJ{part}.{part}", "eyJ" + "a." * 100_000, "gho_" * 100_000, "://a:" * 100_000, "-----BEGIN " + "A" * 300_000]
    began = time.perf_counter()
    found = [[(RULES[k].kind, a, b) for a, k, b in spans] for spans in Scanner(RULES).scan(pa.array(texts))]
    assert time.perf_counter() - began < 10
    assert found[1] == [("web_token", 0, len(texts[1]))] and found[3] == [("web_token", 0, 38)]
    assert not any(found[i] for i in (0, 2, 4, 5, 6, 7))


def test_no_table_of_the_tries_goes_through_the_driver(spark, capsys):
    """The words are small on disk beside their states and edges, which must not be gathered to broadcast (F1)."""
    df = spark.createDataFrame([(w, 5) for w in ("street", "streets", "stret", "avenue")], "word string, n long")
    S.spelling_variants(df).explain()
    S.near_words(df.withColumn("id", F.monotonically_increasing_id())).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_long_lists_of_siblings_are_aligned_like_short_ones(spark):
    """One moved sibling is one option, however many siblings there are."""
    for n in (20, 700):
        node = lambda k: W.Node(f"e{k}", [])
        pairs = W._partners([node(k) for k in range(n)], [node(k) for k in (n - 1, *range(n - 1))])
        assert sum(bool(left and right) for left, right in pairs) == n - 1 and len(pairs) == n + 1
