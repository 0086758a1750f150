"""HTML extraction, URL filter and embedding near-dedup."""

import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF01, rows_of
from veritext.llm import embed_dedup, html_extract, url_filter
from veritext.llm.queries import URL_RULES, op6_html_extract, op7_url_filter, op8_embed_dedup


def test_pages_equal_their_articles(spark):
    out = op6_html_extract(spark, SF01)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    for r in out.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*(>|$)", " ", p))).strip()
                 for p in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)]
        assert r.text == "\n".join(p for p in parts if p), r.page_id
        assert r.n_chars == len(r.text)


def test_block_rules():
    text = html_extract.main_text
    good = "The cat sat on the mat and it was happy with all that there is in the house. " * 3
    assert text(None) == text("") == text("<p>") == ""
    page = (f"<nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><div>{good}<p>Short one."
            f"<p>{good}</div><form>Name <input></form><aside>{good}</aside><div id=comments><p>{good}</div>"
            f"<footer>&copy; 2020</footer><script>if (a < b) 'x';</script><style>p{{}}</style>")
    assert text(page) == "\n".join([good.strip(), "Short one.", good.strip()])
    assert text("<article><h1><a href=x>Head</a></h1><p>a &amp; b &lt;c&gt;<br>d<ul><li>one<li>two</ul>"
                "<section class=comments><article><p>first!</article></section></article><p>out") == \
        "Head\na & b <c> d\none\ntwo"
    assert text("<main><p>kept <b>bold</p><p title='a>b'>and cut &am") == "kept bold\nand cut &am"


def test_articles_are_one_signal():
    text = html_extract.main_text
    good = "The cat sat on the mat and it was happy with all that there is in the house. " * 3
    teaser = "<article><h3><a href=x>A teaser</a></h3><p>Read on.</article>"
    # the text stands beside teaser cards
    assert text(f"<div><h1>Head</h1><p>{good}<p>Short one.<p>{good}</div>{teaser}{teaser}") == \
        "\n".join(["Head", good.strip(), "Short one.", good.strip()])
    assert text(f"<main><div>{good}</div>{teaser}{teaser}</main>") == good.strip()
    # several articles with text, text beside an article, link lists beside it
    assert text(f"<article><p>{good}<p>One.</article><article><p>Two.<p>{good}</article>") == \
        "\n".join([good.strip(), "One.", "Two.", good.strip()])
    assert text(f"<div>{good}</div><ul><li><a href=x>Link</a></ul><article><h2>Head</h2><p>{good}</article>") == \
        "\n".join([good.strip(), "Head", good.strip()])
    # no article, and an article without a long block or without stop words
    assert text(f"<div><a href=x>Home</a></div><div>Near a link.</div><p>Open.<p>{good}") == f"Open.\n{good.strip()}"
    strange = "Xq zv kkw prr " * 20
    assert text("<div class=ad>Buy</div><article><h1>Head</h1><p>Short.</article><footer>x</footer>") == "Head\nShort."
    assert text(f"<div>{good}</div><article><p>{strange}<p>Short.</article>") == \
        "\n".join([good.strip(), strange.strip(), "Short."])


def test_names_around_and_inside_articles():
    text = html_extract.main_text
    good = "The cat sat on the mat and it was happy with all that there is in the house. " * 3
    g = good.strip()
    # around an article
    for tag in ("<aside>", "<footer>", "<nav>", "<div class=related>", "<div id=related-posts>"):
        end = f"</{tag[1:].split()[0].strip('>')}>"
        teaser = f"{tag}<h2>More</h2><article><h3>A teaser</h3><p>{good[:150]}</article>{end}"
        assert text(f"<article><h1>Head</h1><p>{good}</article>{teaser}") == f"Head\n{g}"
        assert "teaser" not in text(f"<article><h1>Head</h1><p>{good}</article>{teaser}")
        assert "teaser" not in text(f"<main><article><h1>Head</h1><p>{good}</article>{teaser}</main>")
    # containers of the whole page
    for tag in ("<form id=f>", "<div class=elementor-widget>", "<div class='content with-sidebar'>"):
        end = f"</{tag[1:].split()[0]}>"
        assert text(f"<body class='post comments-open'>{tag}<main><h1>Head</h1><p>{good}</main>{end}") == f"Head\n{g}"
        assert text(f"{tag}<main><p>Short.</main>{end}") == "Short."
        assert g in text(f"<div>{good[:150]}</div>{tag}<main><p>{good}</main>{end}")
    # names inside an article
    page = (f"<article class='post no-comments'><h1 class=social>Head</h1><p>{good}<h2 id=related-work>Related work</h2>"
            f"<p>Short.<section id=discussion><h2>Discussion</h2><p>{good}<p>End.</section>"
            f"<p class=notice>{good}<div class='share'>We share <b>all</b></div><div class=widget><p>{good}</div>")
    kept = ["Head", g, "Related work", "Short.", "Discussion", g, "End.", g, "We share all", g]
    assert text(page + "</article>") == "\n".join(kept)
    # adverts, comments, forms and named links stay out, paragraphs that are links stay in
    page += (f"<div class=ad>{good}</div><div class=comments><p>{good}</div><form>{good}</form><aside>{good}</aside>"
             f"<div class=share><a href=x>Tweet</a></div><p><a href=x>A long link</a><ul><li><a href=y>One</a></ul>")
    assert text(page + "</article>") == "\n".join([*kept, "A long link", "One"])


def test_urls(spark):
    out = op7_url_filter(spark, SF01)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    for r in out.collect():
        rest = urls[r.page_id].split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = next((x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])), None)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[1] + fit[2])
        assert r.verdict == fit[0] if fit else r.verdict in ("allow", "block")


def test_learned_rules_and_odd_urls(spark):
    rows = [(i, f"http://{'bad-pills' if i % 3 == 0 else 'good'}.example.net/en/{i}") for i in range(120)]
    rows += [(500, None), (501, "no scheme"), (502, "x://HOST.Example.ORG?q=1#a"), (503, "x://"), (502, "x://a/b")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x"))
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(100)] + [(None, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.host): r for r in url_filter.filter_urls(pages, labels, URL_RULES).collect()}
    assert len(got) == len(rows)
    assert all(r.verdict == ("block" if r.host.startswith("bad") else "allow") for r in got.values())
    assert got[(502, "host.example.org")].path == "" and got[(502, "host.example.org")].rule is None
    assert (500, "") in got and (501, "") in got and (503, "") in got
    none = url_filter.filter_urls(pages, labels.limit(0), URL_RULES)
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), labels, URL_RULES).collect() == []


def test_rules_do_not_depend_on_the_number_of_urls(spark):
    # 20 unwanted urls of one host make a rule, 19 don't, among 100 and 60,000 labelled ones
    for n in (100, 60_000):
        rows = spark.range(n).select(
            F.expr("array(case when id < 20 then 'bad' when id < 39 then 'rare' else concat('ok', id % 7) end, 'all', "
                   "concat('page', id))").alias("tokens"), (F.col("id") < 39).alias("unwanted"))
        found = url_filter.mine(rows).collect()
        assert [(r.items, r.confidence) for r in found] == [(["bad"], 1.0)], n
        assert abs(found[0].support * n - 20) < 1e-6


def test_rules_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        held = [t for t in "abcde" if rng.random() < 0.4]
        rows.append((held, bool(rng.random() < (0.8 if {"a", "b"} <= set(held) or "e" in held else 0.1))))
    frame = spark.createDataFrame(rows, "tokens array<string>, unwanted boolean")
    rows = [(set(t), u) for t, u in rows if t]
    base = sum(u for _, u in rows) / len(rows)
    sure = {}
    for k in range(1, 32):
        items = {t for i, t in enumerate("abcde") if k >> i & 1}
        marks = [u for t, u in rows if items <= t]
        if sum(marks) >= 20 and sum(marks) / len(marks) >= max(0.5, 1.5 * base):
            sure[frozenset(items)] = sum(marks) / len(marks)
    expected = {x: c for x, c in sure.items() if not any(y < x and d >= c for y, d in sure.items())}
    got = {frozenset(r.items): r.confidence for r in url_filter.mine(frame).collect()}
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[x] - expected[x]) < 1e-9 for x in got)


def brute(rows, threshold=0.93):
    sound = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v
             and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    group = {i: i for i, _, _ in rows}
    links = dict.fromkeys(group, 0)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for lab in {s[2] for s in sound}:
        ids = [s[0] for s in sound if s[2] == lab]
        m = np.array([s[1] / np.linalg.norm(s[1]) for s in sound if s[2] == lab])
        for x, y in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1)), strict=True):
            links[ids[x]] += 1
            links[ids[y]] += 1
            a, b = find(ids[x]), find(ids[y])
            group[max(a, b)] = min(a, b)
    return sorted(((i, links[i], find(i), i == find(i)) for i in group), key=str)


def test_embeddings_equal_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    out = op8_embed_dedup(spark, SF01)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    expected = brute(rows)
    assert rows_of(out) == expected


def test_odd_vectors_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    rows = [(i, (base[i % 6] + rng.standard_normal(8) * rng.choice([0, 0.1, 0.3])).tolist(), int(i % 6 == 5))
            for i in range(150)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] * 8, 1),
             (504, [1.0, None] + [0.0] * 6, 1), (505, [float("inf")] * 8, 0), (506, base[0].tolist(), None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1))
    assert rows_of(embed_dedup.embed_dedup(frame)) == brute(rows)
    assert embed_dedup.embed_dedup(frame.limit(0)).collect() == []


def test_pages_deep_and_broken():
    text = html_extract.main_text
    long = "this is the text of the page and it is long enough to be a block of its own in the article of the day " * 3
    t0 = time.time()
    assert text("<div>" * 100_000 + f"<p>{long}</p>") == long.strip()
    assert text("<article>" * 20_000 + f"<p>{long}</p>" + "</article>" * 20_000) == long.strip()
    assert time.time() - t0 < 20
    assert text(f"<article><p>{long}</p><p>Formula <math><mi>x</mi></math> holds.</p></article>").endswith("Formula x holds.")
    assert text(f'<article><p>{long}</p><p>see <a href="x>link more</a> here</p></article>').endswith("see link more here")
    assert text(f'<article><p>{long}</p></article><div class="copyright">All rights reserved.</div>') == long.strip()


def test_extract_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>one"), (3, "u", "<p>a &amp; b</p><p>c</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("text", "n_chars", "tag")})
    got = sorted(((r.page_id, r.url, r.text) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", ""), (1, "u", ""), (2, None, ""), (None, "u", "one"), (3, "u", "a & b\nc")], key=str)
    assert html_extract.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_no_pair_at_the_threshold_is_left_out(dim):
    """Pairs just above the threshold, one vector along the other's signs."""
    rng = np.random.default_rng(dim)
    turn, missed, n = embed_dedup.rotation(dim), 0, 400
    for _ in range(n):
        v = np.sign(rng.standard_normal(dim)) + rng.choice([0, 1e-3, 1e-6]) * rng.standard_normal(dim)
        v /= np.linalg.norm(v)
        side = rng.standard_normal(dim)
        side -= side @ v * v
        cosine = 0.93 + rng.choice([1e-12, 1e-9, 1e-6, 1e-5])
        w = cosine * v + np.sqrt(1 - cosine ** 2) * side / np.linalg.norm(side)
        both = np.stack([v, w]) @ turn  # back: encode turns them again
        for x, y in ((0, 1), (1, 0)):
            turned, _, _ = embed_dedup.encode(both[[x]])
            _, codes, factors = embed_dedup.encode(both[[y]])
            missed += len(embed_dedup.passing(turned, codes, factors, 0.93)[0]) == 0
    assert missed == 0


def test_rules_under_one_suffix_are_found_by_their_rarest_item(spark):
    rules = spark.range(100_000).selectExpr(
        "id as rule", "array('host:com', concat('path:p', id)) as items", "0.5 + id / 1e6 as confidence", "0.1D as support")
    rules = rules.unionByName(spark.createDataFrame(
        [(-1, ["key:q"], 0.4, 0.1), (-2, ["host:com", "key:r", "path:p5"], 0.9, 0.1)],
        "rule long, items array<string>, confidence double, support double"))
    index = url_filter.keyed(rules)
    assert index.groupBy("key").count().agg(F.max("count")).first()[0] == 1
    urls = spark.createDataFrame([("a", ["host:com", "path:p7", "path:p9"]), ("b", ["host:com", "path:x"]), ("c", ["key:q"]),
                                  ("d", ["host:com", "path:p5", "key:r"]), ("e", ["path:p7"])], "row string, tokens array<string>")
    got = {r.row: r.best.rule for r in url_filter.matched(urls, rules).collect()}
    assert got == {"a": 9, "c": -1, "d": -2}
