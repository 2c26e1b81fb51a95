"""Operators that work text by text: BPE, language ID, HTML, quality measures."""

import hashlib
import html as stdlib_html
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import ROWS
from pathlight.llm import bpe, html, langid, quality, queries
from pathlight.llm.common import id_remainder, table
from pyspark.sql import functions as F

PATH, PATTERN = queries.tokenizer()


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_bpe_equals_tiktoken_on_random_strings():
    codec, enc, r = bpe.Codec(PATH, PATTERN), reference_encoding(), random.Random(3)
    for _ in range(300):
        s = "".join(r.choice("aab é\n\t😀中ñ1 '<|endoftext|>") for _ in range(r.randint(0, 60)))
        ids = codec.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()
    long = "a" * 20_000
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == enc.encode_ordinary(long)


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1000)
    codec = bpe.Codec(PATH, PATTERN)
    first = codec.encode("one two three four five six seven")
    assert codec.known.held <= 1000 and len(codec.known) <= 4 and len(codec.known.old) <= 4
    assert codec.encode("one two three four five six seven") == first
    long = "x" * (bpe.LONGEST + 1)
    assert codec.decode(codec.encode(long)) == long.encode() and long not in codec.known and long not in codec.known.old


def test_bpe_ascii_pattern():
    import re

    import regex

    r, fast, slow = random.Random(1), re.compile(bpe.ascii_pattern(PATTERN), re.ASCII), regex.compile(PATTERN)
    for _ in range(5000):
        s = "".join(chr(r.randrange(128)) for _ in range(r.randint(0, 30)))
        assert fast.findall(s) == slow.findall(s)


def test_bpe_query(spark, sf):
    rows = queries.op8_bpe_segment_tree(spark, sf).collect()
    enc = reference_encoding()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_edges(docs, empty):
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(r["decoded"] for r in out) == sorted((t or "").encode() for _, t, _, _ in ROWS)
    assert bpe.digests(empty, PATH, PATTERN).count() == 0


def test_langid_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_langid_compression(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.96
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.03


def test_langid_edges(docs, empty):
    contents = langid.learn(docs)
    assert set(contents) == {"en", "la", "de", "fr"}
    rows = langid.identify(docs, contents).collect()
    assert len(rows) == len(ROWS)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {2, 3, 6, 9} and all(r["score"] == 0 and r["rejected"] for r in rows if r["doc_id"] in und)
    kept = langid.keep_identified(docs, contents)
    assert kept.columns == docs.columns and {4, 10} <= {r["doc_id"] for r in kept.collect()}
    assert langid.identify(empty, contents).count() == 0
    nothing = langid.learn(empty)
    assert nothing == {} and {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<div id=content><h2>Head &amp; line</h2><div><p>First   paragraph with <b>bold</b> and a <a href=x>link</a> in it, long enough to be text.
<p>Second paragraph &eacute; &#x4e2d;&nbsp;here, of some length as well.<br>After a break.</div></div>
<aside>Side</aside><div class=sidebar><a href=1>one</a> <a href=2>two</a></div>
<form><input name=q>Search</form><section id="comments"><p>Great post, thanks a lot for sharing this with all of us!</p></section>
<script>var t = "</p><p>no</p>";</script><footer>Imprint</footer></body></html>"""
TEXT = "Head & line\nFirst paragraph with bold and a link in it, long enough to be text.\nSecond paragraph é 中 here, of some length as well.\nAfter a break."


def test_html_main_text():
    assert html.main_text(PAGE) == TEXT
    article = "<body><div class=ad>Buy this now</div><article><h1>T</h1><p><b>One.<br><p>Two &lt;b&gt;.</article></body>"
    assert html.main_text(article) == "T\nOne.\nTwo <b>."


def test_html_odd_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("no tags at all") == "no tags at all"
    assert html.main_text("<div>" * 4000 + "deep") == "deep"
    assert html.main_text("<p>a<p>b</p></p></div>") == "a\nb"
    assert html.main_text("<p title='a>b'>x</p><!-- <p>no</p> -->") == "x"
    assert html.main_text('<p a="' * 300).count("\n") >= 0
    assert html.main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"


def test_html_table(spark, sf):
    pages = table(spark, sf, "pages")
    rows = {r["page_id"]: r for r in queries.op1_html_density(spark, sf).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():
        r = rows[p["page_id"]]
        assert r["url"] == p["url"] and r["n_chars"] == len(r["text"]) > 0
        assert "track(" not in r["text"] and "©" not in r["text"]


def test_html_null_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (1, "u", "<p>x", 4), (None, "v", "", 5)], "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in html.extract(pages).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert html.extract(pages.where("false")).count() == 0


def plain_measures(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op4_risk_cutoffs(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_bound_is_exact():
    # One minus the confidence equals the probability of so few rejections at the bound.
    for x, n in ((0, 50), (3, 200), (10, 1000)):
        p = quality.upper_bound(x, n, 0.05)
        from math import comb

        assert abs(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)) - 0.05) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0


def test_quality_keeps_good_and_rejects_junk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{good} number {i}", "en") for i in range(2000)] + [(i, " ".join(f"w{j}### {i}" for j in range(40)), "en") for i in range(2000, 2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 2000) as quality").where("doc_id % 2 = 0")
    out = quality.judge(docs, labels).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert len(kept & set(range(2000))) > 1960 and not kept & set(range(2000, 2200))


def plain_verdicts(rows, risk=quality.RISK, delta=quality.DELTA):
    """The kept ids from (id, stratum, base_failed, good or None, proposes, values), step by step."""
    from statistics import median

    labelled = [r for r in rows if not r[2] and r[3] is not None]
    strata = {r[1] for r in labelled}
    found = {}
    for key in [("own", s) for s in strata] + [("all", None)]:
        mine = [r for r in labelled if key[0] == "all" or r[1] == key[1]]
        first, test = [r for r in mine if r[4]], [r for r in mine if not r[4] and r[3]]
        good, bad = [r[5] for r in first if r[3]], [r[5] for r in first if not r[3]]
        k = len(quality.RULES)
        tops = [max((g[i] for g in good), default=math.inf) for i in range(k)]
        over = [[b[i] for b in bad if b[i] > tops[i]] for i in range(k)]
        order = sorted((i for i in range(k) if over[i]), key=lambda i: (-len(over[i]), i))
        steps = [(order[: j + 1], quality.LEVELS[0]) for j in range(len(order))] + [(order, x) for x in quality.LEVELS[1:] if order]
        for rules, level in steps:
            cuts = {i: tops[i] + level * (median(over[i]) - tops[i]) for i in rules}
            wrong = sum(any(r[5][i] > c for i, c in cuts.items()) for r in test)
            if not test or quality.upper_bound(wrong, len(test), delta / (len(strata) + 1)) > risk:
                break
            found[key] = cuts
    out = set()
    for r in rows:
        cuts = found.get(("own", r[1]), found.get(("all", None), {}))
        if not r[2] and not any(r[5][i] > c for i, c in cuts.items()):
            out.add(r[0])
    return out, found


def test_quality_verdict_equals_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    good = {}
    for r in labels.collect():
        good[r["doc_id"]] = good.get(r["doc_id"], False) or r["quality"] == 1
    first = {r["doc_id"] for r in docs.where(quality.proposes()).select("doc_id").collect()}
    out = quality.judge(docs, labels).collect()
    rows = [(r["doc_id"], lang[r["doc_id"]], r["base_failed"], good.get(r["doc_id"]), r["doc_id"] in first, [r[x] for x in quality.RULES]) for r in out]
    kept, found = plain_verdicts(rows)
    assert {r["doc_id"] for r in out if r["kept"]} == kept and found
    decided = [r for r in out if not r["base_failed"] and not r["kept"]]
    assert decided  # the method itself rejects documents here
    judged = [r for r in out if good.get(r["doc_id"]) and not r["base_failed"]]
    assert sum(not r["kept"] for r in judged) / len(judged) < 0.02


def test_quality_edges(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert len(quality.judge(docs, labels).collect()) == len(ROWS)
    assert quality.judge(docs, labels.where("false")).count() == len(ROWS)
    assert quality.judge(empty, labels).count() == 0


def test_id_remainder(spark):
    rows = spark.range(50).select("id", id_remainder(F.col("id"), 7).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in rows)
    assert public_tokenizers.PATTERN == PATTERN


def page(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


LONG_A = "A long paragraph of the story, with plenty of words so that it is dense and counts as text, again and again."
LONG_B = "Another one of the same kind, which goes on about the same thing for a while and ends only after some more words."


def test_html_layouts():
    nav = "<div class='main-nav'><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a></div>"
    want = f"Title\n{LONG_A}\n{LONG_B}"
    body = f"<p>{LONG_A}</p><p>{LONG_B}</p>"
    assert html.main_text(page(nav, f"<div class='content with-sidebar'><h1>Title</h1>{body}</div>", "<div id=page-footer>Imprint and more</div>")) == want
    assert html.main_text(page(nav, f"<div><h1>Title</h1><div>{body}</div></div>", "<div><p>Short bit</p></div>")) == want
    assert html.main_text(page("<div class=page-header>The Site</div>", f"<main><div class=entry-header><h1>Title</h1></div>{body}</main>")) == want
    assert html.main_text(page(f"<article><header><h1>Title</h1></header>{body}<div class='post-comments'><p>Nice!</p></div></article>", "<article class=comment><p>I do not agree with this at all.</p></article>")) == want
    assert html.main_text(page(f"<table><tr><td>{nav}<td><h1>Title</h1>{body}</table>")) == want
    links = "<ul><li><a href=1>Some other story of ours</a><li><a href=2>And yet another story</a><li><a href=3>More stories</a></ul>"
    assert html.main_text(page(f"<article><h1>Title</h1>{body}{links}</article>")) == want


def plain_densities(order):
    """Composite text density and its sums as defined, node by node."""
    out, body = {}, order[0]
    for x in order:
        links = max(x.links, 1)
        free, tags, linked = max(x.chars - x.link_chars, 1), max(x.tags, 1), max(x.link_chars, 1)
        if x.chars:
            low = math.log(x.chars / free * x.link_chars + body.link_chars / max(body.chars, 1) * x.chars + math.e)
            out[id(x)] = x.chars / tags * max(math.log(max(x.chars / linked * tags / links, 1.0)) / low, 0.0)
        else:
            out[id(x)] = 0.0
    sums = {}
    for x in order:
        kids = [out[id(c)] for c in x.parts if isinstance(c, html.Node) and not c.noise and c.tag not in html._INLINE and c.tag != "br"]
        sums[id(x)] = sum(kids) if kids else out[id(x)]
    return out, sums


def test_html_densities_equal_plain_ones(spark, sf):
    for page in [PAGE, *[r["html"] for r in table(spark, sf, "pages").limit(40).collect()]]:
        root = html.parse(page)
        html._mark(root)
        order = html._measure(root)
        html._densities(order)
        density, sums = plain_densities(order)
        assert all(abs(x.density - density[id(x)]) < 1e-9 and abs(x.total - sums[id(x)]) < 1e-9 for x in order)


def test_html_text_beside_the_densest_part():
    long = "This sentence is repeated to make a paragraph that is as long as those of real articles are. "
    page = f"<body><div class=post><p>{long * 2}</p><div><p>{long * 3}</p><p>{long * 3}</p></div><p>The end.</p></div><div><p>Short bit</p></div></body>"
    assert html.main_text(page).split("\n") == [x.strip() for x in (long * 2, long * 3, long * 3, "The end.")]
    bare = f"<body><div>Bare intro of the text <b>here</b> <div><p>{long * 3}</p><p>{long * 3}</p></div></div></body>"
    assert html.main_text(bare).startswith("Bare intro of the text here\n")
    named = f"<article><div class=share-price><p>{long}</p></div><section class='related-work'><p>{long}</p></section><fieldset><p>{long}</p></fieldset><div class=share-buttons>Share</div></article>"
    assert html.main_text(named).split("\n") == [long.strip()] * 3


def test_html_density_chooses_among_boxes():
    """Boxes without telling names or elements: the densest one is the text; with densities left out another would be."""
    menu = "".join(f"<p><a href=/{i}>Entry number {i} of a long list of links to other pages of this site</a></p>" for i in range(12))
    text = "<p>" + "Plain sentences without any link make up the text of this page and nothing else. " * 4 + "</p>"
    page = f"<body><div>{menu}</div><div>{text}{text}</div></body>"
    out = html.main_text(page)
    assert out.count("Plain sentences") == 8 and "Entry" not in out


NAMES = "ad-hoc-analysis menu-engineering footer-note comment-on-ruling cookies-recipe banner-year navigation-history signup-guide widget-review"


@pytest.mark.parametrize("name", NAMES.split())
def test_html_density_overrules_names(name):
    text = f"Title\n{LONG_A}\n{LONG_B}\n{LONG_A[::-1]}"
    part = f"<section class='{name}'><p>{LONG_B}</p></section>"
    assert html.main_text(page(f"<article><h1>Title</h1><p>{LONG_A}</p>{part}<p>{LONG_A[::-1]}</p></article>")) == text
    assert html.main_text(page(f"<div><h1>Title</h1><p>{LONG_A}</p>{part}<p>{LONG_A[::-1]}</p></div>")) == text
    # The same names on parts that are not dense, and names of nothing but such words, mark noise.
    for low in (f"<div class='{name}'>Buy now!</div>", f"<div class='{name}'><p>{LONG_B[:40]}</p><p>Yes</p><p>No</p></div>", "<div class='comment-list ad-box'><p>" + LONG_B + "</p></div>"):
        assert html.main_text(page(f"<article><h1>Title</h1><p>{LONG_A}</p>{low}<p>{LONG_B}</p><p>{LONG_A[::-1]}</p></article>")) == text


def test_html_forms():
    """A form around the page is no noise; forms to fill in are, alone on a page too."""
    body = f"<h1>Title</h1><p>{LONG_A}</p><p>{LONG_B}</p>"
    fill = "<form><p>Your name <input name=n></p><p>Your message to us <textarea></textarea></p><button>Send</button></form>"
    want = f"Title\n{LONG_A}\n{LONG_B}"
    for around in (f"<article>{body}</article>", f"<div>{body}</div>", f"<main>{body}{fill}</main>"):
        assert html.main_text(page(f"<form id=form1><input type=hidden><nav><a href=1>Home</a></nav>{around}<footer>Imprint</footer></form>")) == want
    assert html.main_text(page(f"<article>{body}{fill}</article>")) == html.main_text(page(f"<article>{body}</article>{fill}")) == want
    assert html.main_text(page(fill)) == html.main_text(page("<form>Search <input></form>")) == ""
    assert html.main_text("<form class=ad-hoc>" * 3000 + f"<p>{LONG_A}") == LONG_A


def test_html_article_is_not_decisive():
    """Where the greatest sum of densities is decides, not where an ``article`` is: with the ablation these texts differ."""
    body = f"<p>{LONG_A}</p><p>{LONG_B}</p><p>{LONG_A[::-1]}</p>"
    want = f"{LONG_A}\n{LONG_B}\n{LONG_A[::-1]}"
    teaser = "<article><h2><a href=1>Other story</a></h2><p>In short.</p></article>"
    assert html.main_text(page(teaser, f"<div>{body}</div>", teaser)) == want
    # A second article of the same weight is text as well, a lesser one is not, nor is a note beside it.
    assert html.main_text(page(f"<article>{body}</article><p>{LONG_B[:60]}</p><article>{body}</article>{teaser}")) == f"{want}\n{want}"
    # Inside an article density bounds the text: a box of links goes, one of short lines stays.
    box = "<div><p><a href=1>First of the other stories</a></p><p><a href=2>Second of the other stories</a></p></div>"
    assert html.main_text(page(f"<article><div>{body}</div>{box}<div>By Jane Doe</div></article>")) == f"{want}\nBy Jane Doe"


def plain_text(page):
    """Main text as defined, by recursion over the tree of a page without suspects; densities are the plain ones."""
    root = html.parse(page)
    assert not html._mark(root)
    order = html._measure(root)
    density, sums = plain_densities(order)
    path = [max((x for x in order if x.tag not in html._INLINE), key=lambda x: sums[id(x)])]
    while path[-1].up is not None:
        path.append(path[-1].up)
    least = min(density[id(x)] for x in path)
    article = max((i for i, x in enumerate(path) if x.tag in ("article", "main")), default=-1)
    weight = max((sums[id(x)] for x in path[: article + 1]), default=0) * html.BESIDE_SHARE

    def stays(c, i, before):
        """Whether part ``c`` of ``path[i]``, not on the path itself, is text."""
        body, text = i == len(path) - 1, isinstance(c, str)
        if i > article >= 0:
            return not text and c.tag not in html._INLINE and density[id(c)] >= max(least, 0) and sums[id(c)] >= weight
        if text:
            return not body or len(" ".join(c.split())) >= least
        if c.tag in html._INLINE or c.tag == "br":
            return not body or (not c.link_chars and c.chars >= least)
        dense = density[id(c)] >= least or (before and c.tag in ("h1", "h2")) or (not body and c.tag in html._TEXT)
        return dense or (i <= article and 2 * c.link_chars <= c.chars)

    def text(x, out):
        if isinstance(x, str):
            out.append(x)
            return
        if x.tag in ("br", "hr"):
            out.append("\n\n")
            return
        linked = x.links >= 3 and x.link_chars > 0.7 * x.chars and density[id(x)] < least and x.tag not in html._INLINE
        edge = "" if x.tag in html._INLINE else "\n\n"
        out.append(edge)
        if not (linked and x is not root):
            i, before = (path.index(x) if x in path else 0), True
            for c in x.parts:
                if not isinstance(c, str) and c.noise:
                    continue
                on = i > 0 and c is path[i - 1]
                before = before and not on
                if i == 0 or on or stays(c, i, before):
                    text(c, out)
        out.append(edge)

    parts = []
    text(root, parts)
    marked = "".join(p if p == "\n\n" else " ".join(f"_{p}_".split())[1:-1] for p in parts)
    blocks = (" ".join(stdlib_html.unescape(b).split()) for b in marked.split("\n\n"))
    return "\n".join(b for b in blocks if b)


def test_html_text_equals_plain_one(spark, sf):
    pages = [r["html"] for r in table(spark, sf, "pages").collect()]
    found = [r["text"] for r in html.extract(table(spark, sf, "pages")).orderBy("page_id").collect()]
    assert found == [plain_text(r["html"]) for r in table(spark, sf, "pages").orderBy("page_id").collect()]
    for article in ("<div>", "<section>"):  # the same pages without the element
        for p in pages[:150]:
            p = p.replace("<article>", article).replace("</article>", article.replace("<", "</"))
            assert html.main_text(p) == plain_text(p)


@pytest.mark.parametrize("page", ["<span>{}</b>", "<b>{}<p>x", "<div>{}</p>", "<ul><li><ul><b>{}<li>x"])
def test_stray_tags_take_linear_time(page):
    """Five times the tags take far less than the twenty-five times of a walk to the root for each."""
    import time

    def seconds(n):
        a, b = page.split("{}")
        began = time.perf_counter()
        html.parse(a * n + b * n if "<ul>" not in a else a[:12] + "<b>" * n + b * n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(20_000) < 12 * max(min(seconds(4_000) for _ in range(3)), 0.02)
