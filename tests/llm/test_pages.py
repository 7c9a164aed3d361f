"""URL filters and HTML rendering."""

import math
import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import html_text, url_filter


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/12?x=/fr/", "http://a.b.example.org/en/2", "http://org/", "http://org", "https://cheappills.example.com/en/5", "https://x.com/fr/1",
    "https://x.com/de/1#t", "https://notcom/fr/", "ftp://casino-win.example.net?u=http://a.org/", "http://É.COM/fr/", "a://b://c.org/", "http://example.org/es", "http://\n/x", "https://freebets.io/" + "x" * 5000, "http://news.example.com:80/a",
]


def test_rules_and_rows(spark):
    for name in ("__judged", "__Judged"):
        clash = url_filter.url_filter(spark.createDataFrame([(1, URLS[4], "kept")], f"page_id bigint, url string, `{name}` string"))
        assert clash.columns[:3] == ["page_id", "url", name] and clash.first()[2] == "kept"
    rows = [(k, u, "kept") for k, u in enumerate(URLS)] + [(None, URLS[4], None)] * 2
    out = url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string, rule string").withColumnRenamed("rule", "score").repartition(2))
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:2] == ["page_id", "url"]
    for r in got:
        host, path, rule, verdict = plain_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))
    assert {r.url: r.verdict for r in got}["https://cheappills.example.com/en/5"] == "block"
    assert {r.url: r.verdict for r in got}[None] == "allow"
    assert url_filter.url_filter(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_segmentation():
    m = url_filter.fit()
    assert m.words.segment("cheappills") == ["cheap", "pills"]
    assert m.words.segment("onlinecasinobonus") == ["online", "casino", "bonus"]
    assert m.words.segment("qzxkvw") == ["qzxkvw"] and m.words.segment("") == []
    assert m.words.segment("spamqzxk") == ["spam", "qzxk"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["cheap", "pills", "win", "the", "news", "zq"]), max_size=6))
def test_segments_make_up_the_name(words):
    m = url_filter.fit()
    assert "".join(m.words.segment("".join(words))) == "".join(words)


def plain_split(counts, name):
    """The likeliest split of a name by trying all: known words by their counts, runs of unknown letters by their length."""
    total = sum(counts.values())
    best = {0: (0.0, [], False)}
    # All splits into known words and unknown runs, two runs never next to each other.
    def every(at, score, words, after_unknown):
        if at == len(name):
            yield score, words
        for end in range(at + 1, len(name) + 1):
            if name[at:end] in counts:
                yield from every(end, score + math.log(counts[name[at:end]] / total), [*words, name[at:end]], False)
            if not after_unknown:
                yield from every(end, score + (end - at) * math.log(0.1) - 2, [*words, name[at:end]], True)

    assert best
    return max(every(0, 0.0, [], False), key=lambda x: x[0])


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=8), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=8))
def test_segments_are_the_likeliest(name, counts):
    words = url_filter.Words({w: float(n) for w, n in counts.items()})
    score, _ = plain_split(counts, name) if counts else (None, None)
    got = words.segment(name)
    assert "".join(got) == name
    if counts:
        total = sum(counts.values())
        # The same score: words that are known count as such, neighbouring unknown letters as one run.
        cost = sum(max(math.log(counts[w] / total), len(w) * math.log(0.1) - 2) if w in counts else len(w) * math.log(0.1) - 2 for w in got)
        assert cost == pytest.approx(score)


def plain_odds(words):
    """Naive Bayes by its definition, in fractions."""
    from fractions import Fraction

    rows = [[w for name in names for w in name.split()] for names in (url_filter.UNWANTED, url_filter.ORDINARY)]
    known = {*rows[0], *rows[1]}
    odds = Fraction(3, 7)
    for w in words:
        if w in known:
            odds *= Fraction(rows[0].count(w) + 1, len(rows[0]) + len(known)) / Fraction(rows[1].count(w) + 1, len(rows[1]) + len(known))
    return odds


def plain_counts(pages):
    from collections import Counter

    found = Counter(w for html in pages if html for w in re.findall("[a-z]+", re.sub("<[^<>]*>", " ", html.lower())) if 2 <= len(w) <= 20)
    kept = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[: url_filter.MAX_WORDS])
    least = max(1.0, sum(kept.values()) / 10_000)
    for w in [*url_filter.COMMON, *(w for name in (*url_filter.UNWANTED, *url_filter.ORDINARY) for w in name.split())]:
        kept[w] = max(kept.get(w, 0), least)
    return kept


def test_url_query(spark, sf):
    """All columns against plain versions of the counts, the split (by its score), the rules and the odds."""
    got = url_filter.op6_url_filter(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    counts = plain_counts([p.html for p in pages.values()])
    assert len(got) == len(pages)
    segment = url_filter.Words({w: float(n) for w, n in counts.items()}).segment
    for r in got:
        host, path, rule, verdict = plain_rule(pages[r.page_id].url)
        labels = host.split(":")[0].split(".")
        names = re.findall("[a-z]+", " ".join(labels[:-1] if len(labels) > 1 else labels)) + re.findall("[a-z]+", path.lower())
        assert r.words == [w for n in names for w in segment(n)]
        odds = plain_odds(r.words)
        assert r.score == pytest.approx(math.log(odds), abs=1e-5)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if odds > 1 else "allow"))


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("a<b", "a<b"), ("1 < 2", "1 < 2"),
        ("<p>one<p>two", "one\n\ntwo"), ("<div>one</div><div>two</div>", "one\ntwo"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<html><head><title>t</title><style>x</style></head><body>seen<script>var a='</p>'</script>", "seen"),
        ("<h1>Head</h1>text<ul><li>one<li>two<ol><li>in<li>ner</ol><li>three</ul>end", "Head\n\ntext\n\n- one\n- two\n  1. in\n  2. ner\n- three\n\nend"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "name       n\nlong name  1\nx          22"),
        ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("<span style=\"visibility:hidden\">no</span>yes<input type=hidden value=x>", "yes"), ("<!-- <p>no</p> -->yes<!doctype html>", "yes"),
        ("<b>x <i>y</b> z</i>", "x y z"), ("</p></div>x", "x"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"), ("  a \n  b  ", "a b"), ("<p>a<hr>b", "a\n\n---\nb"), ("<textarea>x<y</textarea>", "x<y"),
        ("<title>t</title>x<title", "x<title"), ("<svg><text>no</text></svg>yes", "yes"), ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n\n  b"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"), ("<table><tr><td>x<td rowspan=2>y<td>z<tr><td>longer<td>w</table>", "x       y  z\nlonger     w"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<select><option>a<option selected>b<option>c</select>!", "b !"), ("<select><option>a<option>b</select>", "a"),
        ("<select multiple><option>a<option>b</select>", "a b"), ('<a href="x>one</a><b>two', "one two".replace(" ", "")), ("x<a y", "x<a y"), ("<datalist><option>no</datalist>yes", "yes"),
    ],
)
def test_render(page, text):
    assert html_text.render(page) == text


def test_render_deep_and_long():
    assert html_text.render("<div>" * 20_000 + "x") == "x"
    assert html_text.render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert len(html_text.render("<p>word " * 50_000).split()) == 50_000


HOSTILE = {
    "unclosed tags": lambda n: "<a x=" * n, "unclosed quotes": lambda n: "<a x=\"" * n + ">", "odd quotes": lambda n: "<a x=\"\" y=\" >" * n, "mixed quotes": lambda n: "<a \"' >" * n, "lone marks": lambda n: "<" * n,
    "end tags": lambda n: "<i>" * n + "</u>" * n, "end tags beyond a cell": lambda n: "<u><table><td>" + "<i>" * n + "</u>" * n, "paragraph beyond a cell": lambda n: "<p><table><td>" + "<div>" * n,
    "blocks": lambda n: "<i>" * n + "<div>" * n, "lists": lambda n: "<ul><li>x" * n, "tables": lambda n: "<table><tr><td>x" * n, "wide cells": lambda n: "<table><tr>" + "<td colspan=1000>x" * n,
    "tall cells": lambda n: "<table>" + "<tr><td rowspan=1000 colspan=3>x" * n, "comments": lambda n: "<!--" * n, "options": lambda n: "<select>" + "<option>x" * n, "entities": lambda n: "&" * n, "scripts": lambda n: "<script>" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_render_is_linear(name):
    """Four times the page takes no more than some nine times as long; a quadratic renderer takes sixteen."""
    import time

    def took(n):
        page = HOSTILE[name](n)
        best = 9e9
        for _ in range(3):
            start = time.process_time()
            html_text.render(page)
            best = min(best, time.process_time() - start)
        return best

    assert took(16_000) < 9 * took(4_000) + 0.05


def test_a_megabyte_of_unclosed_tags():
    import time

    page = "<a x=" * 210_000
    start = time.process_time()
    assert html_text.render(page) == page
    assert time.process_time() - start < 8  # two seconds on a common machine


class Plain(HTMLParser):
    """An independent reading of well-formed pages: visible words in order, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID and (self.hidden or tag in html_text.UNSEEN or "hidden" in dict(attrs) or "none" in (dict(attrs).get("style") or "")):
            self.hidden += 1

    def handle_endtag(self, tag):
        self.hidden -= self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


PART = st.recursive(
    st.sampled_from(["word", "two words", "é &amp; x", "1 &lt; 2", ""]),
    lambda inner: st.tuples(st.sampled_from(["p", "div", "b", "i", "span", "section", "h2", "blockquote", "template", "span hidden", "div style='display:none'"]), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]}>{' '.join(t[1])}</{t[0].split()[0]}>"),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(PART, max_size=5))
def test_render_has_the_words_of_an_independent_parser(parts):
    page = re.sub(r"<p>(.*?)</p>", lambda m: m[0] if not re.search(r"<(p|div|section|h2|blockquote)", m[1]) else m[1], "".join(f"<div>{x}</div>" for x in parts), flags=re.S)
    if page.count("<p>") != page.count("</p>"):
        return
    plain = Plain()
    plain.feed(page)
    assert "".join(html_text.render(page).split()) == "".join("".join(plain.words).split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b", "<div ", "class='a'", ">", "</", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "x", " ", "&amp;", "<!--", "-->", "<script>", "</script>", "<pre>", "\n"]), max_size=30))
def test_render_never_fails(parts):
    html_text.render("".join(parts))


def test_html_query_has_all_words(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.op9_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    import html

    for r in got:
        page = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<!--.*?-->", " ", pages[r.page_id])
        words = html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", page)).split()
        assert "".join(re.sub(r"(?m)^\s*(- |\d+\. )", "", r.text).split()) == "".join(words)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>a", "y")], "page_id bigint, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "text"] and sorted(r.text for r in out.collect()) == ["", "", "a"]
    assert html_text.extract(df.limit(0)).collect() == []
