"""Operator 12: pages' lines, their alignment, and main text against a plain version and against what pages are made of."""

import random
import re
from html import unescape

import pytest

from markerlake.llm import pages
from markerlake.llm.markup import ARTICLE, DROP, lines

ROWS = "page_id long, url string, html string, text string, mark string, shared string"


def kept(html):
    return [t for t, k in lines(html) if k != DROP]


def test_lines_of_markup():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><!-- <p>no</p> -->
    <div class="ad-slot">Buy</div><div id="wrapper-sidebar"><article><header class="entry-header"><h1>Tit&amp;le&nbsp; x</h1></header>
    <p>one <b>two<br>three<p>four &lt;five&gt; &#x41;<div class="Newsletter">Sign</div><table><tr><td>c1<td>c2</table>
    <section id="comments"><article>reader</article></section><form>f</form></article></div>
    <aside>side</aside><p>outside</p><footer>&copy; x</footer></body></html>"""
    assert kept(page) == ["Tit&le x", "one two three", "four <five> A", "c1", "c2"]
    assert {k for t, k in lines(page) if t in ("four <five> A", "c2")} == {ARTICLE}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []), ("plain  text\n here", ["plain text here"]), ("a < b <p>c", ["a < b", "c"]), ("x <b unfinished", ["x"]), ("x<!-- open <p>y", ["x"]),
        ("<p>a<script>never ends", ["a"]), ("<p title=\"a>b\">t</p>", ["t"]), ("<p don't>it's", ["it's"]), ("<a x=\"open>1</a><p>2", ["1", "2"]),
        ("<p>İ<SCRIPT>x</sCript>é</p>", ["İé"]), ("</p></div>z", ["z"]), ("<main><p>a</p><article>b</article></main>", ["b"]), ("<main>a</main>b", ["a"]),
        ("<div hidden>a</div><div style='display: none'>b</div><div role=banner>c</div>d", ["d"]), ("<form><article>a</article>b</form>", ["a"]),
    ],
)
def test_odd_markup(html, want):
    assert kept(html) == want


def test_reading_stays_linear():
    for piece in ("<b>", "<p><b>", "<li><ul>", "<", "<a x=\"", "</p>", "<!--", "&", "<div class=ad>", "<a ='"):
        lines(piece * 60_000)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, most):
    monkeypatch.setattr(pages, "TABLE_BYTES", most)
    pick = random.Random(2)
    for _ in range(400):
        a, b = ([pick.randrange(pick.choice((2, 5, 30))) for _ in range(pick.randrange(30))] for _ in "ab")
        places = pages.common(a, b)
        assert places == sorted(set(places)) and len(places) == longest(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in places))


def plain(rows):
    """The same pairs and differences, with each host's pages in one list."""
    once = {(i, u or "", h or "") for i, u, h in rows}
    listed = {}
    for i, u, h in once:
        host, path = pages.host_and_path(u)
        listed.setdefault(host, []).append(("\x01".join(pages.segments(path)), (i is not None, i), pages.mark(i, u, h), h))
    out = {}
    for some in listed.values():
        some.sort(key=lambda x: x[:3])
        for at, (way, (_, _), mark, html) in enumerate(some):
            mine = [t for t, _ in lines(html)]
            near = []
            for j in range(max(0, at - pages.REACH), min(len(some), at + pages.REACH + 1)):
                if j != at:
                    same = 0
                    for p, q in zip(way.split("\x01"), some[j][0].split("\x01")):
                        if p != q:
                            break
                        same += 1
                    near.append((-same, abs(j - at), j))
            gone, partner = set(), None
            others = {j: [t for t, _ in lines(some[j][3])] for _, _, j in near}
            for _, _, j in sorted(near):
                long = [t for t in mine if len(t.split(" ")) >= pages.LONG_WORDS]
                rest = [set(x) for i, x in others.items() if i != j]
                told = [(len(t.split(" ")), t in others[j]) for t in long if 2 * sum(t in x for x in rest) <= len(rest)]
                if long and all(t in others[j] for t in long) or told and sum(n for n, both in told if both) >= pages.COPY_SHARE * sum(n for n, _ in told):
                    continue
                gone, partner = set(pages.common(mine, others[j])), some[j][1][1]
                break
            text = "\n".join(t for i, (t, k) in enumerate(lines(html)) if k != DROP and (k == ARTICLE or i not in gone))
            out[mark] = (text, len(text), partner, len(gone))
    return sorted(((i, u, *out[pages.mark(i, u or "", h or "")]) for i, u, h in rows), key=repr)


def found(df):
    return sorted((tuple(r[x] for x in ("page_id", "url", "text", "n_chars", "nearest_id", "n_shared")) for r in pages.extract(df).collect()), key=repr)


def soup(n, seed):
    """Pages without telling markup: a frame that each host repeats around articles, of which some are near copies."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdefgh", k=5))
    frames = [([" ".join(word() for _ in range(pick.randint(1, 12))) for _ in range(6)], [" ".join(word() for _ in range(9)) for _ in range(2)]) for _ in range(4)]
    rows, articles = [], []
    for i in range(n):
        host = 0 if i % 3 else i % 4
        article = [" ".join(word() for _ in range(pick.randint(9, 20))) for _ in range(pick.randint(1, 6))]
        if i % 11 == 10:
            article = [*articles[-1][:-1], article[0]] if len(articles[-1]) > 3 else articles[-1]
        articles.append(article)
        top, bottom = frames[host]
        html = "<body>" + "".join(f"<div>{x}</div>" for x in [*top, *article, *bottom])
        rows.append((i, f"http://h{host}.example.org/{'abc'[i % 3]}/{i}?q={i}", html))
    return rows, articles


def test_shared_lines_go_where_markup_says_nothing(spark):
    rows, articles = soup(300, 1)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS).repartition(7)
    got = found(df)
    assert got == plain(rows)
    right = sum(r[2] == "\n".join(articles[r[0]]) for r in got)
    assert right >= 0.95 * len(rows)


def test_stretches_of_the_order_overlap(spark, monkeypatch):
    monkeypatch.setattr(pages, "STRETCH", 16)
    rows, _ = soup(130, 2)
    assert found(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "", "<p>a</p>"), (3, "no host", "<p>a</p><p>b"), (4, "HTTP://u:p@H.org:80/x/y#z", "<nav>n</nav>"), (5, "http://h.org", None), (6, "http://h.org/", "<p>" + "w " * 90_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS)
    assert found(df) == plain(rows)
    assert found(df.limit(0)) == []


def test_tables_articles(spark, middle):
    """The given pages mark their articles: their text, taken by a pattern, is what comes out."""
    df = spark.read.parquet(f"{middle}/pages.parquet")
    for r, row in zip(found(df), sorted(df.collect(), key=lambda x: repr((x["page_id"],)))):
        inner = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r[2] == "\n".join(x for x in blocks if x) and r[3] == len(r[2]) and r[0] == row["page_id"]
