import html
import random
import re

import pytest

from keyrill.llm import extract as ex
from keyrill.llm.queries import QUERIES
from tests.oracle import SF


def test_query_equals_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op7_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, "\n\n".join(b for b in blocks if b), len(r.text))


PARTS = {
    "nav": "<nav><a href=/x>Home</a><a href=/y>News</a></nav>", "header": "<header><h2>The Daily Site</h2></header>", "footer": "<footer><p>All rights reserved by us.</p></footer>",
    "aside": "<aside><p>Read this other story as well, please do.</p></aside>", "cookie": "<div class='cookie-banner'><p>We use cookies to make this site work for you.</p></div>",
    "ad": '<div id="ad-1">Buy a boat now.</div>', "form": "<form><label>Your mail address here</label><button>Go</button></form>", "script": "<script>if (a < b) document.write('<p>no</p>')</script>",
    "style": "<style>p { color: red }</style>", "comments": "<section class=comments><h3>Comments</h3><div class=comment><p>I liked this article very much indeed.</p></div></section>", "top": "<div class='site-header'><p>The paper of this town since long ago.</p></div>", "teaser": "<section class=related><article><p>Another story that you may like to read now.</p></article></section>", "note": "<!-- <p>hidden words</p> -->",
}
MAIN = "<h1>A &amp; B</h1><p>First   words\nof the <b>story</b>, told at length.</p><p>Second&nbsp;part &lt;here&gt; caf&eacute; &#x263A;.<br>Next line</p><ul><li>One point</li><li>Two points</li></ul>"
WANT = "A & B\n\nFirst words of the story, told at length.\n\nSecond part <here> café ☺. Next line\n\nOne point\n\nTwo points"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>"])
def test_parts_that_are_not_the_article_go(wrap):
    rng = random.Random(1)
    for _ in range(20):
        around = rng.sample(list(PARTS.values()), len(PARTS))
        inner = MAIN.replace("</p><p>", f"</p>{PARTS['ad']}{PARTS['script']}<p>", 1) + PARTS["comments"]
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(around[:5]) + wrap.format(inner) + "".join(around[5:]) + "</body></html>"
        assert ex.main_text(page) == WANT


LONG = "".join(f"<p>Sentence number {i} of the story goes on for a while, so that the article is the better part.</p>" for i in range(6))
LONG_WANT = "\n\n".join([WANT, *re.findall("<p>(.*?)</p>", LONG)])


@pytest.mark.parametrize("page", [
    "<div class='wrapper with-sidebar'><article>{}</article>{rest}</div>",
    "<form id=aspnetForm><div><article>{}</article></div>{rest}</form>",
    "<form id=aspnetForm>{rest}<div class=content>{}</div></form>",
    "<div class='page menu'>{rest}<article>{}</article></div>",
    "<div class='site social'><main>{}</main>{rest}</div>",
    "<div id=main class='no-sidebar'>{}</div>{rest}",
    "<article class='post related-links-on'>{}</article>{rest}",
    "<div class='single-post comments-open'>{rest}<div class='post-body'>{}</div></div>",
    "<div id=ad-wrapper class=widget><div role=main>{}</div></div>{rest}",
    "<aside class=page><article class=banner>{}</article></aside>{rest}",
    "<div class='siteHeader'><p>Since long ago the paper of this town.</p></div><div class='mainContent hasSidebar'>{}</div>{rest}",
    "<table><tr><td class=sidebar>{rest}</td><td class=text>{}</td></tr></table>",
])
def test_names_and_forms_around_the_article_are_no_verdict(page):
    rest = "".join(PARTS[k] for k in ("nav", "header", "footer", "aside", "cookie", "ad", "form", "comments", "teaser"))
    assert ex.main_text("<html><body>" + page.replace("{rest}", rest).replace("{}", MAIN + LONG) + "</body></html>") == LONG_WANT


def test_many_comments_outweigh_no_article():
    notes = "".join(f"<article class=comment><p>Reader {i} has a good deal to say about this, and says it here at length.</p></article>" for i in range(40))
    for page in (f"<article>{MAIN}</article><section class=comments>{notes}</section>", f"<main><article>{MAIN}<div id=comments>{notes}</div></article></main>"):
        assert ex.main_text(page) == WANT


def test_comments_that_are_articles_go():
    page = f"<main><p>Before the article.</p><article>{MAIN}<div class=comments><article class=comment><p>Nice.</p></article></div></article><article class='comment'><p>Bad.</p></article></main>"
    assert ex.main_text(page) == WANT


def test_page_without_marks_keeps_paragraphs_and_not_links():
    text = "This is a long paragraph of a plain old page that says something about the world in whole sentences."
    page = "<body><div><a href=a>Home</a> <a href=b>About</a> <a href=c>Contact</a></div><p>" + text + "</p><p>" + text + "</p><div><a href=d>Next</a></div>"
    assert ex.main_text(page) == f"{text}\n\n{text}"


@pytest.mark.parametrize("page", [None, "", "<p", "<script>never closed", "<!-- open", "</p></div>", "<p>" * 3000, "<div " + "x" * 5000])
def test_broken_pages_do_not_crash(page):
    assert ex.main_text(page) == ""


def test_deep_page():
    assert ex.main_text("<div>word and " * 30_000 + "</div>" * 30_000).startswith("word and")


def test_long_page_and_plain_text():
    page = "<article>" + "<p>word word word.</p>" * 4000 + "</article><footer>end</footer>"
    assert ex.main_text(page) == "\n\n".join(["word word word."] * 4000)
    assert ex.main_text("just some plain text without any markup at all, a sentence.") == "just some plain text without any markup at all, a sentence."


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        gains = [(rng.random(), rng.random()) for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        graph = ex.Cut(n + 2)
        for i, (a, b) in enumerate(gains):
            graph.edge(n, i, a, 0)
            graph.edge(i, n + 1, b, 0)
        for i, j, w in edges:
            graph.edge(i, j, w, w)
        cost = lambda side: sum(b if s else a for (a, b), s in zip(gains, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])
        got = cost(graph.source_side(n, n + 1)[:n])
        assert abs(got - min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))) < 1e-6


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, "clash"), (None, "u", "<p>Some words that make a sentence.</p>", "x"), (1, None, None, "clash")], "page_id long, url string, html string, text string")
    rows = ex.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "Some words that make a sentence.", 32), (1, "", 0), (1, "", 0)]
    assert ex.extract(df.limit(0)).count() == 0
