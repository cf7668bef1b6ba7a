"""Main text of hand-made pages with awkward furniture, and of every page of the table against its article element."""

import html
import re
import time

import pytest

from txrisk.llm.common import table
from txrisk.llm.html import main_text
from txrisk.llm.queries import queries

LONG = "".join(f"<p>Furniture {k}, of some length, with commas, and much to say about nothing at all.</p>" for k in range(6))
BODY = "".join(f"<p>Sentence {k} of the article, which goes on, and on, for a while longer.</p>" for k in range(4))
TEXT = " ".join(f"Sentence {k} of the article, which goes on, and on, for a while longer." for k in range(4))

CASES = {
    "long sidebar beside a tiny article": (f'<div class="sidebar">{LONG}</div><article><p>Tiny.</p></article>', "Tiny."),
    "tiny article before a long sidebar": (f'<article><p>Tiny.</p></article><div id="sidebar">{LONG}</div>', "Tiny."),
    "notice beside a short article": (f'<div class="notice">{LONG}</div><article><h1>Title</h1><p>Short.</p></article>', "Title Short."),
    "notice inside the article": (f'<article><div class="notice">{LONG}</div>{BODY}</article>', TEXT),
    "related section inside the article": (f'<article>{BODY}<section class="related">{LONG}</section></article>', TEXT),
    "sidebar beside a plain container": (f'<div id="c">{BODY}</div><div class="sidebar">{LONG}</div>', TEXT),
    "sidebar inside a plain container": (f'<div id="c">{BODY}<div class="sidebar">{LONG}</div></div>', TEXT),
    "article whose text is all in a widget": (f'<article><div class="widget">{BODY}</div></article><div class="sidebar">{LONG}</div>', TEXT),
    "no article, all text in a suspect": (f'<div class="widget">{BODY}</div>', TEXT),
    "wrapper with the word of a sidebar": (f'<div class="layout has-sidebar"><article>{BODY}</article></div>', TEXT),
    "short division beside an article": (f"<article>{BODY}</article><div><p>Read, share, and like.</p></div>", TEXT),
    "several articles": (f"<article>{BODY}</article><article>{BODY}</article>", f"{TEXT} {TEXT}"),
    "comments as articles": (f'<article>{BODY}</article><article class="comment">{LONG}</article>', TEXT),
    "sign in a quoted value": ("<article><p title='1 < 2'>Text of a paragraph.</p><p title=\"a > b\">More.</p></article>", "Text of a paragraph. More."),
    "quotes outside values": ('<article><p class=a"b>He said "5 < 6" and left.</p></article>', 'He said "5 < 6" and left.'),
    "headline only": ('<nav>Menu</nav><article><h1>Only a headline</h1></article><footer>end</footer>', "Only a headline"),
    "headline beside a sidebar": (f'<article><h1>Only a headline</h1></article><div class="sidebar">{LONG}</div>', "Only a headline"),
    "tag that never ends": ("<article><p>Text here.</p></article><a href=" + "=x" * 5_000, "Text here."),
    "nothing": ("<nav>Menu</nav>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_furniture_goes_and_articles_stay(name):
    page, want = CASES[name]
    assert main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == want


def test_time_grows_with_the_page_and_not_with_its_square():
    def seconds(depth):
        page = "<div>" * depth + BODY + "</div>" * depth
        start = time.perf_counter()
        assert main_text(page) == TEXT
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.01)


def test_every_page_gives_the_text_of_its_article(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").select("page_id", "html").collect()}
    for r in queries()["op3_html_extraction"](spark, sf).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        inside = re.sub(r'<!--.*?-->|<script.*?</script>|<style.*?</style>|<div class="ad">.*?</div>', "", inside, flags=re.S)
        blocks = re.sub(r"</?(p|h\d|br|li|ul|ol|div|blockquote|table|tr|td|th|section|header|pre|figure|figcaption)\b[^>]*>", " ", inside)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", blocks)).split())
        assert r["text"] == want and r["n_chars"] == len(want)
