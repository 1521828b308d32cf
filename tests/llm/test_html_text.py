import html
import re

from furrow.llm.frames import table
from furrow.llm.html_text import UNSEEN_TAG, UNSEEN_WORD, extract, learn_weights, main_text, op5_html_text, pieces

WEIGHTS = {"p": -0.2, "/p": -0.2, "h1": -0.2, "/h1": -0.2, "article": -0.2, "/article": -0.2, "in p": 1.0, "in h1": 1.0, "li": -3.0, "/li": -3.0, "a": -2.0, "/a": -2.0}


def page(body, more=""):
    menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">go {k}</a></li>' for k in range(6)) + "</ul></nav>"
    return f'<!DOCTYPE html><html><head><title>Not this</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>{menu}<div class="ad">Buy many things here now and save</div><article>{body}</article>{more}<footer>&copy; 2020 nobody</footer></body></html>'


def test_article_is_found():
    body = "<h1>The &amp; title</h1><p>First  part\n of <b>bo</b>ld text, 1 &lt; 2.<p>Second<br>part &#233;&eacute;.</p><!-- <p>hidden words</p> --><p>Last.</p>"
    assert main_text(page(body), WEIGHTS) == "The & title First part of bold text, 1 < 2. Second part éé. Last."


def test_parts_that_are_left_out():
    body = "<p>one two three four five</p><div class='promo-box'>buy</div><form><label>Name</label><input></form><aside>more</aside><p>six seven eight nine ten</p>"
    more = '<section id="comments"><p>I liked this article very much indeed and so on</p></section><div role="navigation">x y z</div>'
    assert main_text(page(body, more), WEIGHTS) == "one two three four five six seven eight nine ten"


def test_no_stretch_scores_more():
    text = page("<p>a b c</p><ul><li>x</li><li>y</li></ul><p>d e f g</p>", "<p>h</p><li>i</li>")
    values = [(-0.1 if left else WEIGHTS.get(tag, UNSEEN_TAG)) if tag else 0 if left else len(t.split()) * WEIGHTS.get("in " + parent, UNSEEN_WORD) for tag, t, parent, left, _ in pieces(text)]
    shown = ["" if left else t for _, t, _, left, _ in pieces(text)]
    best = max(((sum(values[i:j]), -i, -(j - i)) for i in range(len(values)) for j in range(i, len(values) + 1)))
    i = -best[1]
    assert main_text(text, WEIGHTS) == " ".join(" ".join(shown[i:i - best[2]]).split())


def test_broken_pages_end():
    for text in ["", "<", "<p", "<p class='x", "<!-- never closed", "<script>never", "plain words only", "</p></p>", "<p>a<p>b</div>c", "<" * 50_000, '<a href="' * 5_000, "<p>" * 20_000, "word " * 200_000, "&#0; &#xD800; &nosuch; &amp"]:
        assert isinstance(main_text(text, WEIGHTS), str)
    assert main_text("plain words only", WEIGHTS) == "plain words only"
    assert main_text("<p>a b c d<p>e</div>f g h i", WEIGHTS) == "a b c d e f g h i"


def test_odd_rows(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (3, "u", page("<p>some words are here</p>"), 5), (3, "u", page("<p>some words are here</p>"), 5), (None, "u", "<p>no id</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text int")
    got = extract(pages, learn_weights(pages)).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "", 0), (2, "", 0), (3, "some words are here", 19), (3, "some words are here", 19), (None, "no id", 5)]
    assert extract(pages.limit(0), learn_weights(pages.limit(0))).count() == 0


def test_query_over_the_whole_table(spark, sf):
    want = {}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        text = re.sub(r"<!--.*?-->", "", inner[1], flags=re.S) if inner else ""
        text = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", text)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"</?b>", "", text)).split())
    got = {r.page_id: r.text for r in op5_html_text(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert [k for k in want if got[k] != want[k]] == []
