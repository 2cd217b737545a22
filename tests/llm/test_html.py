import re

import numpy as np
import pyarrow.parquet as pq

from cartlens.llm import html

SF = "/root/testdata/sf0.01"


def main_of(page):
    return "\n".join(t for region, t in html.blocks(page) if region == html.MAIN)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="page">
      <header><h1>Site</h1></header><nav>menu <a>x</a></nav><!-- c --><div class="top-ad wide">Buy</div><div id=cookie-notice>ok?</div>
      <article><header><h1>Head &amp; line</h1></header><p>One <b>bold<br>two</b>&nbsp;three<p>Four
      five<aside>side</aside><ul><li>a<li>b</ul><form>f <input></form><div style="display: none">hid</div><p hidden>h</p>
      <section class="comments"><p>first!</p></section><figure><img src=x><figcaption>cap</figcaption></figure>x &lt;y&gt; &#233;<noscript>n</noscript></article>
      <footer>foot</footer><div role="complementary">r</div></body>"""
    assert main_of(page) == "Head & line\nOne bold two three\nFour five\na\nb\ncap\nx <y> é"
    assert [t for region, t in html.blocks(page) if region == html.OPEN] == []


def test_broken_markup():
    assert main_of("<article><p>cut off in the <b") == "cut off in the"
    assert main_of("<nav>menu<article><p>text</article>") == "text"
    assert main_of("<article>a</p>b</div>c</article></article>d") == "a\nb\nc"
    assert main_of("<article>1 < 2 and <3 <!-- never ended") == "1 < 2 and <3"
    assert html.blocks("") == [] and html.blocks("<script>x") == []
    assert html.blocks("no markup at all") == [(html.OPEN, "no markup at all")]


def test_suffix_runs_like_brute_force():
    rng = np.random.default_rng(3)
    tokens, page = rng.integers(0, 3, 300), np.sort(rng.integers(0, 9, 300))
    for width in (1, 2, 3, 5, 8):
        order, starts = html.suffix_runs(tokens, page, width)
        at = [i for i in range(301 - width) if page[i] == page[i + width - 1]]
        assert sorted(order) == at
        groups = {tuple(sorted(g)) for g in np.split(order, starts[1:])}
        want = {}
        for i in at:
            want.setdefault(tuple(tokens[i:i + width]), []).append(i)
        assert groups == {tuple(v) for v in want.values()}
        keys = [tuple(tokens[i:i + width]) for i in order]
        assert keys == sorted(keys)


def test_repeats_on_a_host(spark):
    notice = "we put small files on your device to make this site work"
    rows = [(i, f"https://a.org/{i}", f"<div>{notice}</div><div>{' '.join(f'own{i}word{j}' for j in range(9))} {'z' * (i + 1)}</div>") for i in range(6)]
    rows += [(10, "https://b.org/", f"<div>{notice}</div>"), (11, None, None), (12, "x", ""), (13, "https://c.org/1", "<p>the same text on two pages of a host</p>"),
             (14, "https://c.org/2", "<p>the same text on two pages of a host</p>"), (15, "https://A.org:80/q", f"<main><p>{notice}</main><p>own words"),
             (13, "https://c.org/1", "<p>the same text on two pages of a host</p>"), (16, "https://d.org", "<p>once twice " * 9), (16, "https://d.org", "<p>once twice " * 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as Text")
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text"] and got.count() == len(rows)
    text = {r.page_id: r.text for r in got.collect()}
    assert all(text[i].endswith("z" * (i + 1)) and notice not in text[i] for i in range(6))
    assert text[10] == notice and text[11] == text[12] == "" and text[13] == text[14] == "the same text on two pages of a host"
    assert text[15] == f"{notice}\nown words" and text[16] == "\n".join(["once twice"] * 9)


def test_pages_like_brute_force(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}

    def article(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", inside.replace("<br>", " "))
        import html as h
        return "\n".join(x for x in (" ".join(h.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)

    got = html.op4_html(spark, SF).collect()
    assert len(got) == len(pages) and all(r.text == article(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_that_say_what_an_element_has():
    assert main_of("<main class='site-main no-sidebar'><p>a</main>") == "a"
    assert main_of("<article class='post comments-open'><p>a</article>") == main_of("<article class='teaser'><p>a</article>") == "a"
    assert main_of("<main><article id=post-1 class='post teaser'><p>a</article></main>") == "a"
    assert main_of("<article><p>a</p><article class=comment>no</article><div class='comment-list'>no</div></article>") == "a"
    assert main_of("<main>a<div class=comments><article class=comment>no</article></div></main>") == "a"
    assert main_of("<article hidden>no</article><main class=banner style='display:none'>no</main>") == ""
    assert html.blocks("<div class='content has-sidebar'><p>a</p><div class='sidebar left'>no</div><div id='top-ad'>no</div></div>") == [(html.MARKED, t) if t == "no" else (html.OPEN, t) for t in ("a", "no", "no")]


def test_shared_sentences_and_edited_copies_stay(spark):
    """Only whole blocks on a share of the pages go; what a few pages share, and copies of an article, stay."""
    menu = "all the topics of this site from news to weather and sports in one list"
    said = "the minister said on monday that the talks would go on for as long as it takes"

    def words(k, n):
        return " ".join(f"p{k}w{i}" for i in range(n))

    body = {k: [f"{words(k, 30)} {said} {words(-k - 1, 9)}" if k in (1, 2, 3, 4, 5, 6, 7, 8) else words(k, 40), words(1000 + k, 20)] for k in range(40)}
    body[38] = [*body[37][:1], words(1037, 20) + " edited"]  # 79 % and more of the words are those of another page
    body[39] = [*body[37], "a note"]
    rows = [(k, "https://a.org/x", f"<div>{menu}</div>" + "".join(f"<p>{t}</p>" for t in body[k])) for k in body]
    rows += [(k, "https://two.org/x", f"<p>{said}</p><p>{words(k, 9)}</p>") for k in (50, 51)] + [rows[0]] * 5
    rows += [(60 + k, "https://five.org/x", f"<p>{words(60 + k, 9)} {said}</p>" + (f"<p>{words(70, 12)}</p>" if not k else "")) for k in range(5)] + [(60, "https://five.org/x", f"<p>{words(60, 9)} {said}</p><p>{words(70, 12)}</p>")] * 4
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    text = {r.page_id: r.text for r in got.collect()}
    assert all(text[k] == "\n".join(body[k]) for k in body)
    assert text[50] == f"{said}\n{words(50, 9)}" and text[60] == f"{words(60, 9)} {said}\n{words(70, 12)}" and text[64] == f"{words(64, 9)} {said}"


def test_names_that_mention_something_keep_main_text():
    for part in ('<h2 id="search-algorithms">t</h2>', '<section class="related-work"><p>t</p></section>', '<p class="share-price">t</p>', '<h2 id="comment-on-results">t</h2>',
                 '<figure class="widget-image">t</figure>', '<p data-id="ad-3">t</p>', '<p data-hidden="false">t</p>', '<h3 id=comments>t</h3>', '<section id="notice">t</section>',
                 '<p title="a > b" data-class=\'ad\'>t</p>', '<div class="ad-hoc">t</div>', '<div data-role=banner aria-hidden=false>t</div>'):
        assert main_of(f"<article><p>a</p>{part}<p>b</p></article>") == "a\nt\nb", part
    assert main_of('<article><p>one <em title="the hidden cost">two</em> three <a href="/view?id=banner-12">four</a> five</p></article>') == "one two three four five"


def test_names_that_are_boilerplate():
    for name in ("ad", "top-ad", "ads ad-unit", "cookie-notice", "comment-list", "sidebar left", "newsletter_form", "social-share-buttons", "nav__item", "related-links"):
        assert main_of(f"<article><p>a</p><div class='x {name}'><p>no</p></div><p>b</p></article>") == "a\nb", name
    assert main_of("<article>a<section class=comments><p>no</p></section><div id='comments'>no</div></article>") == "a"


def test_marked_inline_text_goes_and_its_block_stays_whole():
    for mark in ("class=ad", "hidden", "style='display:none'", "aria-hidden='true'"):
        assert main_of(f"<article><p>text <span {mark}>Buy <span>now</span></span> more</p><p>next</article>") == "text more\nnext"
        assert main_of(f"<article><p>text <span {mark}>never closed</p><p>next</p></article>") == "text\nnext"
        assert main_of(f"<article><p>text <span {mark}>no<div>no</div>no</span> more</p></article>").replace("\n", " ") == "text more"
    assert main_of("<article>a <span class=ad>no") == "a"
    assert main_of("<article>a <b>b <span class=ad>no <span>no</span> no</span> c</b> d</article>") == "a b c d"


def test_a_page_of_repeats_alone_is_empty(spark):
    menu = "all the topics of this site from news to weather in one list"
    rows = [(i, "https://a.org/x", f"<div>{menu}</div>" + (f"<p>own words of page {i} and more of them</p>" if i else "")) for i in range(8)]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[0] == "" and text[3] == "own words of page 3 and more of them"
