"""Main text: ordinary class names, decoys, and the host vote against pages whose true article is known."""

import random

import pytest

from meridia.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, host string, salt int, winners string"


def test_ordinary_names_lose_no_article():
    for page, want in [
        ('<div class="main has-sidebar"><p>Some long article here.</p></div>', "Some long article here."),
        ("<form id=f1><div><p>Article text</p></div></form>", "Article text"),
        ('<article class="post share-enabled"><p>hello</p></article>', "hello"),
        ('<body class="widget cookies"><div class="sidebar-left wrap"><article><p>one</p></article></div></body>', "one"),
        ("<p it's>lost text</p><p>don't go</p>", "lost text\ndon't go"),
        ('<p title="a > b">x</p><p title=\'"\'>y</p>', "x\ny"),
        ("<p>a&nbsp;&nbsp;b\t\n c &amp;lt; &eacute;</p>", "a\xa0\xa0b c &lt; é"),
        ('<body><h1>Title</h1><div class="c"><p>long text of the article</p></div><p>tail</p></body>', "Title\nlong text of the article"),
        ("<nav><ul><li><a href=x>a</a></ul></nav>", ""),
        ("", ""),
    ]:
        assert H.main_text(page) == want
    assert len(H.main_text("<div>" * 20000 + "<p>deep")) == 4


def test_furniture_below_the_article():
    page = (
        '<article><div class="share-buttons">share it</div><ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul>'
        '<div class="entry-header"><h1>Head</h1></div><p>text of it <span class="ad">buy <span>now</span></span>goes on</p>'
        "<form><label>mail</label><input><input><button>send</button> join us</form><aside>aside</aside>"
        '<section id="comments"><article class="comment-body"><p>I liked it very much indeed, more than the text</p></article></section></article>'
    )
    assert H.main_text(page) == "Head\ntext of it goes on"


WORDS = "stone river window paper candle garden summer letter silver mountain harbour winter".split()


def made(rnd, host, i):
    """(html, article): the article in the host's own container, among decoys of any length."""
    line = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    blocks = [line(6) + f" {i}", *(line(rnd.randint(3, 60)) for _ in range(rnd.randint(1, 5)))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    box = ["div class='post-{} entry'", "div class='main has-sidebar'", "article class='share-enabled'", "section id='story'"][host % 4].format(i)
    tag = box.split()[0]
    side = f"<div class='c{i} extra'>" + "".join(f"<p>{line(rnd.randint(1, 80))}</p>" for _ in range(rnd.randint(0, 3))) + "</div>"  # unmarked
    parts = [side, f"<{box}>{body}<div class='ad-slot'>{line(4)}</div></{tag}>"]
    rnd.shuffle(parts)
    inner = "".join(parts)
    if host % 2:
        inner = f"<form id='aspnet'><input type=hidden>{inner}</form>"
    return f"<html><body><nav>{line(5)}</nav>{inner}<div class='footer'>{line(9)}</div></body></html>", "\n".join(blocks)


def test_vote_decides_among_decoys(spark):
    rnd, rows, want = random.Random(3), [], {}
    for i in range(400):
        host = i % 4 if i % 3 else 0
        page, want[i] = made(rnd, host, i)
        rows.append((i, f"https://h{host}.example/{i}", page, "x", "y", 1, "z"))
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    alone = {r[0]: H.main_text(r[2]) for r in rows}
    changed = [i for i in want if alone[i] != want[i]]
    assert len(changed) > 20  # pages that only the vote of their host gets right
    paths = H.winners(spark.createDataFrame([(r[1].split("/")[2], r[2]) for r in rows], "host string, html string")).collect()
    assert {p["host"]: p["winners"][0] for p in paths} == {
        "h0.example": ">body>div.entry.post-#", "h1.example": ">body>form@aspnet>div.has-sidebar.main", "h2.example": ">body>article.share-enabled", "h3.example": ">body>form@aspnet>section@story",
    }


def test_vote_leaves_out_blocks_of_plain_pages(spark):
    page = "<body><nav>menu of it</nav><div class='x'>advert here</div><article><h1>T{0}</h1><p>text {0}</p></article><footer>foot</footer></body>"
    p = H.Page(page.format(1))
    inside = [b for b in p.blocks if p.path_of(b[0]).startswith(">body>article")]
    assert len(p.blocks) == 5 and len(inside) == 2 and H.main_text(page.format(1)) == "T1\ntext 1"


@pytest.mark.parametrize("few", [True, False])
def test_rows_of_all_kinds(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(H, "sized", lambda df: df)
    rows = [(1, None, "<p>a</p>", None, None, None, None), (1, "http://H.example/x", "<p>b</p>", "t", "h", 0, "w"), (2, "no url", None, None, None, None, None), (None, "http://h.example", "", None, None, None, None)]
    rows += [(3, "http://h.example/3", "<article><p>" + "long " * 100000 + "</p></article>", None, None, None, None)] * 2
    out = H.extract(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in out.collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 499999), (3, 499999)]
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0
