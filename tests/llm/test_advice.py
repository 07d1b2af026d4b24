"""Cases of the first review in which an operator did less than the whole job."""

import random

from meridia.llm import html_extract
from meridia.llm.suffix_dedup import SuffixDedup
from meridia.llm.support import components


def test_components_on_long_chains(spark):
    ids = list(range(2000, 2400))
    random.Random(5).shuffle(ids)
    valley = [0, *range(1100, 999, -1)]  # labels that fall towards a local least id
    edges = [e for path in (valley, ids) for e in zip(path, path[1:])]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in valley} | {i: 2000 for i in ids}


def test_suffix_dedup_keeps_contexts_whose_half_hashes_collide(spark):
    phrase = "a phrase of 24 byte02019"
    pairs = [
        ("nntbosdqqqzhypkrexqbjsifmd", "evxtsonynskwnplveazoptupugozjkomlgfmfjhzauvdhnksij", "ughyhzwqwjruekjahdpnhhaolc", "swcwluvdrvckqaygdzmqfgebpykhdhwljynmotlwgnniykojqk"),
        ("aqrxejgnvpmgbevodstkqwxejo", "uicqfrmknkojjwpfjpqwszgeclpbsewracukxhdypikyyuvnja", "itntepuerqjatidxudvmplivwt", "viwhzcpgyeqrcosjsfwpwhgxwmswbzbdrehiertugxbvksrbci"),
    ]
    rows = [(2 * i + j, p[2 * j] + phrase + p[2 * j + 1]) for i, p in enumerate(pairs) for j in (0, 1)]
    for parts in (1, 4):  # ties inside a batch, and over a bucket
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(parts, "doc_id")
        assert [r["n_removed"] for r in SuffixDedup().digest(docs).collect()] == [0] * len(rows)


def test_html_keeps_title_and_intro_above_nested_sections(spark):
    parts = "<h1>{0} title</h1><p>{0} intro of this page</p>" + "<section class='s1'>" + "long part " * 30 + "</section>" + "<section class='s2'>" + "more text " * 30 + "</section>"
    for tag in ("article", "main", "div class='post'"):
        page = f"<body><nav>menu</nav><div class='side'>other</div><{tag}>{parts}</{tag.split()[0]}></body>"
        rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(4)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        for r in html_extract.extract(pages).collect():
            i = r["page_id"]
            assert r["text"].split("\n")[:2] == [f"{i} title", f"{i} intro of this page"]
            assert "other" not in r["text"] and r["text"].count("\n") == 3
