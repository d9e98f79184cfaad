"""op9's line-block distribution: pages without marks or containers, inline markup, and a brute-force window scan."""

import numpy as np
import pytest

from geoloom.llm import html_text
from geoloom.llm.html_text import lines_of, main_text, weights_of, window_sums

PROSE = "Long text of words, " * 30 + "and an end."


@pytest.mark.parametrize(("page", "want"), [
    (f"<body><p>{PROSE}</p><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>The closing sentence of the article.</p></body>", f"{PROSE}\nThe closing sentence of the article."),
    ("<p>First <i>best</i> thing of <b>all</b> days.</p>", "First best thing of all days."),
    (f"<div>Home</div><div>About us</div><div>Contact</div><div>{PROSE}</div><div>Copyright</div>", PROSE),
    ('<article><h2 id="search">Search engines</h2><p class="side">Para one text here.</p></article>', "Search engines\nPara one text here."),
    ("<article><p>Text.</p><ul><li><a href=x>One</a></li></ul></article>", "Text.\nOne"),
    (f"<div>Menu</div><div><a href=1>One link here.</a></div><div>{PROSE}</div><div>Yes.</div><div>No!</div><div>{PROSE}</div><div>x</div><div>y</div><div>z</div><div>Lone words</div>", f"{PROSE}\nYes.\nNo!\n{PROSE}"),
    ("<article><header><h1>The title</h1><div>By somebody</div></header><p>Text.</p><footer>Filed</footer></article>", "The title\nText."),
    ('<div class="ad"><p>Buy<b>now<p>more</div><article><p>Text<p>of two</article>', "Text\nof two"),
    ("<p>" + "w " * 300000 + "</p>", ("w " * 300000).strip()),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_windows_against_a_scan():
    rng = np.random.default_rng(8)
    for _ in range(200):
        words = ["x" * int(n) for n in rng.integers(1, 40, rng.integers(1, 15))]
        page = "".join(f"<div>{w}{'.' if rng.random() < 0.4 else ''}</div>" for w in words)
        lines = lines_of(page)
        weights, threshold = weights_of(lines, 0.25)
        n = len(lines)
        sums = [sum(weights[k] for k in range(n) if abs(k - i) <= 1) for i in range(n)]
        assert window_sums(weights, 3) == sums
        alive = [weights[i] > 0 or sums[i] >= threshold for i in range(n)]
        keep = set()
        for i in range(n):  # a line is kept if lines with weight lie on both sides (or it has some) in a stretch that surges
            a, b = i, i
            while a >= 0 and alive[a]:
                a -= 1
            while b < n and alive[b]:
                b += 1
            if alive[i] and any(sums[k] >= threshold for k in range(a + 1, b)) and any(weights[a + 1 : i + 1]) and any(weights[i:b]):
                keep.add(i)
        assert main_text(page) == "\n".join(lines[i].text for i in sorted(keep))


def test_tables(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "y"), (2, "v", "<p>One.</p>", "z"), (2, "v", "<p>One.</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(map(tuple, got.collect()), key=str) == [(1, None, "", 0), (2, "v", "One.", 4), (2, "v", "One.", 4), (None, "u", "", 0)]
    assert html_text.extract_text(pages.where("false")).count() == 0
