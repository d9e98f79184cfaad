"""op9 keeps what is in the article."""

import pytest

from geoloom.llm.html_text import main_text

LONG = "".join(f"<p>{'word ' * 100}{k}</p>" for k in range(40))


def test_text_after_a_gap_and_links_stay():
    gap = "<nav><p>a</p></nav><nav><p>b</p></nav><nav><p>c</p></nav><nav><p>d</p></nav>"
    page = f"<body><article>{LONG}{gap}<p>the end of it</p></article></body>"
    assert main_text(page).endswith("39\nthe end of it") and "\nd\n" not in main_text(page)
    page = '<main><h2><a href="x">Linked heading</a></h2><p>Some text.</p><ul><li><a href=y>One</a></li></ul></main><p><a href=z>elsewhere</a></p>'
    assert main_text(page) == "Linked heading\nSome text.\nOne"


def test_link_share_is_of_decoded_text():
    page = "<body><p>" + "a" * 20 + " <a href=x>&eacute;&eacute;&eacute;&eacute;   \n   \n</a></p></body>"
    assert main_text(page) == "a" * 20 + " éééé"


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'class="overflow-hidden"', 'class="no-sidebar"', 'class="content has-sidebar"', "class=ad-free", 'class="page-header-fixed"', 'data-id="ad"', 'title="hidden"'])
def test_wrappers_keep_their_text(attributes):
    assert main_text(f"<body><div {attributes}><article><p>Text here.</p></article></div></body>") == "Text here."
    assert main_text(f"<body><div {attributes}><p>Text here.</p></div></body>") == "Text here."


def test_marks():
    assert main_text('<body><h2 class="section-header">Head</h2><p>Text</p></body>') == "Head\nText"
    assert main_text('<div class="sidebar"><p>x</p><article><p>Text</p></article><p>y</p></div>') == "Text"
    for gone in ("hidden", "aria-hidden=true", 'style="color:red; display: none"', 'class="x sidebar"', "id=site-footer", 'class="related-posts"', "role=banner", 'class="cookie-notice"'):
        assert main_text(f"<body><p>Text</p><div {gone}><p>gone</p></div></body>") == "Text"
