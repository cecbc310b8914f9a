"""Main text of everyday layouts, written by hand: frames, classes and ids that the made-up pages of the training do not have."""

from __future__ import annotations

import re

import pytest

from vellumine.llm import html_text

TITLE = "The bridge at dawn"
FIRST = "The river rose early this year, and the town watched it from the bridge. Nobody spoke of the flood."
SECOND = "Two men walked home along the bank. They had nothing to say, and it was late."
THIRD = "By noon the water stood at the door of the mill, where the miller had put out bags of sand the night before."
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sports</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2021 The Paper. All rights reserved.</p></footer>"
MORE = "<aside class=sidebar><h3>More</h3><ul><li><a href=/c>Other story</a></li><li><a href=/d>Third</a></li></ul></aside>"
SAID = "<div class=comments><h3>Comments</h3><div class=comment><p>I was there, it was worse.</p></div><div class=comment><p>First!</p></div></div>"

#: Frames around an article, by name; M, F, S and C stand for menu, footer, sidebar and comments, @ for the article.
FRAMES = {
    "page-wide form": "<form>M<div class=content>@</div>F</form>",
    "form with action": "<form action=/x method=post>M<article>@</article>F</form>",
    "form of a framework": "<form id=aspnetForm><div id=main><div class=article>@</div></div>F</form>",
    "form alone": "<form>@</form>",
    "fieldset": "<fieldset>@</fieldset>",
    "has-sidebar": "M<div class='layout has-sidebar'><article class=post>@</article>S</div>F",
    "sidebar-left page": "M<div class='sidebar-left page'><main>@</main>S</div>F",
    "has-comments": "M<div class='post has-comments'>@</div>CF",
    "modal page": "<div id=modal-page>M<article>@</article>F</div>",
    "popular story": "M<article class='popular story'>@</article>F",
    "archive": "M<section class=archive>@</section>F",
    "body of many names": "<body class='single has-banner with-widgets no-sidebar'>M<div class=entry>@</div>F</body>",
    "form in a form's names": "<form name=frm id=Form1 onsubmit='return ok()'><table width=100%><tr><td>M</td></tr><tr><td>@</td></tr></table>F</form>",
    "form around main": "M<main><form id=mainForm action='/p?x=1'><div class=rte>@</div></form></main>F",
    "blog": "<body class='post-template single-post has-sidebar with-comments'><div class=hfeed>M<div class=site-inner><div class=content-sidebar-wrap><main class=content><article class='post type-post hentry category-news'>@</article></main>S</div></div>CF</div></body>",
    "portal": "<div id=page-wrapper><div id=page>M<div id=main-wrapper><div id=main class=clearfix><div id=content class=column><div class=section><div class=region-content>@</div></div></div></div></div>F</div></div>",
    "grid": "<div class='container-fluid'><div class=row><div class='col-md-8'>@</div><div class='col-md-4'>S</div></div></div>F",
    "with-aside": "M<div class='with-aside two-cols'><div class=col1>@</div><div class=col2>S</div></div>F",
    "no names": "M<div><div><div>@</div></div></div>F",
    "German": "<div class=seite>M<div id=inhalt class='mit-seitenleiste'><div class=beitrag>@</div></div>F</div>",
    "French": "<div id=conteneur>M<div class='contenu avec-barre'>@</div>F</div>",
    "no-comments": "M<section class='entry no-comments no-share'>@</section>F",
    "wiki": "<div id=globalWrapper><div id=column-content><div id=content class=mw-body role=main><div id=bodyContent><div class=mw-content-ltr>@</div></div></div></div>F</div>",
    "newsroom": "<div id=app><div class='css-1a2b3c'>M<main id=site-content><article id=story class='css-x9'><section name=articleBody><div class='css-53u6y8'>@</div></section></article></main>F</div></div>",
    "print": "<center><table cellpadding=0><tbody><tr><td valign=top>@</td></tr></tbody></table></center>",
    "with-header": "<div class='with-header with-footer'>M<div class=text>@</div>F</div>",
    "has-ads": "M<div class='has-ads has-cookie-banner'><article>@</article></div>F",
    "show-notice": "<div class='show-notice show-menu'>M<main>@</main>F</div>",
    "documentation": "<div class='document'><div class=documentwrapper><div class=bodywrapper><div class=body role=main>@</div></div></div></div>F",
}
BODIES = {
    "heading": (f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p>", f"{TITLE} {FIRST} {SECOND}"),
    "paragraphs": (f"<p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p>", f"{FIRST} {SECOND} {THIRD}"),
    "list": (f"<h2>{TITLE}</h2><p>{FIRST}</p><ul><li>{SECOND}</li><li>{THIRD}</li></ul>", f"{TITLE} {FIRST} {SECOND} {THIRD}"),
}


def page(frame: str, body: str) -> str:
    parts = {"M": MENU, "F": FOOT, "S": MORE, "C": SAID, "@": body}
    between = re.sub(r"<[^>]*>|[MFSC@]", lambda m: parts.get(m[0], m[0]), frame)
    return f"<!DOCTYPE html><html><head><title>{TITLE}</title></head>{between}</html>"


@pytest.mark.parametrize("frame", FRAMES)
def test_layout_is_read_whole(frame):
    for body, want in BODIES.values():
        assert html_text.trained().texts([page(FRAMES[frame], body)]) == [want]


def test_names_that_tell_of_something_besides():
    """has-sidebar is no sidebar; sidebar is."""
    side, none = html_text.groups_of(" class='sidebar'"), html_text.groups_of(" class='has-sidebar withComments no-ads'")
    assert none == 0 and side
    assert html_text.groups_of(" class='has-sidebar comments'") == html_text.groups_of(" class=comments")


def test_pages_without_an_article_stay_empty():
    """The second reading takes no menu, notice, comment or footer for the text."""
    for text in (MENU + FOOT, MENU, FOOT, SAID + FOOT, f"{MENU}<div class=cookie-notice><p>We use cookies.</p><p>They are small files, and you may refuse them.</p></div>{FOOT}", "<div class=ads><p>Buy now.</p><p>Cheap, and only today!</p></div>"):
        assert html_text.trained().texts([text]) == [""]


def test_a_page_is_read_alike_alone_and_among_others():
    pages = [page(f, b) for f in FRAMES.values() for b, _ in BODIES.values()] + [None, "", MENU]
    assert html_text.trained().texts(pages) == [html_text.trained().texts([p])[0] for p in pages]
