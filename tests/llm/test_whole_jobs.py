"""What operators once left out."""

from collections import Counter

import pytest

from tallyspark.llm import html_text, langid


def test_language_id_learns_from_1500_rows(spark, monkeypatch):
    rows = [(i, f"w{i} the words", "en" if i < 2600 else "fr") for i in range(2700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "learn", lambda texts, langs: Counter(langs))
    usable = docs.filter(~langid.held_out()).groupBy("lang").count().collect()
    assert langid.fit(docs) == {r["lang"]: min(r["count"], 1500) for r in usable}
    assert max(r["count"] for r in usable) > 1500


ENGLISH = "This is the text of the page that is for all of you to read and not to miss. " * 4
POLISH = "Wczoraj wieczorem mieszkańcy naszego miasta spotkali się przed ratuszem, aby porozmawiać o planach budowy mostu na rzece. " * 3
CHINESE = "昨天晚上，市民们聚集在市政厅前，讨论在河上修建新桥的计划。市长表示，工程将于明年春天开始，预计需要两年时间。" * 2


@pytest.mark.parametrize("text", [POLISH, CHINESE])
def test_html_of_other_languages(text):
    links = "<p>" + '<a href="/x">Odnośnik do innej strony serwisu</a> ' * 6 + "</p>"
    page = f"<html><body><div class='menu'>Menu</div>{links}<p>{text}</p><p>{text}</p></body></html>"
    assert html_text.main_text(page) == f"{text.strip()} {text.strip()}"


def test_html_needs_stop_words_where_the_language_is_known():
    codes = "AX-100 BX-200 CX-300 DX-400 EX-500 FX-600 GX-700 HX-800 IX-900 " * 5
    assert html_text.main_text(f"<body><p>{ENGLISH}</p><p>{codes}</p></body>") == ENGLISH.strip()


@pytest.mark.parametrize("names", ["layout with-sidebar", "site-content no-sidebar", "page-with-header", "elementor-widget", "elementor-widget-container"])
@pytest.mark.parametrize("tag", ["article", "main", "p"])
def test_html_wrappers(names, tag):
    assert html_text.main_text(f"<body><div class='{names}'><{tag}>{ENGLISH}</{tag}></div></body>") == ENGLISH.strip()


@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_article_in_a_layout_part(tag):
    assert html_text.main_text(f"<body><div id='layout-sidebar-right'><div class='x'><{tag}><p>{ENGLISH}</p></{tag}></div></div></body>") == ENGLISH.strip()


def test_html_boilerplate_is_still_refused():
    short = "This is one of the notes that are by the side of it and not to be read."
    comments = f"<div id='comments'><article class='comment-body'><p>{ENGLISH}</p><p>{ENGLISH}</p></article></div>"
    cards = f"<div class='left-sidebar'><article><p>{short}</p></article></div><div class='related'><article><p>{ENGLISH * 3}</p></article></div>"
    for name in ("sidebar", "elementor-widget-nav-menu", "widget-area"):
        page = f"<body><div class='c'><p>{ENGLISH}</p></div><div class='{name}'><p>{short * 3}</p></div>{comments}{cards}</body>"
        assert html_text.main_text(page) == ENGLISH.strip(), name


LONG = "This is a part of the text of the page that is for all of you to read, and it was written by one of us for the other ones. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><p title=it's>{LONG}</p><p>{LONG}</p></body>", f"{LONG.strip()} {LONG.strip()}"),
        (f"<body><!--><p>{LONG}</p><!---><p>{LONG}</p><!-- a --!><p>{LONG}</p></body>", " ".join([LONG.strip()] * 3)),
        (f"<body><form action=x><article><p>{LONG}</p><input name=q></article></form></body>", LONG.strip()),
        (f"<body><form action=x><div><p>{LONG}</p><select><option>one</select></div></form></body>", LONG.strip()),
        (f"<body><div class='content share'><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><div class='post-content subscribe'><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><div class='blue share'><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><p>{LONG}</p><div class='row footer'><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><article><p>{LONG}</p></article><section class='talk'>{f'<p>{LONG}</p>' * 9}</section></body>", LONG.strip()),
        (f"<body><article><p>{LONG}</p></article><section class='discussion'>{f'<p>{LONG}</p>' * 9}</section></body>", LONG.strip()),
        (f"<body><p>{LONG}</p><div class='user-comments'><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><p><a href=http://x/>{LONG}</a></p><p>{LONG}</p></body>", LONG.strip()),
        (f"<body>{f'<article><p>{LONG}</p></article>' * 3}<div><p>One text.</p><p>{LONG}x</p><p>{LONG}y</p></div></body>", f"One text. {LONG}x {LONG}y"),
        (f"<body>{f'<article><p>{LONG}</p><p>{LONG}</p></article>' * 2}<p>{LONG}x</p><p>{LONG}y</p></body>", " ".join([LONG.strip()] * 4)),
        (f'<body><p data-x = "a>b" title=\'c>d\' x=1>{LONG}</p></body>', LONG.strip()),
    ],
)
def test_html_pages_that_were_lost(page, text):
    assert html_text.main_text(page) == text
