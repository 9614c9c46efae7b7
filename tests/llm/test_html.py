"""Hand-written pages: half of them and more have no article element, so the score decides."""

import pytest

from kindred.llm.html_text import extracted, main_text

A = "The river rose in the night, and by morning the lower road was under water."
B = "Farmers moved their herds to the hills, while volunteers, some of them children, filled sandbags."
C = "Nobody was hurt, the mayor said, but the bridge will stay closed for a month."
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A}\n\n{B}\n\n{C}"
LONG_AD = "<p>" + "Buy two, get one free, this week only, in all our shops. " * 8 + "</p>"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/w>Weather</a></li></ul>"

PAGES = {
    # without an article element
    "plain div": (f"<body><div>{P}</div></body>", TEXT),
    "short main beside a longer advert": (f'<body><div id="main"><p>{A}</p></div><div class="promotion-story">{LONG_AD}</div></body>', A),
    "menu as a bare list": (f"<body><div>{MENU}</div><div>{P}</div></body>", TEXT),
    "menu in the same container": (f"<body><div>{MENU}{P}</div></body>", TEXT),
    "sidebar by class": (f'<body><div class="content">{P}</div><div class="sidebar"><h3>Most read</h3><p>{LONG_AD}</p></div></body>', TEXT),
    "comments by id": (f'<body><div class="post">{P}<div id="comments"><p>Great piece, thanks, really, all of you.</p></div></div></body>', TEXT),
    "comments longer than the text": (f'<body><div class="post"><p>{A}</p></div><div class="comments-area">{"<p>Well, I see, so it goes, they say, again.</p>" * 9}</div></body>', A),
    "table layout": (f'<table><tr><td class="nav">{MENU}</td><td>{P}</td></tr></table>', TEXT),
    "two columns of the article": (f"<body><div><div><p>{A}</p><p>{B}</p></div><div><p>{B}</p><p>{C}</p></div></div></body>", f"{A}\n\n{B}\n\n{B}\n\n{C}"),
    "share bar with a good word beside": (f'<body><div>{P}<section class="share text"><p>Tell your friends about this page.</p></section></div></body>', TEXT),
    "cookie notice": (f'<body><div class="cookie-notice"><p>We use cookies, as all do, to serve you better.</p></div><div>{P}</div></body>', TEXT),
    "form and button": (f"<body><div>{P}<form><label>Your mail</label><input><button>Send</button></form></div></body>", TEXT),
    "unclosed paragraphs": (f"<body><div><p>{A}<p>{B}<p>{C}</div>", TEXT),
    "entities and breaks": ("<div><p>Salt &amp; pepper,&nbsp;oil<br>and&#32;vinegar &#x2014; that is all, really, you need.</p></div>", "Salt & pepper, oil and vinegar — that is all, really, you need."),
    "nested wrappers": (f"<body>{'<div>' * 40}{P}{'</div>' * 40}</body>", TEXT),
    # with one
    "article with header and footer": (f"<body><header>Site</header><article><h1>Flood</h1>{P}</article><footer>(c)</footer></body>", f"Flood\n\n{TEXT}"),
    "list of links in the article": (f"<body><nav>{MENU}</nav><article>{P}{MENU}</article></body>", f"{TEXT}\n\nHome\n\nNews\n\nSport\n\nWeather"),
    "related work is no related box": (f'<body><article>{P}<div class="related-work"><p>{A}</p></div></article></body>', f"{TEXT}\n\n{A}"),
    "related box": (f'<body><article>{P}<div class="related"><p>{B}</p></div></article></body>', TEXT),
    "aside in the article": (f"<body><main><article>{P}<aside>By the way</aside></article></main></body>", TEXT),
    "several articles, the teasers small": (f'<body><main><article>{P}</article></main><div class="sidebar"><article><p>Teaser one</p></article><article><p>Teaser two</p></article></div></body>', TEXT),
    "script and style": (f"<body><article><script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style>{P}</article></body>", TEXT),
}

PAGES |= {
    "apostrophe in an unquoted value": (f"<body>{P}<p><a href=/o'brien>x</a> {A}</p>{P}</body>", f"{TEXT}\n\nx {A}\n\n{TEXT}"),
    "quotes in and around values": (f"""<body><article data-a = "1 > 0" data-b='"' title=5"6>{P}<p class=a"b data-c='>'>{A}</p></article></body>""", f"{TEXT}\n\n{A}"),
}


def test_commas_of_other_scripts_count():
    """Two like blocks of one length: that with commas of its own script wins."""
    for comma in ",\uff0c\u3001\u060c":
        rows, plain = f"<div><p>{('字' * 9 + comma) * 12}</p></div>", f"<div><p>{'字' * 120}</p></div>"
        assert main_text(f"<body><section>{plain}</section><section>{rows}</section></body>").startswith("字" * 9 + comma)


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_hard_rows(spark):
    deep = "<div>" * 20_000 + P + "</div>" * 20_000
    long = "<body><article>" + P * 3000 + "</article></body>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", P, "x"), (3, "u", P, "x"), (3, "u", P, "x"), (4, "u", deep, "x"), (5, "u", long, "x"), (6, "u", "<", "x"), (7, "u", "<div><<<", "x")]
    out = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == sorted([(1, 0), (2, 0), (0, len(TEXT)), (3, len(TEXT)), (3, len(TEXT)), (4, len(TEXT)), (5, 3000 * len(TEXT) + 2999 * 2), (6, 1), (7, 3)])
    assert all(r.n_chars == len(r.text) for r in out)
