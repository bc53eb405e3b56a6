import html as entities
import re

import pytest

from patchsieve.llm.html import extracted, main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><h1>Site name</h1><p>The slogan, of this site, is quite long, and it has commas, many of them.</p></header>
<div id="wrap"><div class="cookieBanner"><p>We use cookies, and more cookies, to make this better, for you and all.</p></div>
<div class="content"><h2>Head</h2><p>One first paragraph, with some words, and commas; it is long enough to count as prose.
<p>Second <a href=x>link</a> paragraph&nbsp;&amp; more,
   more text here, that is long.<br>After a break.<ul><li>a point</li><li>b <b>bold</b> point</li></ul>
<form><p>Sign up here, now, it is free, and more words to be long enough.</p></form><blockquote>Quoted text, with words.</blockquote>
<script>var t = "</p><p>not text, at all, never, no";</script><!-- <p>nor, this, one</p> --></div>
<div class="sidebar"><p>Some other text, not for you, in the side bar, which is long, longer, longest.</p></div>
<section id="comments"><p>Great post, thank you, I liked it very much, and will be back, soon.</p></section></div><footer>foot</footer></body></html>"""


def test_furniture_goes_and_prose_stays():
    assert main_text(PAGE) == "\n".join([
        "Head", "One first paragraph, with some words, and commas; it is long enough to count as prose.",
        "Second link paragraph & more, more text here, that is long. After a break.", "a point", "b bold point", "Quoted text, with words."])


def test_siblings_of_the_best_container_stay():
    section = "<section><p>{0} words, and words, of this part, that are long enough to be prose, as they go on.</p></section>"
    got = main_text(f"<body><div>{''.join(section.format(n) for n in ('One', 'Two', 'Three'))}</div><div class=menu><a href=a>x</a></div></body>")
    assert [line.split()[0] for line in got.split("\n")] == ["One", "Two", "Three"]


PROSE = "<p>One paragraph of the text, with some words, and commas; it is long enough to count as prose.</p>"
WORDS = re.sub("<[^>]+>", "", PROSE)


@pytest.mark.parametrize("page, text", [
    (f"<body><form id=aspnetForm><input type=hidden><nav>n</nav><article><h1>T</h1>{PROSE}</article><button>Go</button></form>", f"T\n{WORDS}"),
    (f"<body><form id=f><div><label>Name <span>of</span> you</label><select><option>x</select>{PROSE}</div></form>", WORDS),
    (f"<body><main><form><h2>A</h2>{PROSE}{PROSE}</form></main>", f"A\n{WORDS}\n{WORDS}"),
    (f"<body><form><h1>T</h1><p>Short.</p></form><div>{PROSE}</div><fieldset><legend>Sign</legend>up here</fieldset>", None),
    (f"<body><article>{PROSE}</article><form>{PROSE * 3}</form><aside>{PROSE * 3}</aside>", WORDS),
    (f"<article>{PROSE * 3}<aside>{PROSE}</aside><form><h1>Join</h1><label for=a>Mail</label></form></article>", None),
])
def test_forms_are_decided_on_by_what_they_hold(page, text):
    got = main_text(page)
    assert got == text if text else "up here" not in got and "Mail" not in got and WORDS in got


B = "<h2>B</h2><p>Some sixty letters of text that end a page, in one short line.</p>"
END = "B\nSome sixty letters of text that end a page, in one short line."


@pytest.mark.parametrize("page, text", [
    (f"<main><section>{PROSE * 6}</section><section>{B}</section></main>", "\n".join([WORDS] * 6 + [END])),
    (f"<div><section>{PROSE * 6}</section><section>{B}</section></div>", "\n".join([WORDS] * 6 + [END])),
    (f"<body><main><h1>Title</h1><div>{PROSE * 12}</div></main>", "\n".join(["Title"] + [WORDS] * 12)),
    (f"<body><div><h1>Title</h1><p>Lead.</p><div>{PROSE * 3}</div></div>", "\n".join(["Title", "Lead."] + [WORDS] * 3)),
    (f"<body><h1>Title</h1><main>{PROSE * 3}</main><p><a href=x>More</a></p>", "\n".join(["Title"] + [WORDS] * 3)),
    (f"<body><h1>Site</h1><p>Slogan.</p><article><h1>Title</h1>{PROSE}</article>", f"Title\n{WORDS}"),
    (f"<body><div class=c>{PROSE * 3}</div><h2>Mid</h2><div>Note.</div><div><a href=x>Out</a></div><div class=c>{PROSE * 3}</div>",
     "\n".join([WORDS] * 3 + ["Mid", "Note."] + [WORDS] * 3)),
])
def test_headings_and_short_parts_beside_the_prose_stay(page, text):
    assert main_text(page) == text


LINKS = "".join(f"<li><a href=x{n}>Author {n}, a title of a work, year</a></li>" for n in range(4))
LINKED = "\n".join(f"Author {n}, a title of a work, year" for n in range(4))
OWN = "<h2>Part</h2><p>What this part says, in prose, with no links at all, and long enough to be read.</p>"
OWN_TEXT = "Part\nWhat this part says, in prose, with no links at all, and long enough to be read."


@pytest.mark.parametrize("names", [
    "id=recommendations", "id=multimodal-results", "class=commentary", "id=related-work", "id=social-history", "id=promotion",
    "class=notice-period", "class=overlaying-strata", 'class="section menu"', "id=advice", "class=adaptation", "id=navigation-by-stars", "class=tagsoup"])
def test_sections_of_an_article_stay_whatever_their_names_contain(names):
    assert main_text(f"<body><nav>n</nav><article>{PROSE * 2}<section {names}>{OWN}</section>{PROSE}</article>") == "\n".join([WORDS] * 2 + [OWN_TEXT, WORDS])


def test_a_list_of_references_stays():
    assert main_text(f"<article>{PROSE}<h2>References</h2><ol>{LINKS}</ol></article>") == f"{WORDS}\nReferences\n{LINKED}"


@pytest.mark.parametrize("part", [
    "<div class=ad><p>Buy this now, it is the best, and cheap, and everyone has one.</p></div>", f"<section id=comments>{OWN}</section>", f"<ul class=menu>{LINKS}</ul>",
    f"<div class=related-posts><h3>More</h3><ul>{LINKS}</ul></div>", "<div class=newsletter><h3>Join</h3><p>Our letter comes weekly, and is free, and short.</p><input></div>",
    "<div id=cookieNotice><h3>Cookies</h3><p>We use cookies, and more of them, to make this better.</p></div>", f"<div class=topnav>{PROSE}</div>", f"<div class='sidebar left'>{PROSE}</div>",
    "<div class=promotions><h3>Deals</h3><p>Give us your name, and your mail, for a deal of the day.</p><input></div>", "<div class=social-share><a href=x>Tell others</a></div>",
    f"<div class=comment-list>{PROSE}</div>", "<div class=notice><p>This page has moved, and will be gone, in a short time.</p></div>", "<div class=breadcrumbs><a>a</a> &gt; b</div>"])
@pytest.mark.parametrize("page", ["<body><article>{prose}{part}</article>", "<body><main>{prose}{part}</main>", "<body>{part}<div>{prose}</div>"])
def test_menus_comments_and_adverts_go(part, page):
    assert main_text(page.format(prose=PROSE * 4, part=part)) == "\n".join([WORDS] * 4)


@pytest.mark.parametrize("inner, text", [
    ("where <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> holds", "where x+1 holds"),
    ("press <button>Go</button> and wait", "press Go and wait"), ("the <label>name</label> of it", "the name of it"),
])
def test_formulas_and_labels_in_a_sentence_stay(inner, text):
    assert main_text(f"<article>{PROSE}<p>And so, {inner}, as they say.</p></article>") == f"{WORDS}\nAnd so, {text}, as they say."


@pytest.mark.parametrize("page, text", [
    ("", ""), (" \n", ""), ("plain text, no markup", "plain text, no markup"), ("<p>cut <b", "cut"), ("a &am", "a &am"), ("<article></article>", ""),
    ("<script>x", ""), ("<!-- x", ""), ("</p></div>", ""), ("<article><h1>T</h1><p>Short.</article><div class=ad>A far longer text, with commas, that is an advert.</div>", "T\nShort."),
])
def test_small_and_broken_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<div>", "<p>", "<span class=x>", "<a ", "<!--", "<a \">", "</b>", "<li>", "<center><p>a"])
def test_long_broken_pages_end(part):
    assert len(main_text(part * 30_000)) <= 30_000 * len(part)


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extracted(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        lines = (" ".join(entities.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body))
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "x", "y"), (None, None, "<p>a</p>", None, None), (1, "u", None, "x", "y"), (2, "v", "", None, None)]
    got = extracted(spark.createDataFrame(rows, schema))
    assert sorted(map(str, got.collect())) == sorted(
        ["Row(page_id=1, url='u', text='', n_chars=0)"] * 2 + ["Row(page_id=None, url=None, text='a', n_chars=1)", "Row(page_id=2, url='v', text='', n_chars=0)"])
    assert extracted(spark.createDataFrame([], schema)).count() == 0
