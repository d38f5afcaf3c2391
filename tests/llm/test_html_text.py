import pytest

from gridloom.llm import html_text
from tests.conftest import SMALL
from tests.llm.samples import prose

LONG = "This sentence, written for a test, is long enough to read like prose, and has commas."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("just words", "just words"), ("<p></p>", ""),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}</p></article><footer>{LONG}</footer>", f"T {LONG}"),
        (f"<div class='sidebar'><p>{LONG} {LONG}</p></div><div id=main><p>{LONG}<p>{LONG}</div>", f"{LONG} {LONG}"),
        (f"<body><div><p>{LONG}</p><div class=comments><p>{LONG}</p></div></div>", LONG),
        (f"<div><p>{LONG}</p><form><p>{LONG}</p></form><script>var a='<p>no</p>'</script><style>p{{}}</style></div>", LONG),
        (f"<div><a href=1>{LONG}</a> <a href=2>{LONG}</a></div><div><p>{LONG}</p></div>", LONG),
        (f"<div role=navigation>{LONG}</div><div><p>{LONG}</p></div><div style='display: none'><p>{LONG}</p></div>", LONG),
        ("<article><p>a &amp;amp; b&nbsp;&lt;c&gt; &#233;&#x41;</p></article>", "a &amp; b <c> éA"),
        ("<article><p>one<b>two</b> three<br>four\n\n  five</p><p> six</p></article>", "onetwo three four five six"),
        (f"<article><p>{LONG}<!-- <p>hidden</p> --><p>{LONG}<!-- open", f"{LONG} {LONG}"),
        ("<article><p>a < b and <3 you</p><p title='x > y'>c</p></article>", "a < b and <3 you c"),
        (f"<ul><li>x<li>y</ul><article><ul><li>{LONG}<li>second</ul></article>", f"{LONG} second"),
        ("<article><p>cut <a href=\"never closed>x</a></p></article>", None),
        ("<article><textarea>gone</textarea><p>stays</p><p>also", "stays also"),
    ],
)
def test_pages(page, text):
    found = html_text.main_text(page)
    assert text is None or found == text


def test_siblings_that_read_like_text_are_kept():
    page = f"<body><p>{LONG * 3}</p><div><p>{LONG}</p><p>{LONG}</p></div><div class=related><p>{LONG}</p></div></body>"
    assert html_text.main_text(page).count("This sentence") == 5


@pytest.mark.parametrize("page", ["<div>" * 60_000 + LONG, "</p>" * 60_000 + LONG, "<b" * 60_000, "<!--" * 60_000, "<p>" * 30_000 + LONG, "<a title='" * 20_000])
def test_broken_pages_take_time_in_proportion(page):
    assert len(html_text.main_text(page)) <= len(page)


def test_tables_with_nulls_and_other_columns(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, None), (3, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(map(tuple, html_text.extracted(df).collect()), key=str)
    assert found == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_text.extracted(df.limit(0)).isEmpty()


def test_every_given_page_has_a_text_without_its_frame(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = html_text.extracted(pages).collect()
    assert len(found) == pages.count()
    for r in found:
        assert r["n_chars"] == len(r["text"]) > 0
        assert "track(" not in r["text"] and "margin:0" not in r["text"] and "©" not in r["text"]


@pytest.mark.parametrize("inner", ["<b>" * 300, "<ul><li>x" * 300, "<b>" * 50_000])
def test_closing_tags_count_at_any_depth(inner):
    page = f"<nav>{inner}</nav><article><p>{LONG}</p></article>"
    assert html_text.main_text(page) == LONG
    page = f"<article><p>{LONG}</p>{inner}</article><div><p>{LONG * 3}</p></div>"
    assert html_text.main_text(page).count("This sentence") == 1


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "<li>x</li>" * 30_000, ("<b>" * 10 + "</i>") * 20_000])
def test_deep_stacks_take_time_in_proportion(page):
    assert len(html_text.main_text(page)) <= len(page)


@pytest.mark.parametrize(
    "opening",
    [
        "<div class='container overflow-hidden'>", "<div class='content has-sidebar'>", "<section class='post no-header'>",
        "<div id='page' class='site with-banner'>", "<div class='content banner'>", "<div class='widget entry-content'>", "<div class=modal>",
    ],
)
@pytest.mark.parametrize("inner", ["<p>{}</p><p>{}</p>", "<article><p>{}</p><p>{}</p></article>"])
def test_wrappers_of_the_article_are_not_cut_by_name(opening, inner):
    end = "</section>" if opening.startswith("<section") else "</div>"
    page = f"<div class=sidebar><p>{LONG}</p></div>{opening}{inner.format(LONG, LONG)}{end}<div class='site-footer'>{LONG}</div>"
    assert html_text.main_text(page) == f"{LONG} {LONG}"


def test_names_are_ignored_where_nothing_is_left():
    assert html_text.main_text(f"<div class=comments><p>{LONG}</p></div>") == LONG
    assert html_text.main_text(f"<div class=modal><p>{LONG}</p></div><div class=widget><p>{LONG}</p></div>").count("This") >= 1


@pytest.mark.parametrize("name", ["comments", "comment-list", "site-header", "cookieBanner", "related-posts", "sidebar-1", "main-nav", "ad"])
def test_boilerplate_is_cut_by_its_whole_name(name):
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div class='{name}'><p>{LONG}</p></div></body>"
    assert html_text.main_text(page) == f"{LONG} {LONG}"


def test_comments_longer_than_the_article_are_cut():
    page = f"<div><p>{LONG}</p></div><div class=comments><article><p>{LONG * 9}</p></article></div>"
    assert html_text.main_text(page) == LONG


@pytest.mark.parametrize("name", ["class", "id", "role", "hidden", "aria-hidden", "style"])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_names_inside_other_values_are_no_attributes(name, quote):
    """Words like names of attributes inside titles and captions cut nothing."""
    other = "'" if quote == '"' else '"'
    body = "".join(f"<p>{prose(k, 40)}, and so on.</p>" for k in range(3))
    for value in (f"A {name} gem", f"x {name}=nav y", f"{name}={other}sidebar{other} z", f"the {name}: {name}=true display:none"):
        plain = html_text.main_text(f"<body><nav>Menu</nav><div>{body}</div></body>")
        for tag in (f"div title={quote}{value}{quote}", f"div class={quote}story{quote} data-caption={quote}{value}{quote}"):
            assert html_text.main_text(f"<body><nav>Menu</nav><{tag}>{body}</div></body>") == plain != ""


def test_a_paragraph_ends_at_a_block_however_deep_it_was_opened():
    inside = "<b><i><u><em><span>"
    text = html_text.main_text(f"<article><p>{prose(1, 30)}, {inside}deep words<div>{prose(2, 30)}, more.</div><p>{prose(3, 30)}, end.</p></article>")
    assert prose(1, 30) in text and prose(2, 30) in text and prose(3, 30) in text
