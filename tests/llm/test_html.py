import pytest

from rejoinder.llm import html

LONG = "This is the text of a story that was told by the fire, and it is as long as a block has to be for the rules."


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; me</footer>", f"Head\n{LONG}\nShort."),
        ("<div class=\"ad\">Buy the best of it all, and do it now, for you are who you are, and it is the time to be.</div><article><p><b>Only this.<br></article>", "Only this."),
        (f"<article><p>{LONG}</p><p>a &lt;b&gt;\n\n &amp;&#233; c</p></article>", f"{LONG}\na <b> &é c"),
        (f"<div id=\"main\"><h2>Title</h2><p>{LONG}</p><p>More.</p><p>{LONG}</p></div><div>Menu</div><div class=\"side-bar sidebar\">{LONG}</div>", f"Title\n{LONG}\nMore.\n{LONG}"),
        (f"<div class='has-sidebar'><p>{LONG}</p></div><div id=cookieNotice><p>{LONG}</p></div><aside>{LONG}</aside><form><p>{LONG}</p></form>", LONG),
        (f"<header><p>{LONG}</p></header><main><p>{LONG}</p></main><section class=\"comments\"><p>{LONG}</p></section>", LONG),
        (f"<article><p>{LONG}</p><ul><li><a href=x>{LONG}</a></li></ul></article><!-- <p>{LONG}</p> ", LONG),
        ("<article><p>&&& %%% $$$ *** words without any function word whatsoever *** $$$ %%% &&& again here</p></article>", "&&& %%% $$$ *** words without any function word whatsoever *** $$$ %%% &&& again here"),
        (f"<article><p title='a > b'>{LONG}<script>if (a < b) {{}}", LONG),
        (f"<p>{LONG}</p><p hidden>{LONG}</p>", LONG),
        ("", ""),
        ("<nav>only menu</nav>", ""),
    ],
)
def test_pages(body, want):
    assert html.main_text(page(body)) == want


CHINESE = "这是一个关于村庄的故事。很久以前,人们在河边建造了房屋,种植水稻,养牛和鸡。孩子们每天早晨去学校。"
CZECH = "Byl jednou jeden král, který měl tři syny a velkou zahradu. Každý večer chodil po zahradě a počítal jablka na stromech."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><h1>Title</h1><div class='ad'>Buy now</div><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<article><p>{LONG}</p><p><a href=x>other article</a></p><p>See also</p><p><a href=y>more</a></p><p>Last short.</p></article>", f"{LONG}\nSee also\nLast short."),
        (f"<div id=page><div>Home</div><p>{CHINESE}</p><p>{CHINESE}</p></div>", None),
        (f"<div><p>{CZECH}</p><p>{CZECH}</p></div><footer>(c)</footer>", f"{CZECH}\n{CZECH}"),
        ("<nav>Menu</nav><p>Two short.</p><p>Paragraphs only.</p>", "Two short.\nParagraphs only."),
        (f"<div class='content-with-sidebar'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='layout sidebar-right'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='comments-open'><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p></article><section id='comments'><article><p>{LONG}</p></article></section>", LONG),
        (f"<article><p>{LONG}</p><div class='related-posts'><article><p>{LONG}</p></article></div><p>End.</p></article>", f"{LONG}\nEnd."),
        (f"<aside><article><p>{LONG}</p></article></aside><main><p>Short.</p></main>", "Short."),
    ],
)
def test_articles_keep_their_short_blocks(body, want):
    got = html.main_text(page(body))
    assert got == want if want is not None else CHINESE in got


def test_column_of_the_same_name_is_replaced(spark):
    pages = spark.createDataFrame([(1, "own", page(f"<article>{LONG}</article>"), 2)], "page_id bigint, Text string, html string, n_chars int")
    out = html.extract(pages, "text")
    assert out.columns == ["page_id", "html", "n_chars", "text"] and out.select("text").first()[0] == LONG


@pytest.mark.parametrize("broken", ["<", "<a", "<a href='x", "</", "<!--", "<script>", "<p class=\"a>b</p>", "a < b > c", "<" * 50_000, "<a '" * 3_000])
def test_broken_markup_ends(broken):
    html.main_text(broken)


def test_rows(spark):
    whole = page(f"<article><p>{LONG * 2000}</p></article>")
    rows = [(1, "u", whole), (1, "u", whole), (2, None, None), (None, "v", ""), (3, "w", "no markup")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, url string, html string, text int")
    out = html.extract(pages)
    assert out.columns == [*pages.columns, "main_text"]
    got = sorted((r["page_id"] or 0, r["main_text"]) for r in out.collect())
    assert got == [(0, ""), (1, LONG * 2000), (1, LONG * 2000), (2, ""), (3, "")]
    assert html.extract(pages.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark):
    import re
    from html import unescape

    from rejoinder.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in QUERIES["op2_main_text"](spark, folder).collect():
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.DOTALL)[1]
        lines = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("<br>", " "))]
        assert r["text"] == "\n".join(x for x in lines if x)
        assert r["n_chars"] == len(r["text"])
