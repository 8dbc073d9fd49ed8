import pytest
from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.operators import listings as L
from factloom.operators import pages as P
from factloom.functions.dom import dom_nodes, fragment_markdown



def as_of():
    return F.lit("2026-01-01").cast("timestamp")


PROSE = "This sentence, which is long enough, tells the reader something useful about the subject at hand. " * 3


def pages(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")


@pytest.mark.parametrize("html,expected", [
    ('<html><head><title>Just a moment...</title></head><body><div id="challenge-form"></div><script src="/cdn-cgi/challenge-platform/x"></script></body></html>', True),
    ("<html><head><title>Access denied</title></head><body>Your request has been blocked.</body></html>", True),
    (f"<html><head><title>How bot checks work</title></head><body><p>Sites say: verify you are human. {PROSE}</p></body></html>", False),
    (f'<html><head><title>Contact</title></head><body><p>{PROSE}</p><div class="cf-browser-verification"></div></body></html>', False),
    ("plain text: checking your browser", False),
])
def test_interstitials(values, html, expected):
    assert values(H.is_interstitial, [html]) == [expected]


def test_render_signals_and_templates(values):
    assert values(H.needs_render, ['<script src="a.js"></script>', '<script>x</script><div id="root">', "<script>x</script><p>", "<my-app></my-app>"]) == [True, True, False, False]
    assert values(H.template_dominated, ["{{ a }} few words", "{{a}} " + "word " * 30, "none"]) == [True, False, False]


def test_metadata_priority(spark):
    html = """<html lang="de_de"><head><title> T </title><!-- <meta property="og:title" content="hidden"> -->
      <meta property="og:title" content="null"><meta name="twitter:title" content="Shown &amp; told"><meta name="author" content="https://a.com/me">
      <meta property="article:published_time" content="2024-05-06T07:08:09Z"><meta name='description' content='Short'>
      <script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"Page"},{"@type":"NewsArticle","headline":"Head","dateModified":"2024-06-01","author":[{"name":"Ann"},"Bob"]}]}</script></head></html>"""
    only_ld = html.replace('name="author"', 'name="x"').replace('name="twitter:title"', 'name="y"')
    out = P.page_metadata(pages(spark, ("https://e.com/a", html), ("https://e.com/", only_ld), ("https://e.com/x", "<html><title>Plain</title><meta name='date' content='2030-01-01'>")), as_of()).orderBy("page_id").collect()
    a, b, c = (r.meta for r in out)
    assert (a.title, a.author, a.language, a.description) == ("Shown & told", None, "de-DE", "Short")
    assert a.published_at.year == 2024 and a.modified_at.month == 6
    assert (b.title, b.author, b.published_at) == ("Head", "Ann, Bob", None)
    assert (c.title, c.published_at) == ("Plain", None)


def test_preview_media(spark):
    hero = f'<html><head><title>Big story</title><meta property="og:image" content="/favicon.ico"></head><body><article><img src="/small.png" width="64" height="64"><img src="/hero.jpg" alt="Big Story" width="800" height="600"><p>{PROSE}</p></article></body></html>'
    shared = '<html><head><meta property="og:image" content="https://cdn.e.com/a.jpg?w=640"><meta property="og:image:alt" content="Alt"></head><body><img src="http://127.0.0.1/x.png"></body></html>'
    out = P.extract_content(pages(spark, ("https://e.com/a/b", hero), ("https://e.com/s", shared)), as_of()).orderBy("page_id").collect()
    assert [(m.url, m.alt, m.width) for m in out[0].media] == [("https://e.com/hero.jpg", "Big Story", 800)]
    assert [(m.url, m.alt, m.width) for m in out[1].media] == [("https://cdn.e.com/a.jpg?w=640", "Alt", 640)]


def test_page_markdown_shows_metadata_and_preview(spark, tmp_path):
    from factloom.plans.page_queries import page_markdown

    head = '<meta name="author" content="Ann"><meta name="description" content="Told"><meta property="article:published_time" content="2024-05-06T07:08:09Z"><meta property="article:modified_time" content="2024-06-01T00:00:00Z">'
    full = f'<html><head><title>Big story</title>{head}</head><body><article><img src="/hero.jpg" alt="Big Story" width="800" height="600"><p>{PROSE}</p></article></body></html>'
    rows = pages(spark, ("https://e.com/a/b", full), ("https://e.com/p", full.replace("/hero.jpg", "/logo.svg").replace(head, "")), ("https://e.com/n", None))
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    a, b, c = page_markdown(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [tuple(m) for m in a.media] == [("image", "https://e.com/hero.jpg", "Big Story", 800, 600)]
    assert (a.author, a.description, a.published_at.year, a.modified_at.month) == ("Ann", "Told", 2024, 6)
    assert b.media == c.media == [] and (b.author, b.published_at, c.error_code) == (None, None, "extraction_failed")


def test_content_choice_and_focus(spark):
    body = f'<html><head><title>Title</title><meta name="description" content="{PROSE[:120]}"></head><body><nav><a href="/a">menu</a></nav><article><h2>Intro</h2><p>{PROSE}</p><div class="cookie modal">Buy now</div></article><section id="pricing"><h2>Plans</h2><p>{PROSE.replace("subject", "price")}</p></section></body></html>'
    rows = pages(spark, ("https://e.com/1", body), ("https://e.com/2", "<html><head><title>T</title></head><body><p>tiny</p></body></html>"), ("https://e.com/3", body.split("<body>")[0] + "<body>tiny</body></html>"))
    a, b, c = P.extract_content(rows, as_of()).orderBy("page_id").collect()
    assert a.content.startswith("# Title\n\n") and "Buy now" not in a.content and "menu" not in a.content and not a.metadata_only
    assert (b.error_code, b.content) == ("extraction_failed", None)
    assert c.metadata_only and PROSE[:100] in c.content
    focused = P.extract_content(rows.filter("page_id = 0"), as_of(), F.lit("pricing table")).first()
    assert "price at hand" in focused.content and "Intro" not in focused.content


def test_fragment_markdown(spark):
    html = '<h2>A *b*</h2><p>x <b>y</b> <a href="/z">z</a></p><ul><li>1<li>2</ul><pre><code>c\n d</code></pre><img src="/check.svg"><img src="data:x" alt="logo"><a href="%s">long</a><iframe>i</iframe>' % ("/" + "q" * 600)
    got = spark.createDataFrame([(html,)], "h string").select(fragment_markdown("h", F.lit("https://e.com/")).alias("m")).first().m
    assert got == "## A \\*b\\*\n\nx **y** [z](https://e.com/z)\n\n- 1\n- 2\n\n```\nc\n d\n```\n\nlogolong"


def test_cascade(spark):
    article = f"<html><head><title>News</title></head><body><article><p>{PROSE}</p></article></body></html>"
    product = '<html><head><script type="application/ld+json">{"@type":"Product","name":"Hat","offers":{"price":"19.99","priceCurrency":"EUR","availability":"https://schema.org/InStock"}}</script></head><body><main><h1>Hat</h1><p>%s</p></main></body></html>' % PROSE
    card = lambda i: f'<li class="product"><a href="/p/{i}"><h2>Item {i}</h2></a><span class="price">{i},50 €</span></li>'
    shop = f"<html><head><title>Shop</title></head><body><ul>{card(1)}{card(2)}</ul></body></html>"
    one = f"<html><body><ul>{card(1)}</ul><p>{PROSE}</p></body></html>"
    blog = '<html><body><main><h1>Posts</h1><h2><a href="/post/one">A first headline</a></h2><h2><a href="/post/two">A second headline</a></h2></main></body></html>'
    shell = '<html><head><script src="a.js"></script></head><body><div id="root"></div><main>' + "".join(f'<a href="/{i}">Link number {i}, a long label for the menu</a>' for i in range(20)) + "</main></body></html>"
    rows = [("https://e.com/a", article), ("https://e.com/hat", product), ("https://e.com/shop", shop), ("https://e.com/one", one), ("https://blog.e.com/", blog), ("https://e.com/app", shell),
            ("http://10.0.0.1/", article), ("https://e.com/blocked", "<html><title>Access denied</title><body>Your request has been blocked</body></html>"), ("https://e.com/readme", "# Readme\n\n" + PROSE), ("https://e.com/pdf", "%PDF")]
    types = [None] * 8 + ["text/markdown; charset=utf-8", "application/pdf"]
    df = spark.createDataFrame([(i, u, h, t) for i, ((u, h), t) in enumerate(zip(rows, types))], "page_id long, url string, html string, content_type string")
    out = P.extract_pages(df, as_of()).orderBy("page_id").collect()
    assert [(r.type, r.method, r.error_code) for r in out] == [
        ("article", "linkedom", None), ("product", "product-jsonld", None), ("feed", "product-list-html", None), ("article", "linkedom", None), ("feed", "blog-list-html", None),
        (None, None, "extraction_failed"), (None, None, "unsafe_url"), (None, None, "source_blocked"), ("document", "native-markdown", None), (None, None, "unsupported_content_type")]
    assert (out[1].price, out[1].currency) == (1999, "EUR") and "Availability: InStock" in out[1].content
    assert [(i.url, i.price) for i in out[2].items] == [("https://e.com/p/1", 150), ("https://e.com/p/2", 250)]
    assert out[8].title == "Readme"


def test_given_alternates_rescue_pages(spark):
    rows = pages(spark, ("https://e.com/a", "<html><body>tiny</body></html>"))
    alternate = spark.createDataFrame([(0, "article", "discovered-feed", "From feed", "Feed text")], "page_id long, type string, method string, title string, content string")
    out = P.extract_pages(rows, as_of(), alternates=alternate).first()
    assert (out.method, out.title, out.error_code) == ("discovered-feed", "From feed", None)


def test_product_variants(spark):
    ld = '{"@type":["Thing","Product"],"name":"Mug","sku":"M1","brand":{"name":"Pots"},"image":["/a.jpg","/a.jpg",{"url":"/b.jpg","width":10}],"aggregateRating":{"ratingValue":"4.5","reviewCount":12},"offers":[{"itemOffered":{"color":"red","size":"L","sku":"r"},"price":12,"priceCurrency":"JPY","availability":"OutOfStock"},{"name":"no title","price":"9.5","priceCurrency":"eur"}]}'
    row = spark.createDataFrame([(ld,)], "o string").select(L.product_detail(F.col("o"), F.lit("https://e.com/x")).alias("d")).first().d
    assert (row.id, row.brand, row.price, row.currency, row.price_display, row.availability, row.rating, row.review_count) == ("M1", "Pots", 12, "JPY", "12 JPY", "OutOfStock", 4.5, 12)
    assert [(v.title, v.sku, v.price, v.available) for v in row.variants] == [("red / L", "r", 12, False)]
    assert [(i.url, i.alt, i.width) for i in row.images] == [("https://e.com/a.jpg", "Mug", None), ("https://e.com/b.jpg", "Mug", 10)]


def test_marketplace_list(spark):
    html = '<div data-itemid="1"><a href="/x/dp/b000000001/ref">t</a><h3>Lamp</h3><span class="a-price"><span class="a-offscreen">1.234,00 €</span></span></div><div data-asin="B000000001"><h2>again</h2></div>'
    row = spark.createDataFrame([(html,)], "h string").select(dom_nodes("h").alias("n")).select(L.marketplace_cards(F.col("n"), F.lit("https://www.amazon.de/hz/wishlist/ls/ABCDE"), "list").alias("c")).first()
    assert [(c.id, c.title, c.price, c.currency) for c in row.c] == [("B000000001", "Lamp", 123400, "EUR")]


def test_end_tags_match_at_any_depth():
    from factloom.functions.dom import _read_page, flatten, to_markdown

    for n in (150, 250, 5000):
        page = f"<article id='x'>{'<div>' * n}<article id='y'>in <a href='/l'>link</a><script>no</script></article><b>bold</b>{'</div>' * n}<p>after</p></article><p>out</p>"
        nodes = flatten(page)
        at = {(m[4] or {}).get("id"): m for m in nodes}
        held = lambda m: "".join(k[5] for k in nodes[m[0]:m[2]] if k[5])
        assert held(at["y"]) == "in linkno" and held(at["x"]) == "in linknoboldafter" and held(nodes[-2]) == "out"
        text = to_markdown(nodes, 0, len(nodes), "https://a.example/")
        assert text.split() == ["in", "[link](https://a.example/l)", "**bold**", "after", "out"]
        assert _read_page(page, "https://a.example/", None)["primary_text"] == "in linkboldafter"
    assert "deep" in to_markdown(nodes := flatten("<blockquote><em>" * 3000 + "deep"), 0, len(nodes), "")


def test_page_readers_take_small_lots_of_rows(spark):
    from factloom.functions import dom, text
    from factloom.sources.catalogs import find_by_key

    html, none = F.concat(F.lit("<p>a &amp; <b>b</b></p>"), F.col("id").cast("string")), F.lit(None).cast("string")
    blocks = F.array(F.lit('{"a": {"b": 1}}'))
    df = spark.range(250).select("id", *[c.alias(f"c{i}") for i, c in enumerate((
        dom.fragment_markdown(html, none), dom.dom_nodes(html), dom.read_page(html, none, none), dom.json_objects(blocks), dom.shallow_json_objects(blocks),
        text.decode_entities(html), find_by_key("a")(blocks[0]), dom.fragment_markdown(none, none), dom.dom_nodes(none), dom.read_page(none, none, none)))])
    # An Arrow batch of long texts is held whole, several times over, in every task.
    assert "ArrowEvalPython" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 250 and rows[7].c0 == "a & **b**\n\n7" and rows[7].c6 == ['{"b": 1}'] and rows[7].c3 == ['{"a": {"b": 1}}', '{"b": 1}'] == rows[7].c4
    assert (rows[7].c1[0].tag, rows[7].c1[0].attrs, rows[7].c1[1].text) == ("p", {}, "a & ")
    assert rows[7].c5 == "<p>a & <b>b</b></p>7" and rows[7].c2.links == 0 and rows[7].c7 is None and rows[7].c8 is None and rows[7].c9.links is None
