"""Normalizers over payloads that Spark derives from the given tables, one payload per row.

The payloads have the shape of the real ones, so that every row of a table passes through a parser; the SQL
reads the same values straight from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import let, rows_of
from factloom.functions import text as T
from factloom.operators import quality
from factloom.operators.joins import rescue_by_id, with_fallback
from factloom.operators.search import filter_creator, filter_images, filter_platform
from factloom.plans.tables import dealt, register_into, table
from factloom.sources import catalogs, embeds, feeds, social
from factloom.operators import listings as L
from factloom.functions.dom import dom_nodes, fragment_markdown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)


def js(**fields):
    """JSON object text of named columns."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def xml_text(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def documents(spark, folder):
    """Every document with its whole text."""
    return table(spark, folder, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("plain"))


DOCS_SQL = "d as (select doc_id, lang, source, coalesce(text, '') as plain from documents)"
FILLED = r"plain rlike '[^ \\t\\n\\r\\f]'"
FILLED_SQL = r"trim(regexp_replace(plain, '\s+', ' ', 'g')) <> ''"
BLANKS = r"trim(regexp_replace(plain, '[\s\x{A0}]+', ' ', 'g'))"
# The text as Markdown shows it: white space as one blank, marks escaped.
COLLAPSE = r"trim(regexp_replace(regexp_replace(plain, '[\s\x{A0}]+', ' ', 'g'), '([\\`*_\[\]<>])', '\\\1', 'g'))"


@query(f"""with {DOCS_SQL}, i as (select doc_id, unnest([0, 1]) as position, plain, source, lang from d)
select doc_id as payload_id, position::bigint as position, 'https://' || source || '.example.org/' || doc_id || case when position = 0 then '' else '/more' end as url, case when position = 0 then 'Item ' || doc_id else 'More & more' end as title,
  source as author, '2024-02-03T04:05:06.000Z' as "publishedAt", case when position = 0 then '**' || lang || '** ' || {COLLAPSE} else {COLLAPSE} end as content from i where {FILLED_SQL}""")
def payload_rss(spark, folder):
    """Every document as an RSS feed of two items."""
    d = documents(spark, folder).filter(FILLED)
    base = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id")
    item = lambda title, url, body: F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><author>"), F.col("source"),
        F.lit("</author><pubDate>Sat, 03 Feb 2024 04:05:06 GMT</pubDate><description>"), xml_text(body), F.lit("</description></item>"))
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>'),
        item(F.concat(F.lit("Item "), "doc_id"), base, F.concat(F.lit("<b>"), "lang", F.lit("</b> "), xml_text(F.col("plain")))),
        item(F.lit("More &amp; more"), F.concat(base, F.lit("/more")), xml_text(F.col("plain"))), F.lit("</channel></rss>"))
    out = feeds.parse_feeds(d.select(F.col("doc_id").alias("payload_id"), base.alias("url"), body.alias("body")))
    return out.select("payload_id", "position", "url", "title", "author", "publishedAt", "content")


@query(f"""with {DOCS_SQL} select doc_id as payload_id, 0::bigint as position, 'https://a.example.org/' || doc_id as url, 'Entry ' || doc_id as title, source as author, '2024-02-03T04:05:06.000Z' as "publishedAt", {COLLAPSE} as content from d where {FILLED_SQL}""")
def payload_atom(spark, folder):
    """S3: every document as an Atom feed with an alternate link."""
    d = documents(spark, folder).filter(FILLED)
    body = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><entry><title>Entry '), F.col("doc_id").cast("string"),
        F.lit('</title><link rel="self" href="https://a.example.org/self"/><link rel="alternate" href="https://a.example.org/'), F.col("doc_id").cast("string"),
        F.lit('"/><author><name>'), F.col("source"), F.lit("</name></author><updated>2024-02-03T04:05:06Z</updated><content type=\"html\">"), xml_text(xml_text(F.col("plain"))),
        F.lit("</content></entry></feed>"))
    out = feeds.parse_xml_feeds(d.select(F.col("doc_id").alias("payload_id"), F.lit("https://a.example.org/").alias("url"), body.alias("body")))
    return out.select("payload_id", "position", "url", "title", "author", "publishedAt", "content")


@query("""select conv_id * 1000 + turn as payload_id, 'https://talk.example.org/' || conv_id || '/' || turn as url, role as author, trim(regexp_replace(text, '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g')) as content from conversations""")
def payload_json_feed(spark, folder):
    """Every turn as a JSON feed of one entry."""
    c = table(spark, folder, "conversations")
    url = F.concat(F.lit("https://talk.example.org/"), "conv_id", F.lit("/"), "turn")
    entry = F.struct(F.concat(F.lit("t"), "turn").alias("id"), url.alias("external_url"), F.col("text").alias("content_text"), F.array(F.struct(F.col("role").alias("name"))).alias("authors"))
    body = js(version=F.lit("https://jsonfeed.org/version/1.1"), title=F.lit("Talk"), items=F.array(entry))
    out = feeds.parse_feeds(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("payload_id"), F.lit("https://talk.example.org/").alias("url"), body.alias("body")))
    return out.select("payload_id", "url", "author", "content")


@query(f"""with {DOCS_SQL}, r as (select doc_id as payload_id, unnest([1, 2]) as position, 'https://' || source || '.example.org/' || doc_id as url, plain from d)
select payload_id, position::bigint as position, url || case when position = 1 then '' else '?p=2' end as url, case when position = 1 then 'Result ' || payload_id else regexp_extract(url, '^https://([^/]*)', 1) end as title, {BLANKS} as content from r""")
def payload_search_rss(spark, folder):
    """Search results, where unsafe and repeated links are skipped."""
    d = documents(spark, folder)
    base = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id")
    item = lambda title, url: F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><description>"), xml_text(F.concat(F.lit("<b></b>"), xml_text(F.col("plain")))), F.lit("</description></item>"))
    body = F.concat(F.lit("<rss><channel>"), item(F.lit("bad"), F.lit("javascript:alert(1)")), item(F.concat(F.lit("Result "), "doc_id"), base), item(F.lit(""), F.concat(base, F.lit("?p=2"))),
                    item(F.lit("again"), base), F.lit("</channel></rss>"))
    out = feeds.parse_search_results(d.select(F.col("doc_id").alias("payload_id"), F.lit("").alias("url"), body.alias("body")))
    return out.select("payload_id", "position", "url", "title", "content")


@query(f"""with {DOCS_SQL} select doc_id as payload_id, 'web' as source, 'Doc ' || doc_id as title, source as author, '# Doc ' || doc_id || case when {COLLAPSE} = '' then '' else chr(10) || chr(10) || {COLLAPSE} end || chr(10) || chr(10) || '[View source](https://' || source || '.example.org/' || doc_id || ')' as content, cast(null as bigint) as seconds from d where doc_id % 2 = 0
union all select doc_id, 'vimeo', 'Doc ' || doc_id, source, '# Doc ' || doc_id || case when {COLLAPSE} = '' then '' else chr(10) || chr(10) || {COLLAPSE} end || chr(10) || chr(10) || 'Author: ' || source || ' · Duration: 61.5 seconds' || chr(10) || chr(10) || '[View on Vimeo](https://vimeo.com/' || doc_id || ')', 62 from d where doc_id % 2 = 1""")
def payload_oembed(spark, folder):
    """Every document as an embed description of a page or a video."""
    d = documents(spark, folder)
    odd = F.col("doc_id") % 2 == 1
    url = F.when(odd, F.concat(F.lit("https://vimeo.com/"), "doc_id")).otherwise(F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id"))
    body = js(title=F.concat(F.lit("Doc "), "doc_id"), author_name=F.col("source"), html=F.concat(F.lit("<p>"), xml_text(F.col("plain")), F.lit("</p><iframe src='x'></iframe>")), duration=F.when(odd, F.lit(61.5)))
    out = embeds.normalize_oembed(d.select(F.col("doc_id").alias("payload_id"), url.alias("url"), body.alias("body")))
    return out.select("payload_id", "source", "title", "author", "content", F.col("attributes.durationSeconds").alias("seconds"))


@query(f"""with {DOCS_SQL} select doc_id as payload_id, cast(doc_id as varchar) as id, 'https://' || source || '.example.org/p/' || doc_id as url, 'Post ' || doc_id as title, '2024-02-03T04:05:06.000Z' as "publishedAt", '# Post ' || doc_id || chr(10) || chr(10) || {COLLAPSE} as content from d where {FILLED_SQL}""")
def payload_wordpress(spark, folder):
    """Every document as a WordPress post."""
    d = documents(spark, folder)
    rendered = lambda c: F.struct(c.alias("rendered"))
    link = F.concat(F.lit("https://"), "source", F.lit(".example.org/p/"), "doc_id")
    body = js(id=F.col("doc_id"), link=link, title=rendered(F.concat(F.lit("Post "), "doc_id")), content=rendered(F.when(F.expr(FILLED), F.concat(F.lit("<p>"), xml_text(F.col("plain")), F.lit("</p>"))).otherwise(F.lit(""))),
              date_gmt=F.lit("2024-02-03T04:05:06"), date=F.lit("2020-01-01T00:00:00"))
    out = embeds.normalize_wordpress(d.select(F.col("doc_id").alias("payload_id"), F.lit("https://x.example.org/").alias("url"), body.alias("body")))
    return out.select("payload_id", "id", "url", "title", "publishedAt", "content")


def parts(spark, folder):
    return dealt(table(spark, folder, "part"))


CENTS_SQL = "cast(floor(cast(p_retailprice as decimal(18,2)) * 100) as bigint)"


def cents():
    return F.floor(F.col("p_retailprice").cast("decimal(18,2)") * 100).cast("long")


@query(f"""select p_partkey as payload_id, cast(p_partkey as varchar) as id, p_name as title, p_brand as author, {CENTS_SQL} as price, 'EUR' as currency,
  cast(cast({CENTS_SQL} as decimal(18,0)) / 100 as decimal(18,2))::varchar || ' EUR' as display, case when p_size > 25 then {CENTS_SQL} + 500 end as compare, 2::bigint as variants, 'https://s.example.com/products/p-' || p_partkey as url from part""")
def payload_shopify(spark, folder):
    """Every part as a shop product; numbers are minor units and texts are decimal amounts."""
    c = cents()
    text = (c.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")
    variant = lambda title, price: F.struct(F.lit(title).alias("title"), price.alias("price"), F.lit(True).alias("available"))
    body = js(id=F.col("p_partkey"), title=F.col("p_name"), handle=F.concat(F.lit("p-"), "p_partkey"), vendor=F.col("p_brand"), product_type=F.col("p_type"),
              price=F.when(F.col("p_partkey") % 2 == 0, c), compare_at_price=F.when(F.col("p_size") > 25, c + 500).otherwise(c - 1),
              variants=F.array(variant("S", text), variant("L", text)), tags=F.lit("a, b, a"))
    rows = parts(spark, folder).select(F.col("p_partkey").alias("payload_id"), F.lit("https://s.example.com/products/x").alias("url"), body.alias("body"), F.lit("EUR").alias("currency"))
    out = catalogs.normalize_shopify(rows)
    a = F.col("attributes")
    return out.select("payload_id", "id", "title", "author", a["price"].alias("price"), a["currency"].alias("currency"), a["priceDisplay"].alias("display"), a["compareAtPrice"].alias("compare"),
                      F.size(a["variants"]).cast("long").alias("variants"), "url")


@query(f"""select p_partkey as payload_id, p_name as title, p_brand as brand, {CENTS_SQL} as price, 'EUR' as currency, cast(cast({CENTS_SQL} as decimal(18,0)) / 100 as decimal(18,2))::varchar || ' €' as display,
  case when p_size % 2 = 0 then {CENTS_SQL} + 100 end as compare, case when p_size > 5 then 'InStock' else 'OutOfStock' end as availability, 'Size: ' || p_size || ', ' || p_type as feature from part""")
def payload_woocommerce(spark, folder):
    """Every part as a shop product with minor-unit prices."""
    c = cents().cast("string")
    term = lambda x: F.struct(x.alias("name"))
    body = F.concat(F.lit("["), js(
        id=F.col("p_partkey"), name=F.col("p_name"), slug=F.concat(F.lit("p-"), "p_partkey"), is_in_stock=F.col("p_size") > 5, brands=F.array(term(F.col("p_brand"))),
        prices=F.struct(c.alias("price"), F.when(F.col("p_size") % 2 == 0, (cents() + 100).cast("string")).otherwise(c).alias("regular_price"), F.lit("EUR").alias("currency_code"),
                        F.lit(2).alias("currency_minor_unit"), F.lit(" €").alias("currency_suffix")),
        attributes=F.array(F.struct(F.lit("Size").alias("name"), F.array(term(F.col("p_size").cast("string")), term(F.col("p_type"))).alias("terms")))), F.lit("]"))
    out = catalogs.normalize_woocommerce(parts(spark, folder).select(F.col("p_partkey").alias("payload_id"), F.lit("https://w.example.com/shop").alias("url"), body.alias("body")))
    a = F.col("attributes")
    return out.select("payload_id", "title", a["brand"].alias("brand"), a["price"].alias("price"), a["currency"].alias("currency"), F.regexp_replace(a["priceDisplay"], r"(\d)€", "$1 €").alias("display"),
                      a["compareAtPrice"].alias("compare"), a["availability"].alias("availability"), F.get(a["features"], F.lit(0)).alias("feature"))


@query(f"""select p_partkey as payload_id, p_name as title, p_brand as brand, {CENTS_SQL} as price, 'USD' as currency, 'https://apps.apple.com/us/app/id' || (100000 + p_partkey) as url, 3::bigint as media, 'iOS 15.0 or later' as system from part""")
def payload_app_lookup(spark, folder):
    """Every part as an app store lookup."""
    shots = F.array(F.lit("https://i.example.com/1.png"), F.lit("https://i.example.com/2.png"), F.lit("https://i.example.com/1.png"))
    result = F.struct((100000 + F.col("p_partkey")).alias("trackId"), F.col("p_name").alias("trackName"), F.col("p_brand").alias("artistName"), F.col("p_retailprice").alias("price"), F.lit("usd").alias("currency"),
                      F.concat(F.lit("https://apps.apple.com/us/app/id"), 100000 + F.col("p_partkey"), F.lit("?uo=4")).alias("trackViewUrl"), F.lit("https://i.example.com/icon.png").alias("artworkUrl512"),
                      shots.alias("screenshotUrls"), F.lit("15.0").alias("minimumOsVersion"))
    rows = parts(spark, folder).select(F.col("p_partkey").alias("payload_id"), F.lit("https://apps.apple.com/").alias("url"), js(results=F.array(result)).alias("body"))
    out = catalogs.normalize_app_lookup(rows)
    return out.select("payload_id", "title", "author", F.col("attributes.price").alias("price"), F.col("attributes.currency").alias("currency"), "url", F.size("media").cast("long").alias("media"),
                      F.col("attributes.operatingSystem").alias("system")).withColumnRenamed("author", "brand")


@query(f"""select p_partkey as payload_id, p_name as title, p_brand as author, {CENTS_SQL} as price, case when {CENTS_SQL} = 0 then 'Free' else cast(cast({CENTS_SQL} as decimal(18,0)) / 100 as decimal(18,2))::varchar || ' USD' end as display from part""")
def payload_software_pages(spark, folder):
    """Every part as a page whose structured data describes an app inside a graph."""
    app = F.struct(F.lit("MobileApplication").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("author"),
                   F.array(F.struct(F.col("p_retailprice").cast("string").alias("price"), F.lit("USD").alias("priceCurrency"))).alias("offers"))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.to_json(F.struct(F.array(F.struct(F.lit("WebPage").alias("@type")).alias("p")).alias("x"), F.array(app).alias("@graph"))), F.lit("</script></head></html>"))
    url = F.concat(F.lit("https://play.google.com/store/apps/details?id=com.part.n"), "p_partkey")
    out = catalogs.normalize_software_pages(parts(spark, folder).select(F.col("p_partkey").alias("payload_id"), url.alias("url"), page.alias("body")))
    return out.select("payload_id", "title", "author", F.col("attributes.price").alias("price"), F.col("attributes.priceDisplay").alias("display"))


@query(f"""select p_partkey as page_id, p_name as title, p_brand as brand, {CENTS_SQL} as price, 'EUR' as currency, case when p_size % 2 = 0 then 'InStock' else 'OutOfStock' end as availability, 2::bigint as variants,
  'Weight: ' || p_size || ' kg|Type: ' || p_type as features from part""")
def product_pages(spark, folder):
    """H2, H8, H9: every part as a page with structured data and a specification table."""
    p = parts(spark, folder)
    stock = F.when(F.col("p_size") % 2 == 0, "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock")
    offer = lambda color, extra: F.struct(
        F.struct(F.lit(color).alias("color"), F.concat(F.lit("p"), "p_partkey", F.lit(color)).alias("sku")).alias("itemOffered"),
        (F.col("p_retailprice") + extra).cast("decimal(18,2)").alias("price"), F.lit("EUR").alias("priceCurrency"),
        F.when(F.lit(extra) == 0, stock).otherwise("https://schema.org/OutOfStock").alias("availability"))
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.array(offer("red", 5), offer("blue", 0)).alias("offers")))
    html = F.concat(
        F.lit('<html><head><script type="application/ld+json">{"@graph":['), product, F.lit("]}</script></head><body><main><h1>"), F.col("p_name"), F.lit("</h1><table><tr><th>Weight</th><td>"),
        F.col("p_size").cast("string"), F.lit(" kg</td></tr></table><dl><dt>Type</dt><dd>"), F.col("p_type"), F.lit("</dd></dl></main></body></html>"))
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/p/"), "p_partkey").alias("url"), html.alias("html"))
    from factloom.functions.dom import shallow_json_objects
    from factloom.functions.html import ld_blocks

    read = pages.select("page_id", "url", L.product_object(shallow_json_objects(ld_blocks(F.col("html")))).alias("object"), dom_nodes("html").alias("nodes"))
    out = read.select("page_id", L.product_detail(F.col("object"), F.col("url")).alias("d"), L.spec_features(F.col("nodes")).alias("f"))
    return out.select("page_id", "d.title", "d.brand", "d.price", "d.currency", "d.availability", F.size("d.variants").cast("long").alias("variants"), F.array_join("f", "|").alias("features"))


@query(f"""with c as (select p_partkey as page_id, unnest([0, 1, 2]) as k, p_name, {CENTS_SQL} as cents from part)
select page_id, 'https://shop.example.com/i/' || page_id || '/' || k as url, p_name || ' ' || k as title, cents + k * 100 as price, 'EUR' as currency, k::bigint as position from c""")
def product_list_pages(spark, folder):
    """Every part as a page with three product cards (and a repeated one)."""
    def card(k):
        url = F.concat(F.lit("/i/"), "p_partkey", F.lit(f"/{k}"))
        price = F.regexp_replace(((cents() + k * 100).cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string"), r"\.", ",")
        return F.concat(F.lit('<div class="product-card"><a href="'), url, F.lit('"><h3>'), F.col("p_name"), F.lit(f' {k}</h3></a><span class="price">'), price, F.lit(" €</span></div>"))

    html = F.concat(F.lit("<html><body><main><h1>Parts</h1>"), card(0), card(1), card(0), card(2), F.lit("</main></body></html>"))
    pages = parts(spark, folder).select(F.col("p_partkey").alias("page_id"), F.lit("https://shop.example.com/list").alias("url"), dom_nodes(html).alias("nodes"))
    cards = let(L.product_cards(F.col("nodes"), F.col("url")), L.listed)
    return rows_of(pages, ["page_id"], cards, "c").select("page_id", "c.url", "c.title", "c.price", "c.currency", "position")


@query(f"""with {DOCS_SQL}, c as (select doc_id as page_id, unnest([0, 1]) as k, source from d)
select page_id, 'https://blog.example.com/post/' || page_id || '/' || k as url, 'A long headline ' || k as title, source as author, '2024-02-03 04:05:06' as published, k::bigint as position from c""")
def blog_list_pages(spark, folder):
    """Every document as a blog index with two posts, a short and a foreign link."""
    post = lambda k: F.concat(
        F.lit('<article><h2><a href="/post/'), F.col("doc_id").cast("string"), F.lit(f'/{k}">A long headline {k}</a></h2><span class="post-author">'), F.col("source"),
        F.lit('</span><time datetime="2024-02-03T04:05:06Z">Feb</time><p class="excerpt">Short text</p></article>'))
    html = F.concat(F.lit("<html><body><main><h1>Blog</h1>"), post(0), F.lit('<h2><a href="/more">More</a></h2><h3><a href="https://other.example.com/x">Some other headline</a></h3>'), post(1), F.lit("</main></body></html>"))
    pages = documents(spark, folder).select(F.col("doc_id").alias("page_id"), F.lit("https://blog.example.com/blog").alias("url"), dom_nodes(html).alias("nodes"))
    rows = rows_of(pages, ["page_id"], L.blog_items(F.col("nodes"), F.col("url")), "p")
    return rows.select("page_id", "p.url", "p.title", "p.author", F.date_format("p.published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "position")


@query(f"""select p_partkey as page_id, 'B' || lpad(cast(p_partkey as varchar), 9, '0') as id, p_name as title, {CENTS_SQL} as price, 'EUR' as currency, 4.5::double as rating, 1234::bigint as review_count from part""")
def marketplace_pages(spark, folder):
    """Every part as a marketplace search page with whole and fraction price parts."""
    code = F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    c = cents()
    html = F.concat(
        F.lit('<html><body><div data-component-type="s-search-result" data-asin="'), code, F.lit('"><h2>'), F.col("p_name"), F.lit('</h2><span class="a-price"><span class="a-offscreen">'),
        (c / 100).cast("decimal(20,2)").cast("string"), F.lit(' €</span><span class="a-price-whole">'), F.floor(c / 100).cast("string"), F.lit(',</span><span class="a-price-fraction">'),
        F.lpad((c % 100).cast("string"), 2, "0"), F.lit('</span></span><span class="a-icon-alt">4,5 von 5</span><span class="s-underline-text">1.234</span></div>'),
        F.lit('<div data-component-type="s-search-result" data-asin="short"><h2>No code</h2></div></body></html>'))
    pages = parts(spark, folder).select(F.col("p_partkey").alias("page_id"), F.lit("https://www.amazon.de/s?k=x").alias("url"), dom_nodes(html).alias("nodes"))
    rows = rows_of(pages, ["page_id"], L.marketplace_cards(F.col("nodes"), F.col("url"), "search"), "c")
    return rows.select("page_id", "c.id", "c.title", "c.price", "c.currency", "c.rating", "c.review_count")


@query("""select p_partkey as payload_id, 'openverse' as catalog, p_name as title, 'BY-NC 4.0' as license, case when p_size > 25 then 'landscape' else 'portrait' end as orientation, 'jpg' as file_type from part where p_size % 3 = 0 and p_size > 25
union all select p_partkey, 'wikimedia', p_name, 'CC BY 4.0', 'landscape', 'image/png' from part where not (p_size % 3 = 0 and p_size > 25)""")
def payload_images(spark, folder):
    """Every part as a picture search; the second catalog serves what the filter leaves empty."""
    p = parts(spark, folder)
    first = js(results=F.when(F.col("p_size") % 3 == 0, F.array(F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("https://i.example.com/a.JPG").alias("url"), F.lit("by-nc").alias("license"), F.lit("4.0").alias("license_version"),
        F.when(F.col("p_size") > 25, 800).otherwise(300).alias("width"), F.lit(600).alias("height")))).otherwise(F.array()))
    meta = F.struct(F.struct(F.lit("CC BY 4.0").alias("value")).alias("LicenseShortName"), F.struct(F.lit('<a href="//commons.wikimedia.org/u">Ann</a>').alias("value")).alias("Artist"))
    info = F.struct(F.lit("https://u.example.com/t.png").alias("thumburl"), F.lit("https://commons.wikimedia.org/f").alias("descriptionurl"), F.lit(1600).alias("thumbwidth"), F.lit(900).alias("thumbheight"),
                    F.lit("image/png").alias("mime"), meta.alias("extmetadata"))
    second = js(query=F.struct(F.array(F.struct(F.col("p_partkey").alias("pageid"), F.concat(F.lit("File:"), "p_name").alias("title"), F.array(info).alias("imageinfo"))).alias("pages")))
    rows = lambda body: p.select(F.col("p_partkey").alias("payload_id"), F.lit("").alias("url"), body.alias("body"))
    flat = lambda df, name: df.select("payload_id", F.lit(name).alias("catalog"), "title", F.col("attributes.license").alias("license"), F.col("attributes.licenseUrl").alias("license_url"),
                                      F.col("attributes.orientation").alias("orientation"), F.col("attributes.fileType").alias("file_type"))
    a = filter_images(flat(catalogs.normalize_openverse(rows(first)), "openverse"), "modify", "landscape")
    b = filter_images(flat(catalogs.normalize_wikimedia(rows(second)), "wikimedia"), "modify", "landscape")
    return with_fallback([a, b], "payload_id").drop("source_rank", "license_url")


@query("""select c_custkey as payload_id, c_name as title, (c_custkey % 170) * 0.5::double - 42 as latitude, (c_custkey % 350) * 0.5::double - 87 as longitude, 'Main Street ' || c_custkey || ', 1000 ' || n_name || ', Land' as address,
  'shop:' || lower(c_mktsegment) as category, '-1.0|48.0|2.0|50.0' as box, 'https://www.openstreetmap.org/node/' || (c_custkey + 1) as url, 'DE' as country_code from customer join nation on c_nationkey = n_nationkey where c_custkey % 5 <> 0""")
def payload_places(spark, folder):
    """Every customer as a map feature; those outside the map are dropped."""
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    c = dealt(table(spark, folder, "customer")).join(names, "c_nationkey")
    key = F.col("c_custkey")
    lat = F.when(key % 5 == 0, F.lit(100.0)).otherwise((key % 170) * 0.5 - 42)
    props = F.struct(F.col("c_name").alias("name"), F.lit("Main Street").alias("street"), key.cast("string").alias("housenumber"), F.lit("1000").alias("postcode"), F.col("city"), F.lower("city").alias("state"),
                     F.lit("Land").alias("country"), F.lit("de").alias("countrycode"), F.lit("N").alias("osm_type"), (key + 1).alias("osm_id"), F.lit("shop").alias("osm_key"), F.lower("c_mktsegment").alias("osm_value"),
                     F.array(F.lit(-1.0), F.lit(50.0), F.lit(2.0), F.lit(48.0)).alias("extent"))
    feature = F.struct(props.alias("properties"), F.struct(F.array((key % 350) * 0.5 - 87, lat).alias("coordinates")).alias("geometry"))
    out = catalogs.normalize_places(c.select(key.alias("payload_id"), F.lit("").alias("url"), js(features=F.array(feature)).alias("body")))
    a = F.col("attributes")
    return out.select("payload_id", "title", a["latitude"].alias("latitude"), a["longitude"].alias("longitude"), a["address"].alias("address"), a["category"].alias("category"),
                      F.array_join(F.transform(a["boundingBox"], lambda v: v.cast("string")), "|").alias("box"), "url", a["countryCode"].alias("country_code"))


@query("""select p_partkey as payload_id, 'P' || p_partkey as id, p_name as title, p_retailprice as price, (p_partkey % 7) - 3.5::double as change_percent, 1000::bigint as volume, case when p_size % 2 = 0 then 'GBp' end as currency from part""")
def payload_movers(spark, folder):
    """Every part as a mover list with a repeated symbol, a fund and an invalid symbol."""
    quote = lambda kind, symbol: F.struct(
        F.lit(kind).alias("quoteType"), symbol.alias("symbol"), F.col("p_name").alias("longName"), F.col("p_retailprice").alias("regularMarketPrice"),
        ((F.col("p_partkey") % 7) - 3.5).alias("regularMarketChangePercent"), F.lit(1000).alias("regularMarketVolume"),
        F.when(F.col("p_size") % 2 == 0, "GBp").otherwise("not a unit!").alias("currency"))
    symbol = F.concat(F.lit("p"), "p_partkey")
    body = js(finance=F.struct(F.array(F.struct(F.array(quote("ETF", F.lit("FUND")), quote("EQUITY", F.lit("bad symbol")), quote("EQUITY", symbol), quote("EQUITY", F.upper(symbol))).alias("quotes"))).alias("result")))
    out = catalogs.normalize_quotes(parts(spark, folder).select(F.col("p_partkey").alias("payload_id"), F.lit("").alias("url"), body.alias("body")))
    a = F.col("attributes")
    return out.select("payload_id", "id", "title", a["marketPrice"].alias("price"), a["changePercent"].alias("change_percent"), a["volume"].alias("volume"), a["currency"].alias("currency"))


@query("""with l as (select l_orderkey * 100 + l_linenumber as k, l_shipdate, floor(l_extendedprice * 100000000.0 + 0.5) / 100000000.0 as close, cast(l_quantity as bigint) as volume, l_suppkey from lineitem)
select k as payload_id, epoch(l_shipdate)::bigint as second, close, volume, 'S' || l_suppkey as symbol from l""")
def payload_charts(spark, folder):
    """Every order line as a chart of parallel arrays with an empty and an undated point."""
    l = dealt(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"))
    at = F.unix_seconds("l_shipdate")
    quote = F.struct(F.array(F.lit(None).cast("double"), F.col("l_extendedprice"), F.col("l_extendedprice")).alias("close"), F.array(F.lit(None).cast("double"), F.col("l_quantity"), F.lit(1.0)).alias("volume"))
    # JSON nulls inside the arrays keep their places.
    result = F.struct(F.struct(F.concat(F.lit("S"), "l_suppkey").alias("symbol")).alias("meta"), F.array(at - 86400, at, F.lit(None).cast("long")).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    out = catalogs.chart_points(l.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("payload_id"), body.alias("body")))
    return out.select("payload_id", F.unix_seconds("ts").alias("second"), "close", "volume", "symbol")


@query(f"""with {DOCS_SQL} select doc_id as payload_id, 'v' || lpad(cast(doc_id as varchar), 10, '0') as id, 'Video ' || doc_id as title, source as author, 3661::bigint as seconds, 1234567::bigint as views, '3 weeks ago' as shown from d where doc_id % 3 = 0""")
def payload_videos(spark, folder):
    """Every document as a nested video payload, filtered by platform and creator."""
    d = documents(spark, folder)
    runs = lambda c: F.struct(F.array(F.struct(c.alias("text"))).alias("runs"))
    code = F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    video = F.struct(code.alias("videoId"), runs(F.concat(F.lit("Video "), "doc_id")).alias("title"), runs(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit("someone"))).alias("ownerText"),
                     F.struct(F.lit("1:01:01").alias("simpleText")).alias("lengthText"), F.struct(F.lit("1,234,567 views").alias("simpleText")).alias("viewCountText"),
                     F.struct(F.lit("3 weeks ago").alias("simpleText")).alias("publishedTimeText"))
    body = js(contents=F.struct(F.array(F.struct(F.struct(F.array(F.struct(video.alias("videoRenderer"))).alias("items")).alias("section"))).alias("list")), again=F.struct(video.alias("videoRenderer")))
    out = catalogs.normalize_videos(d.select(F.col("doc_id").alias("payload_id"), F.lit("").alias("url"), body.alias("body")))
    known = filter_platform(out, "youtube").filter(F.col("author") != "someone")
    a = F.col("attributes")
    return known.select("payload_id", "id", "title", "author", a["durationSeconds"].alias("seconds"), a["viewCount"].alias("views"), a["publishedAtDisplay"].alias("shown"))


@query(f"""with {DOCS_SQL} select doc_id, lang from d where lang = 'fr'""")
def creator_filter(spark, folder):
    """Exact creator names after compatibility normalization."""
    d = documents(spark, folder).withColumn("author", F.concat(F.lit("@Ｓtudio - "), F.upper("lang")))
    return filter_creator(d, "studio fr").select("doc_id", "lang")


POSTS_SQL = f"""{DOCS_SQL}, p as (select doc_id as payload_id, source, lang, plain from d where {FILLED_SQL})"""


@query(f"""with {POSTS_SQL} select payload_id, 'bluesky' as source, cast(payload_id as varchar) as id, 'Ann (@' || source || '.social)' as author, '2024-02-03T04:05:06.000Z' as "publishedAt", payload_id as likes, lang || '|tag' as hashtags, null as media_type from p
union all select payload_id, 'mastodon', cast(payload_id as varchar), 'Ann (@' || source || '@m.example.org)', '2024-02-03T04:05:06.000Z', payload_id, lang || '|tag', 'mixed' from p
union all select payload_id, 'x', cast(payload_id as varchar), 'Ann (@' || source || ')', '2024-02-03T04:05:06.000Z', payload_id, lang || '|tag', 'image' from p
union all select payload_id, 'tiktok', cast(payload_id as varchar), 'Ann (@' || source || ')', '2024-02-03T04:05:06.000Z', payload_id, lang || '|tag', 'video' from p
union all select payload_id, 'instagram', 'C' || payload_id, '@' || source, '2024-02-03T04:05:06.000Z', payload_id, lang || '|tag', 'carousel' from p""")
def payload_social(spark, folder):
    """Every document as a post of five social sites."""
    d = documents(spark, folder).filter(FILLED)
    key = F.col("doc_id").cast("string")
    user, when = F.col("source"), F.lit("2024-02-03T04:05:06Z")
    named = lambda name: [F.struct(F.col("lang").alias(name)), F.struct(F.lit("tag").alias(name)), F.struct(F.col("lang").alias(name))]
    rows = lambda url, body: d.select(F.col("doc_id").alias("payload_id"), url.alias("url"), body.alias("body"))
    handle = F.concat(user, F.lit(".social"))
    bluesky = js(thread=F.struct(F.struct(
        F.struct(F.col("plain").alias("text"), when.alias("createdAt"), F.array(F.col("lang"), F.lit("#tag")).alias("tags")).alias("record"),
        F.struct(handle.alias("handle"), F.lit("Ann").alias("displayName")).alias("author"), F.col("doc_id").alias("likeCount")).alias("post")))
    attachment = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit("https://m.example.org/1").alias("url"))
    mastodon = js(id=key, content=F.concat(F.lit("<p>"), xml_text(F.col("plain")), F.lit("</p>")), created_at=when, account=F.struct(user.alias("acct"), F.lit("Ann").alias("display_name")),
                  media_attachments=F.array(attachment("image"), attachment("gifv")), tags=F.array(*named("name")), favourites_count=F.col("doc_id"))
    x = js(text=F.col("plain"), created_at=when, user=F.struct(user.alias("screen_name"), F.lit("Ann").alias("name")), favorite_count=F.col("doc_id"), entities=F.struct(F.array(*named("text")).alias("hashtags")),
           mediaDetails=F.array(F.struct(F.lit("photo").alias("type"), F.lit("https://i.example.org/1.jpg").alias("media_url_https"))))
    item = F.struct(key.alias("id"), F.col("plain").alias("desc"), F.lit("1706933106").alias("createTime"), F.struct(user.alias("uniqueId"), F.lit("Ann").alias("nickname")).alias("author"),
                    F.struct(F.col("doc_id").alias("diggCount")).alias("stats"), F.array(*named("title")).alias("challenges"))
    scope = F.to_json(F.struct(F.struct(F.struct(F.struct(item.alias("itemStruct")).alias("itemInfo")).alias("webapp.video-detail")).alias("__DEFAULT_SCOPE__")))
    tiktok = F.concat(F.lit('<html><script id="__UNIVERSAL_DATA_FOR_REHYDRATION__" type="application/json">'), scope, F.lit("</script></html>"))
    caption = F.concat("plain", F.lit(" #"), "lang", F.lit(" #tag #"), "lang")
    node = F.struct(F.lit("GraphSidecar").alias("__typename"), F.struct(user.alias("username")).alias("owner"), F.lit(1706933106).alias("taken_at_timestamp"), F.struct(F.col("doc_id").alias("count")).alias("edge_media_preview_like"),
                    F.struct(F.array(F.struct(F.struct(caption.alias("text")).alias("node"))).alias("edges")).alias("edge_media_to_caption"))
    context = F.to_json(F.struct(F.struct(node.alias("shortcode_media")).alias("gql_data")))
    escaped = F.regexp_extract(F.to_json(F.struct(context.alias("v"))), r'^\{"v":(.*)\}$', 1)
    instagram = F.concat(F.lit('<script>init({"contextJSON":'), escaped, F.lit("})</script>"))
    posts = [
        social.normalize_bluesky(rows(F.concat(F.lit("https://bsky.app/profile/a/post/"), key), bluesky)),
        social.normalize_mastodon(rows(F.concat(F.lit("https://m.example.org/@a/"), key), mastodon)),
        social.normalize_x(rows(F.concat(F.lit("https://x.com/a/status/"), key), x)),
        social.normalize_tiktok(rows(F.concat(F.lit("https://www.tiktok.com/@a/video/"), key), tiktok)),
        social.normalize_instagram(rows(F.concat(F.lit("https://www.instagram.com/p/C"), key, F.lit("/")), instagram)),
    ]
    out = posts[0]
    for more in posts[1:]:
        out = out.unionByName(more)
    a = F.col("attributes")
    return out.select("payload_id", "source", "id", "author", "publishedAt", a["likeCount"].alias("likes"), F.array_join(a["hashtags"], "|").alias("hashtags"), a["mediaType"].alias("media_type"))


@query(f"""with v as (select p_partkey, p_partkey % 6 as k, {CENTS_SQL} as cents from part)
select p_partkey, case k when 1 then 'attributes.price:too_small' when 2 then 'attributes.currency:invalid_format' when 3 then 'source:invalid_value' when 4 then 'attributes.handle:unrecognized_key' when 5 then 'url:invalid_format' else '' end as violations from v""")
def entity_validation(spark, folder):
    """Every part as an entity, five of six broken in one way each."""
    from factloom.sources.entities import entity_rows

    k = F.col("p_partkey") % 6
    rows = entity_rows(
        parts(spark, folder), ["p_partkey"], type="product", source=F.when(k == 3, "nowhere").otherwise("web"), method="product-jsonld", title=F.col("p_name"), content=F.col("p_name"),
        url=F.when(k == 5, F.lit("not a url")).otherwise(F.lit("https://e.example.com/")), attributes={
            "price": F.when(k == 1, F.lit(-1)).otherwise(cents()), "currency": F.when(k == 2, "eur").otherwise("EUR"), "handle": F.when(k == 4, "@x")})
    checked = quality.check_entities(rows)
    return checked.select("p_partkey", F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v["path"], v["code"])), ",").alias("violations"))


@query("""with w as (select distinct user_id as id from events), a as (select c_custkey as id, c_name as name from customer where c_custkey % 2 = 0), b as (select s_suppkey as id, s_name as name from supplier)
select w.id, coalesce(a.name, b.name) as name, case when a.id is not null then 0 when b.id is not null then 1 end::bigint as source_rank from w left join a using (id) left join b using (id)""")
def exact_id_rescue(spark, folder):
    """An id is looked up in the first source that knows it."""
    wanted = table(spark, folder, "events").select(F.col("user_id").alias("id")).distinct()
    first = table(spark, folder, "customer").filter(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    second = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return rescue_by_id(wanted, [first, second], "id").select("id", "name", "source_rank")


@query(f"""with {DOCS_SQL} select doc_id, '## ' || lang || chr(10) || chr(10) || '- ' || source || chr(10) || '- [link](https://h.example.org/a)' as markdown from d""")
def fragment_to_markdown(spark, folder):
    """H4: a fragment per document; scripts vanish and links become absolute."""
    html = F.concat(F.lit("<script>x()</script><h2>"), "lang", F.lit("</h2><ul><li>"), "source", F.lit('</li><li><a href="a">link</a></li></ul><img src="data:x">'))
    return documents(spark, folder).select("doc_id", fragment_markdown(html, F.lit("https://h.example.org/")).alias("markdown"))
