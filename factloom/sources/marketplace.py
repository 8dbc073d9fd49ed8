"""Marketplace pages to entity rows: product pages, search results and public lists.

Input rows have payload_id, url (the requested address) and body (markup).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import let, rows_of
from factloom.functions import html as H
from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dom import attr, dom_nodes, has_class, node_text, subtree
from factloom.operators import listings as L
from factloom.sources.entities import entity_rows, image, images

e = T.escape_markdown
Test = Callable[[Column], Column]

# Copy of pages that ask whether a visitor is human.
VERIFICATION_COPY = (
    "enter the characters you see below",
    "sorry, we just need to make sure you're not a robot",
    "sorry, we just need to make sure you are not a robot",
    "to discuss automated access to amazon data",
)
# Where product pages show a price, in order.
PRICE_BOXES = ("corePrice_feature_div", "corePriceDisplay_desktop_feature_div", "priceblock_ourprice", "priceblock_dealprice", "price_inside_buybox")
# Labels in front of a brand.
BRAND_LABEL = r"^(?i)(?:brand|marke|marque|marca|marchio|merk|märke)\s*:\s*"
BRAND_STORE = r"^(?i)(?:visit the|besuche den)\s+(.+?)(?:[- ]store)?$"
MAX_BULLETS, MAX_DETAILS, MAX_FEATURES, MAX_IMAGES, MAX_VARIANTS = 20, 40, 60, 12, 50


def is_verification(html: Column) -> Column:
    """A page that asks for proof of a human visitor stands in for the one asked for."""
    seen = F.lower(F.regexp_replace(H.visible_text(html), r"\s+", " "))
    return F.coalesce(F.greatest(*[seen.contains(copy) for copy in VERIFICATION_COPY]), F.lit(False))


def _id(*names: str) -> Test:
    return lambda n: F.coalesce(attr(n, "id").isin(*names), F.lit(False))


def _inside(nodes: Column, outer: Test) -> Column:
    """All nodes below any node that passes."""
    return F.flatten(F.transform(F.filter(nodes, outer), lambda n: subtree(nodes, n)))


def _text(nodes: Column, *tests: Test) -> Column:
    """Text of the first match of the first test that gives any."""
    return F.coalesce(*[let(L.first_node(nodes, test), lambda n: T.as_value(node_text(nodes, n))) for test in tests])


def _texts(nodes: Column, inner: Column, test: Test) -> Column:
    return F.transform(F.filter(inner, test), lambda n: node_text(nodes, n))


def _price(nodes: Column, scope: Column, currency: Column) -> Column:
    return L.split_price(nodes, scope, currency)


def _brand(nodes: Column) -> Column:
    po = _inside(nodes, lambda n: has_class(n, "po-brand"))
    shown = F.coalesce(_text(nodes, _id("bylineInfo"), _id("brand")), F.get(F.filter(_texts(nodes, po, lambda n: has_class(n, "po-break-word")), lambda t: t != ""), F.lit(0)))
    plain = F.regexp_replace(shown, BRAND_LABEL, "")
    return let(plain, lambda p: T.as_value(T.collapse(F.coalesce(T.blank_to_null(F.regexp_extract(p, BRAND_STORE, 1)), p))))


def _bullets(nodes: Column) -> Column:
    points = _inside(nodes, _id("feature-bullets"))
    inner = F.flatten(F.transform(F.filter(points, L.tag_is("li")), lambda li: F.filter(subtree(nodes, li), lambda n: has_class(n, "a-list-item"))))
    texts = F.transform(inner, lambda n: node_text(nodes, n))
    return F.slice(F.array_distinct(F.filter(texts, lambda t: (F.char_length(t) > 2) & ~t.rlike("^(?i)see more$"))), 1, MAX_BULLETS)


def _details(nodes: Column) -> Column:
    """`label: value` of the two kinds of detail tables."""
    rows = F.filter(_inside(nodes, _id("productDetails_detailBullets_sections1", "productDetails_techSpec_section_1")), L.tag_is("tr"))
    cell = lambda row, tag: node_text(nodes, L.first_node(subtree(nodes, row), L.tag_is(tag)))
    table = F.transform(rows, lambda r: F.struct(cell(r, "th").alias("label"), cell(r, "td").alias("detail")))
    items = F.filter(_inside(nodes, _id("detailBullets_feature_div")), L.tag_is("li"))

    def bullet(li: Column) -> Column:
        label = F.regexp_replace(node_text(nodes, L.first_node(subtree(nodes, li), lambda n: has_class(n, "a-text-bold"))), r"\s*:\s*$", "")
        return let(F.struct(label.alias("label"), node_text(nodes, li).alias("whole")), lambda v: F.struct(
            v["label"].alias("label"), T.collapse(F.regexp_replace(F.replace(v["whole"], v["label"], F.lit("")), r"^\s*:\s*", "")).alias("detail")))

    pairs = F.filter(F.concat(table, F.transform(items, bullet)), lambda p: (p["label"] != "") & (p["detail"] != "") & (p["label"] != p["detail"])
                     & (F.char_length(p["label"]) <= 120) & (F.char_length(p["detail"]) <= 500))
    return F.slice(F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(": ", p["label"], p["detail"]))), 1, MAX_DETAILS)


def _pictures(nodes: Column, title: Column) -> Column:
    """Pictures of a product, the landing picture first."""
    landing = L.first_node(nodes, _id("landingImage"))
    shape = lambda n, url: F.struct(url.alias("url"), T.collapse(attr(n, "alt")).alias("alt"), N.as_positive(attr(n, "width")).alias("width"), N.as_positive(attr(n, "height")).alias("height"))
    none = F.lit(None).cast("long")
    several = F.map_keys(F.from_json(attr(landing, "data-a-dynamic-image"), "map<string,string>"))
    first = let(landing, lambda n: F.array(shape(n, attr(n, "data-old-hires")), shape(n, attr(n, "src"))))
    more = F.transform(F.coalesce(several, F.array().cast("array<string>")), lambda u: F.struct(
        u.alias("url"), T.collapse(attr(landing, "alt")).alias("alt"), none.alias("width"), none.alias("height")))
    thumbs = F.transform(F.filter(_inside(nodes, _id("altImages", "imageBlock")), L.tag_is("img")), lambda n: shape(
        n, F.coalesce(attr(n, "data-old-hires"), attr(n, "data-src"), attr(n, "src"))))
    found = F.transform(F.concat(first, more, thumbs), lambda p: F.struct(
        U.public_url(p["url"]).alias("url"), F.coalesce(T.as_value(p["alt"]), title).alias("alt"), p["width"].alias("width"), p["height"].alias("height")))
    kept = let(found, lambda f: F.filter(f, lambda x, i: x["url"].isNotNull() & (F.array_position(F.transform(f, lambda y: y["url"]), x["url"]) == i + 1)))
    return F.slice(kept, 1, MAX_IMAGES)


def _variants(nodes: Column) -> Column:
    chosen = _inside(nodes, lambda n: F.coalesce((attr(n, "id") == "twister") | attr(n, "id").startswith("variation_"), F.lit(False)))
    rows = F.transform(F.filter(chosen, lambda n: attr(n, "data-asin").isNotNull()), lambda n: F.struct(
        F.upper(T.collapse(attr(n, "data-asin"))).alias("id"),
        T.collapse(F.coalesce(T.as_value(attr(n, "title")), T.as_value(attr(n, "aria-label")), node_text(nodes, n))).alias("title")))
    valid = F.filter(rows, lambda v: v["id"].rlike("^[A-Z0-9]{10}$") & F.char_length(v["title"]).between(1, 200))
    first = let(valid, lambda f: F.filter(f, lambda x, i: F.array_position(F.transform(f, lambda y: y["id"]), x["id"]) == i + 1))
    blank = F.lit(None)
    return F.transform(F.slice(first, 1, MAX_VARIANTS), lambda v: F.struct(
        v["id"].alias("id"), v["title"].alias("title"), v["id"].alias("sku"), blank.cast("string").alias("gtin"), blank.cast("long").alias("price"),
        blank.cast("string").alias("currency"), blank.cast("string").alias("priceDisplay"), blank.cast("long").alias("compareAtPrice"),
        blank.cast("string").alias("compareAtPriceDisplay"), blank.cast("boolean").alias("available")))


def normalize_products(payloads: DataFrame) -> DataFrame:
    """Product pages with price, earlier price, rating, bullets, details, pictures and variants; verification pages and empty ones give no row."""
    page = F.col("url")
    df = payloads.filter(~is_verification(F.col("body"))).withColumn("code", U.product_id(page)).withColumn("nodes", dom_nodes("body"))
    nodes, currency = F.col("nodes"), U.marketplace_currency(page)
    shared = H.meta_content(H.meta_tags(F.col("body")), [("property", "og:title")])
    df = df.withColumn("title", F.coalesce(_text(nodes, _id("productTitle")), T.as_value(T.collapse(shared))))
    # Each box with what is below it, and last the whole page; the first with a price counts.
    boxes = F.transform(F.array(*[F.lit(b) for b in PRICE_BOXES]), lambda b: F.flatten(F.transform(
        F.filter(nodes, lambda n: F.coalesce(attr(n, "id") == b, F.lit(False))), lambda n: F.slice(nodes, n["id"] + 1, n["stop"] - n["id"]))))
    df = df.withColumn("cost", F.get(F.filter(F.transform(F.concat(boxes, F.array(nodes)), lambda s: _price(nodes, s, currency)), lambda c: c.isNotNull()), F.lit(0)))
    before = _price(nodes, _inside(nodes, lambda n: has_class(n, "basisPrice")), currency)
    struck = _price(nodes, F.filter(nodes, lambda n: has_class(n, "a-text-price")), currency)
    df = df.withColumn("was", let(F.coalesce(before, struck), lambda w: F.when(w["price"] > F.col("cost")["price"], w)))
    shown = F.coalesce(F.col("cost")["display"], _text(nodes, *[_id(b) for b in PRICE_BOXES[2:]]))
    df = df.withColumn("shown", shown).withColumn("brand", _brand(nodes)).withColumn("bullets", F.slice(F.array_distinct(F.concat(_bullets(nodes), _details(nodes))), 1, MAX_FEATURES))
    star = L.first_node(nodes, _id("acrPopover"))
    stars = F.coalesce(T.as_value(T.collapse(F.coalesce(T.as_value(attr(star, "title")), attr(star, "aria-label")))), T.as_value(node_text(nodes, star)))
    stock = _inside(nodes, _id("availability"))
    state = F.coalesce(*[F.get(F.filter(_texts(nodes, stock, test), lambda t: t != ""), F.lit(0)) for test in (
        lambda n: has_class(n, "a-color-success"), lambda n: has_class(n, "a-color-price"), L.tag_is("span"))])
    sold = _text(nodes, _id("sellerProfileTriggerId"), _id("merchant-info"))
    trail = F.filter(_texts(nodes, _inside(nodes, _id("wayfinding-breadcrumbs_feature_div")), L.tag_is("a")), lambda t: t != "")
    df = df.withColumns({
        "stars": stars, "counted": _text(nodes, _id("acrCustomerReviewText")),
        "state": let(state, lambda s: F.when((F.char_length(s) <= 160) & ~s.rlike("[{}]"), s)),
        "seller": let(sold, lambda s: F.when((F.char_length(s) <= 300) & ~s.rlike(r"(?i)(?:P\.when|function\s*\()"), s)),
        "category": F.try_element_at(trail, F.lit(-1)), "pictures": _pictures(nodes, F.coalesce("title", F.lit("Product"))), "variants": _variants(nodes),
    }).filter(F.col("title").isNotNull() & (F.col("brand").isNotNull() | F.col("shown").isNotNull() | (F.size("bullets") > 0)))
    target = F.concat(U.origin(page), F.lit("/dp/"), "code")
    rating = F.regexp_replace(F.regexp_extract("stars", r"\d+(?:[.,]\d+)?", 0), ",", ".").try_cast("double")
    reviews = F.regexp_replace("counted", r"\D", "").try_cast("long")
    rated = F.when(F.col("stars").isNotNull(), F.concat(F.lit("Rating: "), e(F.col("stars")), F.coalesce(F.concat(F.lit(" — "), e(F.col("counted"))), F.lit("")))).otherwise(
        F.concat(F.lit("Reviews: "), e(F.col("counted"))))
    first = F.get("pictures", F.lit(0))["url"]
    content = T.join_present(
        "\n\n", F.concat(F.lit("# "), e(F.col("title"))), F.concat(F.lit("Brand: "), e(F.col("brand"))), F.concat(F.lit("Price: "), e(F.col("shown"))), rated,
        F.concat(F.lit("Availability: "), e(F.col("state"))), F.concat(F.lit("Seller: "), e(F.col("seller"))),
        F.concat(F.lit("!["), e(F.col("title")), F.lit("]("), first, F.lit(")")),
        F.when(F.size("bullets") > 0, F.concat(F.lit("## About this product\n\n"), F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), e(b))), "\n"))),
        F.concat(F.lit("[View on Amazon]("), target, F.lit(")")))
    cost, was = F.col("cost"), F.col("was")
    return entity_rows(
        df, ["payload_id"], type="product", source="amazon", method="amazon-html", id=F.col("code"), url=target, title=F.col("title"), author=F.col("brand"), content=content,
        media=images(F.col("pictures")), attributes={
            "productType": F.lit("physical"), "brand": F.col("brand"), "seller": F.col("seller"), "category": F.col("category"), "price": cost["price"],
            "currency": cost["currency"], "priceDisplay": cost["display"], "compareAtPrice": was["price"], "compareAtPriceDisplay": was["display"],
            "availability": F.col("state"), "rating": rating, "ratingScale": F.when(rating.isNotNull(), F.lit(5.0)), "reviewCount": reviews,
            "features": F.when(F.size("bullets") > 0, F.col("bullets")), "variants": F.when(F.size("variants") > 0, F.col("variants"))})


def card_items(payloads: DataFrame, kind: str) -> DataFrame:
    """Cards of search results (`search`) or of a public list (`list`) as product rows, with the title and author their page shows."""
    page = F.col("url")
    df = payloads.filter(~is_verification(F.col("body"))).withColumn("nodes", dom_nodes("body"))
    nodes = F.col("nodes")
    main = F.get(F.filter(_texts(nodes, _inside(nodes, L.tag_is("main")), L.tag_is("h1")), lambda t: t != ""), F.lit(0))
    heading = F.coalesce(_text(nodes, _id("profile-list-name"), _id("list-name")), main, _text(nodes, L.tag_is("h1")))
    by = _text(nodes, lambda n: has_class(n, "a-profile-name"), lambda n: F.coalesce(attr(n, "data-testid") == "storefront-name", F.lit(False)))
    rows = rows_of(df, ["payload_id", page.alias("page_url"), heading.alias("feed_title"), by.alias("feed_author")], L.marketplace_cards(nodes, page, kind), "c")
    c = F.col("c")
    rated = F.when(c["rating"].isNotNull(), F.concat(F.lit("Rating: "), F.regexp_replace(c["rating"].cast("string"), r"\.0$", "")))
    content = T.join_present(
        "\n\n", F.concat(F.lit("Price: "), e(c["price_display"])), rated if kind == "search" else F.lit(None).cast("string"),
        F.concat(F.lit("!["), e(c["title"]), F.lit("]("), c["image_url"], F.lit(")")), F.concat(F.lit("[View on Amazon]("), c["url"], F.lit(")")))
    return entity_rows(
        rows, ["payload_id", "page_url", "feed_title", "feed_author", "position"], type="product", source="amazon", method=f"amazon-{kind}-html", id=c["id"], url=c["url"], title=c["title"],
        content=content, media=image(c["image_url"], c["title"]), attributes={
            "productType": F.lit("physical"), "price": c["price"], "currency": c["currency"], "priceDisplay": c["price_display"], "rating": c["rating"],
            "ratingScale": F.when(c["rating"].isNotNull(), F.lit(5.0)), "reviewCount": c["review_count"]})
