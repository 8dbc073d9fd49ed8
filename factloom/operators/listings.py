"""Products, product lists, marketplace cards and blog lists found in the node array of a page.

Every function is a column expression over one row, so a page never meets another page in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from factloom.functions import let
from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import parse_date
from factloom.functions.dom import attr, has_class, node_text, subtree

MAX_ITEMS = 50
# A page lists something if it shows so many of them.
MIN_LISTED = 2


def json_items(value: Column) -> Column:
    """JSON texts of a list, or the single value as a list; empty when null."""
    items = let(value, lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v)))
    return F.coalesce(items, F.array().cast("array<string>"))


def json_text(obj: Column, *paths: str) -> Column:
    """Plain text of the first path that holds a scalar."""
    scalar = lambda v: T.blank_to_null(T.strip_tags(F.when(~v.rlike(r"^[\[{]"), v)))
    return F.coalesce(*[let(F.get_json_object(obj, p), scalar) for p in paths])


def named(value: Column) -> Column:
    """Name of a JSON value: a text, an object's name, or a list of those joined."""
    names = F.transform(json_items(value), lambda x: F.when(
        x.startswith("{"), json_text(x, "$.name")).otherwise(T.blank_to_null(T.strip_tags(x))))
    return T.blank_to_null(F.array_join(F.filter(names, lambda n: n.isNotNull()), ", "))


def first_node(inner: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(inner, test), F.lit(0))


def first_value(nodes: Column, inner: Column, tests: list[Callable[[Column], Column]]) -> Column:
    """Content attribute or text of the first match of the first test that gives any."""
    value = lambda node: F.coalesce(T.as_value(attr(node, "content")), T.as_value(node_text(nodes, node)))
    return F.coalesce(*[let(first_node(inner, test), value) for test in tests])


def itemprop(name: str) -> Callable[[Column], Column]:
    return lambda n: F.coalesce(attr(n, "itemprop") == name, F.lit(False))


def class_is(name: str) -> Callable[[Column], Column]:
    return lambda n: has_class(n, name)


def class_like(part: str) -> Callable[[Column], Column]:
    return lambda n: F.coalesce(attr(n, "class").contains(part), F.lit(False))


def tag_is(*names: str) -> Callable[[Column], Column]:
    return lambda n: n["tag"].isin(*names)


def _ancestors(nodes: Column, node: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(nodes, lambda a: (a["id"] < node["id"]) & (a["stop"] > node["id"]) & test(a))


def _unique_by(items: Column, field: str, maximum: int) -> Column:
    first = lambda rows: F.filter(
        rows, lambda x, i: x[field].isNotNull() & (F.array_position(F.transform(rows, lambda r: r[field]), x[field]) == i + 1))
    return F.slice(let(items, first), 1, maximum)


def listed(items: Column) -> Column:
    """The items of a page that lists any: at least two, else null."""
    return F.when(F.size(items) >= MIN_LISTED, items)


def listing_title(nodes: Column, fallback: str) -> Column:
    in_main = first_value(nodes, subtree(nodes, first_node(nodes, tag_is("main"))), [tag_is("h1")])
    return F.coalesce(in_main, first_value(nodes, nodes, [tag_is("h1"), tag_is("title")]), F.lit(fallback))


def _is_card(nodes: Column) -> Callable[[Column], Column]:
    def test(n: Column) -> Column:
        inside = F.exists(nodes, lambda a: (a["id"] < n["id"]) & (a["stop"] > n["id"]) & has_class(a, "products"))
        typed = F.coalesce(attr(n, "itemtype").isin("https://schema.org/Product", "http://schema.org/Product"), F.lit(False))
        product = has_class(n, "product")
        return (
            typed | (product & (has_class(n, "tile") | (n["tag"] == "li") | inside))
            | has_class(n, "product-card") | attr(n, "data-product-id").isNotNull()
        )

    return test


# A page without two of these marks cannot hold a product list; it is not parsed into nodes for one.
CARD_MARK = r"(?i)schema\.org/Product|class\s*=\s*[\"'][^\"']*\bproduct\b|product-card|data-product-id"


def may_list_products(html: Column) -> Column:
    return F.regexp_count(html, F.lit(CARD_MARK)) >= 2


def product_cards(nodes: Column, page: Column) -> Column:
    """Product cards of a page: own-site link, title, price and picture; unique by address, at most 50."""
    linked = lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull()
    source = lambda n: F.coalesce(T.as_value(attr(n, "src")), T.as_value(attr(n, "data-src")))
    drawn = lambda n: (n["tag"] == "img") & F.coalesce(~source(n).rlike(r"(?i)\.svg(?:\?|$)"), F.lit(False))

    def read(card: Column, inner: Column) -> Column:
        """What the card shows, before it is interpreted."""
        return F.struct(
            card.alias("card"),
            first_node(inner, lambda n: linked(n) & attr(n, "data-product-name").isNotNull()).alias("named"),
            first_node(inner, itemprop("url")).alias("marked"), first_node(inner, linked).alias("link"),
            first_node(inner, drawn).alias("image"),
            first_value(nodes, inner, [itemprop("name"), class_is("product-title"), class_is("product-name"),
                                       class_is("h3"), tag_is("h2"), tag_is("h3")]).alias("heading"),
            first_value(nodes, inner, [itemprop("price"), class_is("currentprice"), class_is("price"), class_like("price")]).alias("display"),
            first_value(nodes, inner, [itemprop("priceCurrency")]).alias("currency"),
            first_value(nodes, inner, [itemprop("brand")]).alias("brand"),
        )

    def interpret(c: Column) -> Column:
        href = F.coalesce(T.as_value(attr(c["marked"], "content")), T.as_value(attr(c["marked"], "href")),
                          T.as_value(attr(c["named"], "href")), attr(c["link"], "href"))
        target = let(href, lambda h: U.absolute_url(F.when(~h.rlike(r"^\s*(?i:javascript:|#)"), h), page))
        own = let(target, lambda t: F.when(U.is_http(t) & (U.origin(t) == U.origin(page)), t))
        lowest = attr(c["card"], "data-pricemin")
        major = F.coalesce(let(lowest, lambda v: F.when(v.rlike(r"^\d+(\.\d+)?$"), v.try_cast("decimal(30,8)"))), N.decimal_amount(c["display"]))
        alt = T.as_value(T.collapse(attr(c["image"], "alt")))
        label = F.coalesce(T.as_value(attr(c["card"], "data-product-id")), T.as_value(attr(c["card"], "data-asin")), attr(c["card"], "id"))
        return F.struct(
            c.alias("c"), own.alias("url"), alt.alias("alt"), major.alias("major"),
            F.coalesce(T.as_value(T.collapse(attr(c["named"], "data-product-name"))), c["heading"], alt).alias("title"),
            N.currency_from_text(c["currency"], c["display"]).alias("currency"), T.as_value(T.collapse(label)).alias("label"),
            let(U.absolute_url(source(c["image"]), page), lambda u: F.when(U.is_http(u), u)).alias("image_url"),
        )

    def finish(v: Column) -> Column:
        scale = F.when(v["currency"] == "JPY", F.lit(1)).otherwise(F.lit(100))
        price = F.floor(v["major"] * scale + F.lit("0.5").cast("decimal(3,1)")).cast("long")
        return F.struct(
            F.coalesce(v["label"], U.last_segment(v["url"])).alias("id"), v["url"].alias("url"), v["title"].alias("title"),
            F.coalesce(T.as_value(T.collapse(attr(v["c"]["named"], "data-product-brand"))), v["c"]["brand"]).alias("brand"),
            T.as_value(F.regexp_replace(T.collapse(attr(v["c"]["named"], "data-product-category")), "/+$", "")).alias("category"),
            price.alias("price"), v["currency"].alias("currency"),
            F.when(v["major"].isNotNull(), F.coalesce(v["c"]["display"], v["major"].cast("string"))).alias("price_display"),
            v["image_url"].alias("image_url"), F.coalesce(v["alt"], v["title"]).alias("image_alt"),
        )

    seen = F.transform(F.filter(nodes, _is_card(nodes)), lambda card: let(subtree(nodes, card), lambda inner: read(card, inner)))
    usable = F.filter(F.transform(seen, interpret), lambda v: v["url"].isNotNull() & v["title"].isNotNull())
    return _unique_by(F.transform(usable, finish), "url", MAX_ITEMS)


def product_card_markdown(item: Column) -> Column:
    e = T.escape_markdown
    line = lambda label, v: F.when(v.isNotNull(), F.concat(F.lit(label), v))
    return T.join_present(
        "\n\n", F.concat(F.lit("# "), e(item["title"])), line("Brand: ", e(item["brand"])),
        line("Category: ", e(item["category"])), line("Price: ", e(item["price_display"])),
        F.when(item["image_url"].isNotNull(), F.concat(F.lit("!["), e(item["title"]), F.lit("]("), item["image_url"], F.lit(")"))),
        F.concat(F.lit("[View product]("), item["url"], F.lit(")")),
    )


def blog_items(nodes: Column, page: Column) -> Column:
    """Posts that a list page links from its headings; unique by address, at most 50."""
    main = first_node(nodes, tag_is("main"))
    scope = let(main, lambda m: F.when(m.isNotNull(), subtree(nodes, m)).otherwise(nodes))
    headings = F.filter(scope, lambda n: n["tag"].isin("h2", "h3", "h4") | itemprop("headline")(n))
    link = lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull()
    holder = lambda a: a["tag"].isin("article", "li") | F.coalesce(attr(a, "itemtype").rlike("/(Article|BlogPosting)$"), F.lit(False))

    def anchored(heading: Column) -> Column:
        anchor = F.when(link(heading), heading).otherwise(first_node(subtree(nodes, heading), link))
        return F.struct(heading.alias("heading"), anchor.alias("anchor"))

    def boxed(v: Column) -> Column:
        href = attr(v["anchor"], "href")
        absolute = let(href, lambda h: U.without_fragment(U.absolute_url(F.when(~h.rlike(r"^\s*(?i:javascript:|mailto:|tel:|#)"), h), page)))
        url = let(absolute, lambda t: F.when(U.is_http(t) & (U.host(t) == U.host(page)) & (t != page), t))
        title = F.coalesce(T.as_value(T.collapse(attr(v["anchor"], "aria-label"))), T.as_value(T.collapse(attr(v["anchor"], "title"))),
                           T.as_value(node_text(nodes, v["anchor"])))
        above = _ancestors(nodes, v["heading"], lambda a: F.lit(True))
        box = F.coalesce(F.try_element_at(_ancestors(nodes, v["anchor"], holder), F.lit(-1)),
                         let(above, lambda a: F.coalesce(F.try_element_at(a, F.lit(-2)), F.try_element_at(a, F.lit(-1)))), v["heading"])
        return F.struct(url.alias("url"), title.alias("title"), box.alias("box"))

    def item(v: Column, inner: Column) -> Column:
        text_of = lambda test: T.as_value(node_text(nodes, first_node(inner, test)))
        image = first_node(inner, lambda n: (n["tag"] == "img") & (attr(n, "src").isNotNull() | attr(n, "data-src").isNotNull()))
        stamp = F.coalesce(
            T.as_value(attr(first_node(inner, lambda n: (n["tag"] == "time") & attr(n, "datetime").isNotNull()), "datetime")),
            attr(first_node(inner, itemprop("datePublished")), "content"))
        picture = let(image, lambda im: U.absolute_url(F.coalesce(T.as_value(attr(im, "src")), attr(im, "data-src")), page))
        return F.struct(
            U.last_segment(v["url"]).alias("id"), v["url"].alias("url"), v["title"].alias("title"),
            text_of(lambda n: itemprop("description")(n) | class_like("description")(n) | class_like("excerpt")(n)
                    | class_like("summary")(n)).alias("description"),
            text_of(lambda n: F.coalesce(attr(n, "rel") == "author", F.lit(False)) | itemprop("author")(n)
                    | class_like("author")(n)).alias("author"),
            parse_date(stamp).alias("published_at"),
            let(picture, lambda u: F.when(U.is_http(u), u)).alias("image_url"),
            F.coalesce(T.as_value(T.collapse(attr(image, "alt"))), v["title"]).alias("image_alt"),
        )

    found = F.filter(F.transform(F.transform(headings, anchored), boxed), lambda v: (
        v["url"].isNotNull() & (F.char_length(v["title"]) >= 8)
        & ~v["title"].rlike(r"^(?i)(?:learn more|read more|view all|see all|more)$")
    ))
    return _unique_by(F.transform(found, lambda v: let(subtree(nodes, v["box"]), lambda inner: item(v, inner))), "url", MAX_ITEMS)


def blog_item_markdown(item: Column) -> Column:
    return T.join_present(
        "\n\n", F.concat(F.lit("# "), T.escape_markdown(item["title"])), T.escape_markdown(item["description"]),
        F.concat(F.lit("[Read article]("), item["url"], F.lit(")")),
    )


def spec_features(nodes: Column) -> Column:
    """`label: detail` lines of tables, definition lists and specification rows; distinct, at most 100."""
    cell = tag_is("th", "td")

    def table_row(row: Column) -> Column:
        cells = F.transform(F.filter(subtree(nodes, row), cell), lambda c: node_text(nodes, c))
        return F.struct(F.get(cells, F.lit(0)).alias("label"),
                        F.when(F.size(cells) >= 2, F.array_join(F.slice(cells, 2, F.size(cells)), " / ")).alias("detail"))

    def term(dt: Column) -> Column:
        after = F.get(F.filter(nodes, lambda n: (n["parent"] == dt["parent"]) & (n["id"] >= dt["stop"]) & (n["tag"] != "#text")), F.lit(0))
        return F.struct(node_text(nodes, dt).alias("label"), F.when(after["tag"] == "dd", node_text(nodes, after)).alias("detail"))

    def spec_row(row: Column) -> Column:
        pick = lambda test: node_text(nodes, F.get(F.filter(subtree(nodes, row), test), F.lit(0)))
        return F.struct(
            pick(lambda n: has_class(n, "label") | has_class(n, "name") | n["tag"].isin("dt", "th")).alias("label"),
            pick(lambda n: has_class(n, "value") | n["tag"].isin("dd", "td")).alias("detail"),
        )

    in_table = lambda n: (n["tag"] == "tr") & F.exists(nodes, lambda a: (a["id"] < n["id"]) & (a["stop"] > n["id"]) & (a["tag"] == "table"))
    in_list = lambda n: (n["tag"] == "dt") & F.exists(nodes, lambda a: (a["id"] < n["id"]) & (a["stop"] > n["id"]) & (a["tag"] == "dl"))
    marked = lambda n: (has_class(n, "datarow") | has_class(n, "specification") | has_class(n, "spec-row")
                        | attr(n, "data-specification").isNotNull())
    pairs = F.concat(
        F.transform(F.filter(nodes, in_table), table_row),
        F.transform(F.filter(nodes, in_list), term),
        F.transform(F.filter(nodes, marked), spec_row),
    )
    kept = F.filter(pairs, lambda p: (p["label"] != "") & (p["detail"] != "") & (p["label"] != p["detail"])
                    & (F.char_length(p["label"]) <= 120) & (F.char_length(p["detail"]) <= 600))
    return F.slice(F.array_distinct(F.transform(kept, lambda p: F.concat_ws(": ", p["label"], p["detail"]))), 1, 100)


def product_object(objects: Column) -> Column:
    """The first object of type Product."""
    is_product = lambda o: F.exists(
        json_items(F.get_json_object(o, "$['@type']")), lambda t: F.lower(T.strip_tags(t)) == "product")
    return F.get(F.filter(objects, is_product), F.lit(0))


def availability(offer: Column) -> Column:
    state = F.element_at(F.split(json_text(offer, "$.availability"), "/"), -1)
    return let(state, lambda s: F.when(F.char_length(s).between(1, 80), s))


def offer_price(offer: Column) -> Column:
    """struct(price, currency, display) in minor units, null without a valid amount and currency."""
    amount = F.coalesce(F.get_json_object(offer, "$.price"), F.get_json_object(offer, "$.priceSpecification.price"))
    currency = F.upper(json_text(offer, "$.priceCurrency", "$.priceSpecification.priceCurrency"))

    def measured(v: Column) -> Column:
        units = F.when(v["currency"].rlike("^[A-Z]{3}$"), N.minor_units(v["amount"], v["currency"]))
        return F.struct(units.alias("price"), v["currency"].alias("currency"), v["amount"].try_cast("decimal(30,8)").alias("shown"))

    def shown(v: Column) -> Column:
        whole = N.currency_digits(v["currency"]) == 0
        text = F.when(whole, v["shown"].cast("decimal(30,0)").cast("string")).otherwise(v["shown"].cast("decimal(30,2)").cast("string"))
        return F.when(v["price"].isNotNull(), F.struct(
            v["price"].alias("price"), v["currency"].alias("currency"), F.concat_ws(" ", text, v["currency"]).alias("display")))

    return let(let(F.struct(amount.alias("amount"), currency.alias("currency")), measured), shown)


def product_detail(product: Column, page: Column) -> Column:
    """struct of a product object: brand, seller, variants, cheapest price, availability, rating, pictures."""
    raw = F.slice(F.filter(json_items(F.get_json_object(product, "$.offers")), lambda o: o.startswith("{")), 1, 100)
    # Each offer is read once: its price, state, seller and what it offers.
    offers = F.transform(raw, lambda o: F.struct(
        offer_price(o).alias("price"), availability(o).alias("state"), named(F.get_json_object(o, "$.seller")).alias("seller"),
        json_text(o, "$.itemOffered.sku", "$.sku").alias("sku"),
        T.join_present(" / ", json_text(o, "$.itemOffered.color", "$.color"), json_text(o, "$.itemOffered.size", "$.size")).alias("look"),
        json_text(o, "$.itemOffered.name").alias("name"),
        json_text(o, "$.itemOffered.gtin", "$.itemOffered.gtin8", "$.itemOffered.gtin12", "$.itemOffered.gtin13",
                  "$.itemOffered.gtin14").alias("gtin"),
    ))

    def variants_of(rows: Column) -> Column:
        variants = F.transform(rows, lambda o: F.struct(
            F.coalesce(T.blank_to_null(o["look"]), o["name"], o["sku"]).alias("title"), o["sku"].alias("sku"), o["gtin"].alias("gtin"),
            o["price"]["price"].alias("price"), o["price"]["currency"].alias("currency"), o["price"]["display"].alias("price_display"),
            F.when(o["state"].isNotNull(), F.lower(o["state"]) == "instock").alias("available"),
        ))
        return F.filter(variants, lambda v: v["title"].isNotNull())

    def cheapest(rows: Column) -> Column:
        priced = F.filter(rows, lambda r: r["price"].isNotNull())
        return F.array_min(F.transform(priced, lambda r, i: F.struct(
            r["price"].alias("price"), i.alias("i"), r["currency"].alias("currency"), r["price_display"].alias("display"))))

    def summed(rows: Column) -> Column:
        prices = F.transform(F.filter(rows, lambda o: o["price"].isNotNull()), lambda o: F.struct(
            o["price"]["price"].alias("price"), o["price"]["currency"].alias("currency"), o["price"]["display"].alias("price_display")))
        states = F.filter(F.transform(rows, lambda o: o["state"]), lambda s: s.isNotNull())
        sellers = F.filter(F.transform(rows, lambda o: o["seller"]), lambda s: s.isNotNull())
        return F.struct(
            variants_of(rows).alias("variants"), F.coalesce(cheapest(variants_of(rows)), cheapest(prices)).alias("best"),
            F.get(sellers, F.lit(0)).alias("seller"),
            F.when(F.exists(states, lambda s: F.lower(s) == "instock"), F.lit("InStock")).otherwise(F.get(states, F.lit(0))).alias("state"),
        )

    def picture(image: Column) -> Column:
        nested = image.startswith("{")
        source = F.when(nested, F.coalesce(F.get_json_object(image, "$.contentUrl"), F.get_json_object(image, "$.url"))).otherwise(image)
        pick = lambda path: F.when(nested, N.as_positive(F.get_json_object(image, path)))
        return F.struct(
            F.lit("image").alias("type"), let(U.absolute_url(source, page), lambda u: F.when(U.is_http(u), u)).alias("url"),
            F.coalesce(F.when(nested, json_text(image, "$.caption")), json_text(product, "$.name")).alias("alt"),
            pick("$.width").alias("width"), pick("$.height").alias("height"),
        )

    bound = F.struct(
        json_text(product, "$.name").alias("title"), json_text(product, "$.sku").alias("sku"), let(offers, summed).alias("offers"),
        N.as_number(F.get_json_object(product, "$.aggregateRating.ratingValue")).alias("rating"),
    )
    return let(bound, lambda b: F.when(b["title"].isNotNull(), F.struct(
        F.coalesce(b["sku"], U.last_segment(page)).alias("id"), b["title"].alias("title"),
        named(F.get_json_object(product, "$.brand")).alias("brand"), b["offers"]["seller"].alias("seller"),
        json_text(product, "$.category").alias("category"), b["sku"].alias("sku"),
        json_text(product, "$.gtin", "$.gtin8", "$.gtin12", "$.gtin13", "$.gtin14").alias("gtin"),
        b["offers"]["best"]["price"].alias("price"), b["offers"]["best"]["currency"].alias("currency"),
        b["offers"]["best"]["display"].alias("price_display"), b["offers"]["state"].alias("availability"),
        F.when(b["rating"] >= 0, b["rating"]).alias("rating"),
        N.as_count(F.coalesce(F.get_json_object(product, "$.aggregateRating.reviewCount"),
                              F.get_json_object(product, "$.aggregateRating.ratingCount"))).alias("review_count"),
        json_text(product, "$.description").alias("description"), b["offers"]["variants"].alias("variants"),
        _unique_by(F.transform(json_items(F.get_json_object(product, "$.image")), picture), "url", 12).alias("images"),
    )))


def variant_lines(variants: Column) -> Column:
    """One Markdown line per variant."""
    e = T.escape_markdown
    return F.transform(variants, lambda v: F.array_join(T.present([
        F.concat(F.lit("- "), e(v["title"])), F.concat(F.lit("SKU "), e(v["sku"])), v["price_display"],
        F.when(v["available"], F.lit("In stock")).when(~v["available"], F.lit("Out of stock")),
    ]), " — "))


# Where marketplace pages show cards. Kind, card test, title tests, key pattern and most items.
CARD_RULES = {
    "search": {"limit": 20, "titles": [tag_is("h2"), lambda n: F.coalesce(attr(n, "data-cy") == "title-recipe", F.lit(False))]},
    "list": {"limit": 50, "titles": [lambda n: F.coalesce(attr(n, "id").startswith("itemName"), F.lit(False)), tag_is("h2"),
                                     tag_is("h3"), class_is("a-text-bold")]},
}


def split_price(nodes: Column, inner: Column, currency: Column) -> Column:
    """struct(price, currency, display) of a card whose price has a whole and a fraction part, or is one text."""
    box = first_node(inner, class_is("a-price"))

    def read(b: Column) -> Column:
        parts = subtree(nodes, b)
        return F.struct(
            F.coalesce(first_value(nodes, parts, [class_is("a-offscreen")]), T.as_value(node_text(nodes, b))).alias("shown"),
            F.regexp_replace(first_value(nodes, parts, [class_is("a-price-whole")]), r"\D", "").alias("whole"),
            F.regexp_replace(F.coalesce(first_value(nodes, parts, [class_is("a-price-fraction")]), F.lit("")), r"\D", "").alias("part"),
            (N.currency_digits(currency) == 0).alias("plain"), currency.alias("currency"))

    def amount(v: Column) -> Column:
        number = F.trim(F.regexp_extract(v["shown"], r"\d[\d\s.,'’]*", 0))
        # A closing group of two digits is the fraction, other separators only group.
        cents = F.regexp_replace(F.regexp_replace(number, r"[.,](\d{2})\D*$", "#$1"), r"[^\d#]", "")
        text = F.when(v["plain"], F.regexp_replace(number, r"\D", "")).when(cents.contains("#"), F.regexp_replace(cents, "#", "")).otherwise(
            F.concat(cents, F.lit("00")))
        split = F.when(v["plain"], v["whole"]).otherwise(F.concat(v["whole"], F.substring(F.rpad(v["part"], 2, "0"), 1, 2)))
        price = F.coalesce(F.when(v["whole"] != "", split), text).try_cast("long")
        return F.when(price.isNotNull() & v["shown"].isNotNull() & v["currency"].isNotNull(),
                      F.struct(price.alias("price"), v["currency"].alias("currency"), v["shown"].alias("display")))

    return let(let(box, read), amount)


def marketplace_cards(nodes: Column, page: Column, kind: str) -> Column:
    """Cards of a marketplace search or list page, unique by product code."""
    rule = CARD_RULES[kind]
    if kind == "search":
        test = lambda n: F.coalesce(attr(n, "data-component-type") == "s-search-result", F.lit(False)) & attr(n, "data-asin").isNotNull()
    else:
        test = lambda n: (attr(n, "data-itemid").isNotNull() | attr(n, "data-asin").isNotNull()
                          | has_class(n, "a-carousel-card") | has_class(n, "product-card"))

    def item(card: Column, inner: Column) -> Column:
        link = first_node(inner, lambda n: (n["tag"] == "a") & F.coalesce(attr(n, "href").contains("/dp/"), F.lit(False)))
        code = F.coalesce(T.as_value(F.upper(T.collapse(attr(card, "data-asin")))),
                          F.upper(F.regexp_extract(attr(link, "href"), r"(?i)/dp/([a-z0-9]{10})(?:/|$)", 1)))
        image = first_node(inner, tag_is("img"))
        shown = [first_value(nodes, inner, rule["titles"])] + ([] if kind == "search" else [T.as_value(T.collapse(attr(image, "alt")))])
        stars = F.regexp_extract(first_value(nodes, inner, [class_is("a-icon-alt")]), r"\d+(?:[.,]\d+)?", 0)
        reviews = first_value(nodes, inner, [class_is("s-underline-text")])
        return F.struct(
            let(code, lambda c: F.when(c.rlike("^[A-Z0-9]{10}$"), c)).alias("id"), F.coalesce(*shown).alias("title"),
            split_price(nodes, inner, U.marketplace_currency(page)).alias("price"),
            F.regexp_replace(stars, ",", ".").try_cast("double").alias("rating"),
            F.regexp_replace(reviews, r"\D", "").try_cast("long").alias("review_count"),
            F.coalesce(U.public_url(attr(image, "data-old-hires")), U.public_url(attr(image, "src"))).alias("image_url"),
        )

    cards = F.transform(F.filter(nodes, test), lambda card: let(subtree(nodes, card), lambda inner: item(card, inner)))
    kept = _unique_by(F.filter(cards, lambda c: c["title"].isNotNull()), "id", rule["limit"])
    return F.transform(kept, lambda c: F.struct(
        c["id"].alias("id"), F.concat(U.origin(page), F.lit("/dp/"), c["id"]).alias("url"), c["title"].alias("title"),
        c["price"]["price"].alias("price"), c["price"]["currency"].alias("currency"), c["price"]["display"].alias("price_display"),
        c["rating"].alias("rating"), c["review_count"].alias("review_count"), c["image_url"].alias("image_url")))
