"""Product, app, picture, place, quote, chart and video payloads to entity rows.

Input rows have payload_id, url and body (JSON text, or markup where said so).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T_
from pyspark.sql.functions import udf

from factloom.functions import let, rows_of
from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import LAST_SECOND, absolute_display_date, from_epoch_seconds, parse_date
from factloom.functions.dom import fragment_markdown, json_objects
from factloom.functions.html import ld_blocks
from factloom.operators import places as P
from factloom.operators.listings import json_items, json_text, named
from factloom.operators.market import normalize_symbol
from factloom.operators.ordered import keep_first
from factloom.sources.entities import entity_rows, image, images

J = F.get_json_object


def exploded(payloads: DataFrame, items: Column, limit: int | None = None) -> DataFrame:
    """One row per JSON item: payload_id, url, position, item."""
    shown = F.slice(items, 1, limit) if limit else items
    return rows_of(payloads, ["payload_id", "url", *[c for c in payloads.columns if c == "currency"]], shown, "item")


def storefront_currency(html: Column) -> Column:
    """Currency a shop page advertises."""
    patterns = (r"""(?i)Shopify\.currency\s*=\s*\{[^}]*["']active["']\s*:\s*["']([A-Z]{3})["']""",
                r"""(?i)["']currency(?:Code)?["']\s*:\s*["']([A-Z]{3})["']""",
                r"""(?i)property=["']product:price:currency["'][^>]*content=["']([A-Z]{3})["']""")
    return F.upper(F.coalesce(*[T.blank_to_null(F.regexp_extract(html, p, 1)) for p in patterns]))


def shop_price(parsed: Column, text: Column, path: str, currency: Column) -> Column:
    """Minor units of a shop price: a JSON number already counts minor units, a JSON text is a decimal amount."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    value = F.get_json_object(text, path)
    digits = N.currency_digits(F.coalesce(currency, F.lit("EUR")))
    return F.when(kind == "STRING", N.minor_units_truncated(value, digits)).when(kind.startswith("BIGINT"), N.as_count(value))


def normalize_shopify(payloads: DataFrame) -> DataFrame:
    """Shop products, single or listed; `currency` comes from the page. A compare-at price must be higher."""
    body = F.col("body")
    rows = exploded(payloads, F.when(J(body, "$.products").isNotNull(), json_items(J(body, "$.products"))).otherwise(F.array(body)))
    rows = rows.withColumn("v", F.try_parse_json("item")).withColumn("title", T.as_value(F.trim(J("item", "$.title")))).filter(F.col("title").isNotNull())
    item, cur = F.col("item"), F.col("currency")
    digits = N.currency_digits(F.coalesce(cur, F.lit("EUR")))

    def variant(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        return F.struct(
            J(text, "$.id").alias("id"), T.as_value(F.trim(J(text, "$.title"))).alias("title"), T.as_value(F.trim(J(text, "$.sku"))).alias("sku"),
            shop_price(parsed, text, "$.price", cur).alias("price"), shop_price(parsed, text, "$.compare_at_price", cur).alias("compare"),
            (J(text, "$.available") == "true").alias("available"))

    raw = F.filter(F.transform(json_items(J(item, "$.variants")), variant), lambda v: v["title"].isNotNull())
    rows = rows.withColumn("raw_variants", F.slice(raw, 1, 50)).withColumn("direct", shop_price(F.col("v"), item, "$.price", cur)).withColumn(
        "direct_compare", F.coalesce(shop_price(F.col("v"), item, "$.compare_at_price", cur), shop_price(F.col("v"), item, "$.compare_at_price_min", cur)))
    usable = F.transform("raw_variants", lambda v: F.struct(
        v["id"].alias("id"), v["title"].alias("title"), v["sku"].alias("sku"), F.lit(None).cast("string").alias("gtin"), v["price"].alias("price"),
        F.when(v["price"].isNotNull(), cur).alias("currency"), F.when(v["price"].isNotNull(), N.price_display(v["price"], digits, cur)).alias("priceDisplay"),
        F.when(v["price"].isNull() | (v["compare"] > v["price"]), v["compare"]).alias("compareAtPrice"),
        F.when(v["price"].isNull() | (v["compare"] > v["price"]), N.price_display(v["compare"], digits, cur)).alias("compareAtPriceDisplay"),
        v["available"].alias("available")))
    rows = rows.withColumn("variants", usable)

    def first(field: str) -> Column:
        open_ = F.filter("variants", lambda v: F.coalesce(v["available"], F.lit(True)) & v[field].isNotNull())
        any_ = F.filter("variants", lambda v: v[field].isNotNull())
        return F.coalesce(F.get(open_, F.lit(0))[field], F.get(any_, F.lit(0))[field])

    rows = rows.withColumn("price", F.coalesce("direct", first("price"))).withColumn("candidate", F.coalesce("direct_compare", first("compareAtPrice")))
    rows = rows.withColumn("compare", F.when(F.col("price").isNull() | (F.col("candidate") > F.col("price")), F.col("candidate")))
    address = lambda v: F.when(v.startswith("//"), F.concat(F.lit("https:"), v)).otherwise(v)
    pictures = F.transform(F.concat(json_items(J(item, "$.featured_image")), json_items(J(item, "$.images"))), lambda i: F.when(
        i.startswith("{"), address(F.coalesce(J(i, "$.src"), J(i, "$.url")))).otherwise(address(i)))
    rows = rows.withColumn("pictures", T.keep_first_distinct(pictures, 8))
    page = F.col("url")
    target = F.coalesce(U.absolute_url(J(item, "$.url"), page), F.concat(U.origin(page), F.lit("/products/"), F.url_encode(J(item, "$.handle"))), page)
    tags = json_items(J(item, "$.tags"))
    split_tags = F.when(J(item, "$.tags").startswith("["), tags).otherwise(F.split(J(item, "$.tags"), ","))
    rows = rows.withColumn("target", target).withColumn(
        "described", fragment_markdown(F.coalesce(J(item, "$.body_html"), J(item, "$.description"), F.lit("")), page))
    e = T.escape_markdown
    vendor = T.as_value(J(item, "$.vendor"))
    content = T.join_present(
        "\n\n", F.concat(F.lit("# "), e(F.col("title"))), F.concat(F.lit("Vendor: "), e(vendor)), F.concat(F.lit("Type: "), e(T.as_value(J(item, "$.product_type")))),
        F.col("described"), F.array_join(F.transform("pictures", lambda p: F.concat(F.lit("!["), e(F.col("title")), F.lit("]("), p, F.lit(")"))), "\n\n"),
        F.concat(F.lit("[View product]("), F.col("target"), F.lit(")")))
    money = lambda c: N.price_display(F.col(c), digits, cur)
    return entity_rows(
        rows, ["payload_id", "position"], type="product", source="shopify", method="shopify-json", id=F.coalesce(J(item, "$.id"), J(item, "$.handle")),
        url=F.col("target"), title=F.col("title"), author=vendor, published_at=parse_date(J(item, "$.published_at")), content=content,
        media=images(F.transform("pictures", lambda p: F.struct(p.alias("url"), F.col("title").alias("alt"), F.lit(None).alias("width"), F.lit(None).alias("height")))),
        attributes={
            "productType": F.lit("physical"), "brand": vendor, "category": T.as_value(J(item, "$.product_type")), "sku": T.as_value(F.trim(J(item, "$.sku"))),
            "tags": F.when(split_tags.isNotNull(), T.keep_first_distinct(F.transform(split_tags, F.trim), 50)), "price": F.col("price"),
            "currency": F.when(F.col("price").isNotNull(), cur), "priceDisplay": F.when(F.col("price").isNotNull(), money("price")),
            "compareAtPrice": F.col("compare"), "compareAtPriceDisplay": F.when(F.col("compare").isNotNull(), money("compare")),
            "variants": F.when(F.size("variants") > 0, F.col("variants")),
        })


def normalize_woocommerce(payloads: DataFrame) -> DataFrame:
    """Shop products whose prices are minor units with their own number of digits; at most 50 per payload."""
    rows = exploded(payloads, json_items(F.col("body")), 50).withColumn("title", json_text(F.col("item"), "$.name")).filter(F.col("title").isNotNull())
    item, page = F.col("item"), F.col("url")
    digits = F.least(F.lit(6), F.coalesce(N.as_count(J(item, "$.prices.currency_minor_unit")), F.lit(2)))
    code = F.upper(json_text(item, "$.prices.currency_code"))
    rows = rows.withColumn("price", N.as_count(J(item, "$.prices.price"))).withColumn("regular", N.as_count(J(item, "$.prices.regular_price"))).withColumn(
        "digits", digits).withColumn("currency", let(code, lambda c: F.when(c.rlike("^[A-Z]{3}$"), c))).withColumn(
        "suffix", json_text(item, "$.prices.currency_suffix")).withColumn("prefix", F.coalesce(
            json_text(item, "$.prices.currency_prefix"), F.when(F.col("suffix").isNull(), json_text(item, "$.prices.currency_symbol"))))

    def display(units: Column) -> Column:
        amount = F.format_string("%s", (units.cast("decimal(20,0)") / F.element_at(F.array(*[F.lit(10**i) for i in range(7)]), (F.col("digits") + 1).cast("int"))).cast("decimal(24,6)"))
        cut = F.when(F.col("digits") == 0, F.regexp_replace(amount, r"\..*$", "")).otherwise(F.substring(amount, F.lit(1), F.char_length(amount) - 6 + F.col("digits").cast("int")))
        marked = F.col("prefix").isNotNull() | F.col("suffix").isNotNull()
        return F.when(marked, F.trim(F.concat(F.coalesce("prefix", F.lit("")), cut, F.coalesce("suffix", F.lit(""))))).otherwise(F.concat_ws(" ", cut, "currency"))

    names = lambda path: F.filter(F.transform(json_items(J(item, path)), lambda o: json_text(o, "$.name")), lambda n: n.isNotNull())
    link = F.coalesce(U.public_url(U.absolute_url(J(item, "$.permalink"), page)),
                      F.concat(U.origin(page), F.lit("/product/"), F.url_encode(J(item, "$.slug")), F.lit("/")), page)
    rows = rows.withColumn("target", link).withColumn("shown", F.when(F.col("price").isNotNull(), display(F.col("price")))).withColumn(
        "compare", F.when(F.col("regular") > F.col("price"), F.col("regular")))
    pictures = F.filter(F.transform(json_items(J(item, "$.images")), lambda i: F.struct(
        U.absolute_url(J(i, "$.src"), page).alias("url"), F.coalesce(json_text(i, "$.alt"), F.col("title")).alias("alt"),
        N.as_positive(J(i, "$.width")).alias("width"), N.as_positive(J(i, "$.height")).alias("height"))), lambda p: U.is_http(p["url"]))
    terms = lambda o: F.array_join(F.filter(F.transform(json_items(J(o, "$.terms")), lambda t: F.coalesce(json_text(t, "$.name"), F.when(~t.startswith("{"), T.as_value(T.strip_tags(t))))), lambda t: t.isNotNull()), ", ")
    feature = F.transform(json_items(J(item, "$.attributes")), lambda o: F.when(json_text(o, "$.name").isNotNull() & (terms(o) != ""), F.concat_ws(": ", json_text(o, "$.name"), terms(o))))
    rows = rows.withColumn("features", F.slice(F.filter(feature, lambda f: f.isNotNull()), 1, 30)).withColumn("pictures", F.slice(pictures, 1, 8))
    stock = F.when(J(item, "$.is_in_stock") == "true", "InStock").when(J(item, "$.is_in_stock") == "false", "OutOfStock")
    rating, reviews, brand = N.as_number(J(item, "$.average_rating")), N.as_count(J(item, "$.review_count")), F.get(names("$.brands"), F.lit(0))
    described = fragment_markdown(F.coalesce(J(item, "$.description"), J(item, "$.short_description"), F.lit("")), F.col("target"))
    e = T.escape_markdown
    content = T.join_present(
        "\n\n", F.concat(F.lit("# "), e(F.col("title"))), F.concat(F.lit("Brand: "), e(brand)),
        F.concat(F.lit("Category: "), e(T.blank_to_null(F.array_join(names("$.categories"), ", ")))), F.concat(F.lit("Price: "), e(F.col("shown"))),
        F.concat(F.lit("Availability: "), stock), F.col("described"), F.concat(F.lit("[View product]("), F.col("target"), F.lit(")")))
    return entity_rows(
        rows.withColumn("described", described), ["payload_id", "position"], type="product", source="woocommerce", method="woocommerce-json",
        id=F.coalesce(J(item, "$.id"), J(item, "$.slug")), url=F.col("target"), title=F.col("title"), author=brand, content=content, media=images(F.col("pictures")),
        attributes={
            "productType": F.lit("physical"), "brand": brand, "category": F.get(names("$.categories"), F.lit(0)), "sku": json_text(item, "$.sku"),
            "tags": F.when(F.size(names("$.tags")) > 0, F.slice(names("$.tags"), 1, 50)), "price": F.col("price"),
            "currency": F.when(F.col("price").isNotNull(), F.col("currency")), "priceDisplay": F.col("shown"), "compareAtPrice": F.col("compare"),
            "compareAtPriceDisplay": F.when(F.col("compare").isNotNull(), display(F.col("compare"))), "availability": stock, "rating": F.when(rating >= 0, rating),
            "ratingScale": F.when(rating >= 0, F.lit(5.0)), "reviewCount": reviews, "features": F.when(F.size("features") > 0, F.col("features")),
        })


def normalize_app_lookup(payloads: DataFrame) -> DataFrame:
    """App store lookup results."""
    rows = exploded(payloads, json_items(J(F.col("body"), "$.results"))).withColumn("title", T.as_value(F.trim(J("item", "$.trackName")))).filter(F.col("title").isNotNull())
    item = F.col("item")
    author, currency = T.as_value(F.trim(J(item, "$.artistName"))), F.upper(J(item, "$.currency"))
    icon = F.coalesce(U.public_url(J(item, "$.artworkUrl512")), U.public_url(J(item, "$.artworkUrl100")))
    shots = F.transform(F.concat(json_items(J(item, "$.screenshotUrls")), json_items(J(item, "$.ipadScreenshotUrls"))), U.public_url)
    rows = rows.withColumn("icon", icon).withColumn("shots", T.keep_first_distinct(shots, 20))
    shown = F.transform("shots", lambda s, i: F.struct(s.alias("url"), F.concat(F.col("title"), F.lit(" screenshot "), (i + 1).cast("string")).alias("alt"),
                                                       F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")))
    logo = F.array(F.struct(F.col("icon").alias("url"), F.concat(F.col("title"), F.lit(" app icon")).alias("alt"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")))
    e = T.escape_markdown
    price = N.minor_units(J(item, "$.price"), F.coalesce(currency, F.lit("USD")))
    system = F.coalesce(T.as_value(J(item, "$.operatingSystem")), F.concat(F.lit("iOS "), J(item, "$.minimumOsVersion"), F.lit(" or later")))
    content = T.join_present(
        "\n\n", F.concat(F.lit("# "), e(F.col("title"))), F.concat(F.lit("Developer: "), e(author)), F.concat(F.lit("Price: "), e(J(item, "$.formattedPrice"))),
        F.concat(F.lit("Category: "), e(J(item, "$.primaryGenreName"))), F.concat(F.lit("Version: "), e(J(item, "$.version"))), F.trim(J(item, "$.description")),
        F.concat(F.lit("## What's new\n\n"), F.trim(J(item, "$.releaseNotes"))))
    return entity_rows(
        rows, ["payload_id", "position"], type="product", source="app-store", method="app-store-lookup", id=J(item, "$.trackId"),
        url=F.regexp_replace(F.coalesce(U.public_url(J(item, "$.trackViewUrl")), F.col("url")), r"[?#].*$", ""), title=F.col("title"), author=author,
        published_at=parse_date(J(item, "$.releaseDate")), content=content, media=images(F.concat(F.filter(logo, lambda l: l["url"].isNotNull()), shown)),
        attributes={
            "productType": F.lit("software"), "brand": author, "category": J(item, "$.primaryGenreName"), "price": price, "currency": F.when(price.isNotNull(), currency),
            "priceDisplay": J(item, "$.formattedPrice"), "availability": F.lit("available"), "rating": N.as_number(J(item, "$.averageUserRating")),
            "ratingScale": F.when(N.as_number(J(item, "$.averageUserRating")).isNotNull(), F.lit(5.0)), "reviewCount": N.as_count(J(item, "$.userRatingCount")),
            "softwareVersion": J(item, "$.version"), "operatingSystem": system, "contentRating": J(item, "$.contentAdvisoryRating"),
            "developerUrl": F.coalesce(U.public_url(J(item, "$.sellerUrl")), U.public_url(J(item, "$.artistViewUrl"))),
        })


def find_objects(df: DataFrame, kinds: tuple[str, ...], html: str = "body") -> DataFrame:
    """(payload_id, position, item) of the JSON-LD objects of given types anywhere in a page."""
    rows = df.select("payload_id", "url", json_objects(ld_blocks(F.col(html))).alias("objects"))
    wanted = F.filter("objects", lambda o: F.exists(json_items(J(o, "$['@type']")), lambda t: t.isin(*kinds)))
    return exploded(rows, wanted)


def normalize_software_pages(payloads: DataFrame, source: str = "google-play") -> DataFrame:
    """The first software application that a page describes."""
    rows = find_objects(payloads, ("SoftwareApplication", "MobileApplication")).filter(F.col("position") == 0)
    item = F.col("item")
    offer = F.get(F.filter(json_items(J(item, "$.offers")), lambda o: o.startswith("{")), F.lit(0))
    rows = rows.withColumn("offer", offer).withColumn("title", json_text(item, "$.name")).filter(F.col("title").isNotNull())
    currency = F.upper(J("offer", "$.priceCurrency"))
    major = N.as_number(J("offer", "$.price"))
    price = F.when(currency.isNotNull(), N.minor_units(J("offer", "$.price"), currency))
    icon = F.get(json_items(J(item, "$.image")), F.lit(0))
    icon_url = U.public_url(F.when(icon.startswith("{"), F.coalesce(J(icon, "$.contentUrl"), J(icon, "$.url"))).otherwise(icon))
    author = named(J(item, "$.author"))
    rating = N.as_number(J(item, "$.aggregateRating.ratingValue"))
    return entity_rows(
        rows, ["payload_id"], type="product", source=source, method=f"{source}-html", id=F.coalesce(U.play_package(F.col("url")), U.app_store_id(F.col("url"))),
        url=U.canonical_entity_url(F.col("url")), title=F.col("title"), author=author, content=T.join_present(
            "\n\n", F.concat(F.lit("# "), T.escape_markdown(F.col("title"))), F.concat(F.lit("Developer: "), T.escape_markdown(author)), json_text(item, "$.description")),
        media=image(icon_url, F.concat(F.col("title"), F.lit(" app icon"))), attributes={
            "productType": F.lit("software"), "brand": author, "category": json_text(item, "$.applicationCategory"), "price": price, "currency": F.when(price.isNotNull(), currency),
            "priceDisplay": F.when(major == 0, F.lit("Free")).when(price.isNotNull(), N.price_display(price, N.currency_digits(currency), currency)),
            "availability": F.element_at(F.split(J("offer", "$.availability"), "/"), -1), "rating": F.when(rating >= 0, rating),
            "ratingScale": F.when(rating >= 0, F.lit(5.0)), "reviewCount": N.as_count(F.coalesce(J(item, "$.aggregateRating.ratingCount"), J(item, "$.aggregateRating.reviewCount"))),
            "operatingSystem": json_text(item, "$.operatingSystem"), "contentRating": json_text(item, "$.contentRating"),
        })


def file_type(explicit: Column, url: Column) -> Column:
    given = T.as_value(F.substring(F.lower(T.strip_tags(explicit)), 1, 100))
    return F.coalesce(given, T.blank_to_null(F.lower(F.regexp_extract(U.path(url), r"(?i)\.([a-z0-9]{2,8})$", 1))))


def _picture_rows(rows: DataFrame, method: str) -> DataFrame:
    """Common shape of both picture catalogs."""
    e = T.escape_markdown
    c = F.col
    licence = F.when(c("license_url").isNotNull(), F.concat(F.lit("License: ["), e(c("license")), F.lit("]("), c("license_url"), F.lit(")"))).otherwise(
        F.concat(F.lit("License: "), e(c("license"))))
    content = T.join_present(
        "\n\n", F.concat(F.lit("## "), e(c("title"))), F.concat(F.lit("Creator: "), e(c("creator"))), licence, e(c("description")),
        F.concat(F.lit("!["), e(c("title")), F.lit("]("), c("image_url"), F.lit(")")), F.concat(F.lit("[View image source]("), c("page"), F.lit(")")))
    return entity_rows(
        rows, ["payload_id", "position"], type="document", source="image-search", method=method, id=c("id"), url=c("page"), title=c("title"), author=c("creator"),
        content=content, media=image(c("image_url"), c("title"), c("width"), c("height")), attributes={
            "description": c("description"), "license": c("license"), "licenseUrl": c("license_url"), "creatorUrl": c("creator_url"), "fileType": c("file_type"),
            "tags": c("tags"), "orientation": N.orientation(c("width"), c("height"))})


def normalize_openverse(payloads: DataFrame) -> DataFrame:
    """Pictures of the first catalog."""
    rows = exploded(payloads, json_items(J(F.col("body"), "$.results"))).withColumn("image_url", U.public_url(J("item", "$.url"))).filter(F.col("image_url").isNotNull())
    item = F.col("item")
    tag = F.transform(json_items(J(item, "$.tags")), lambda t: F.coalesce(json_text(t, "$.name"), F.when(~t.startswith("{"), T.as_value(T.strip_tags(t)))))
    return _picture_rows(rows.select(
        "payload_id", "position", "image_url", J(item, "$.id").alias("id"), F.coalesce(U.public_url(J(item, "$.foreign_landing_url")), F.col("image_url")).alias("page"),
        F.coalesce(json_text(item, "$.title"), F.lit("Untitled image")).alias("title"), json_text(item, "$.creator").alias("creator"),
        U.public_url(J(item, "$.creator_url")).alias("creator_url"), json_text(item, "$.description").alias("description"),
        T.as_value(F.concat_ws(" ", F.upper(json_text(item, "$.license")), json_text(item, "$.license_version"))).alias("license"),
        U.public_url(J(item, "$.license_url")).alias("license_url"), N.as_positive(J(item, "$.width")).alias("width"), N.as_positive(J(item, "$.height")).alias("height"),
        file_type(J(item, "$.filetype"), F.col("image_url")).alias("file_type"), let(T.keep_first_distinct(tag, 50), lambda t: F.when(F.size(t) > 0, t)).alias("tags")),
        "image-search-openverse")


def normalize_wikimedia(payloads: DataFrame) -> DataFrame:
    """Pictures of the second catalog."""
    rows = exploded(payloads, json_items(J(F.col("body"), "$.query.pages")))
    rows = rows.withColumn("info", J("item", "$.imageinfo[0]")).withColumn(
        "image_url", F.coalesce(U.public_url(J("info", "$.thumburl")), U.public_url(J("info", "$.url")))).withColumn("page", U.public_url(J("info", "$.descriptionurl")))
    rows = rows.filter(F.col("image_url").isNotNull() & F.col("page").isNotNull())
    info, item = F.col("info"), F.col("item")
    meta = lambda name: json_text(info, f"$.extmetadata.{name}.value")
    linked = F.regexp_extract(J(info, "$.extmetadata.Artist.value"), r"""(?i)<a\b[^>]*\shref\s*=\s*["']([^"']+)""", 1)
    number = lambda a, b: N.as_positive(F.coalesce(J(info, a), J(info, b)))
    return _picture_rows(rows.select(
        "payload_id", "position", "image_url", "page", J(item, "$.pageid").alias("id"),
        F.coalesce(T.as_value(F.trim(F.regexp_replace(json_text(item, "$.title"), "(?i)^File:", ""))), F.lit("Untitled image")).alias("title"),
        meta("Artist").alias("creator"), U.public_url(U.absolute_url(T.blank_to_null(linked), F.lit("https://commons.wikimedia.org/"))).alias("creator_url"),
        meta("ImageDescription").alias("description"), meta("LicenseShortName").alias("license"), U.public_url(meta("LicenseUrl")).alias("license_url"),
        number("$.thumbwidth", "$.width").alias("width"), number("$.thumbheight", "$.height").alias("height"), file_type(J(info, "$.mime"), F.col("image_url")).alias("file_type"),
        F.lit(None).cast("array<string>").alias("tags")), "image-search-wikimedia")


def normalize_places(payloads: DataFrame) -> DataFrame:
    """GeoJSON features with valid coordinates and a name."""
    rows = exploded(payloads, json_items(J(F.col("body"), "$.features")))
    item = F.col("item")
    fields = "name,street,housenumber,postcode,city,locality,district,county,state,country,countrycode,osm_type,osm_key,osm_value".split(",")
    props = F.struct(*[T.as_value(T.collapse(J(item, f"$.properties.{f}"))).alias(f) for f in fields])
    numbers = lambda path: F.from_json(J(item, path), "array<double>")
    rows = rows.withColumn("p", props).withColumn("lon", N.as_number(J(item, "$.geometry.coordinates[0]"))).withColumn("lat", N.as_number(J(item, "$.geometry.coordinates[1]")))
    rows = rows.withColumn("title", F.coalesce("p.name", "p.street", "p.city", "p.country")).filter(
        F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & F.col("title").isNotNull())
    rows = rows.withColumn("address", P.address(F.col("p"), F.col("title"))).withColumn(
        "box", N.bounding_box(numbers("$.bbox"), numbers("$.properties.extent"))).withColumn(
        "target", P.map_url(F.col("p.osm_type"), J(item, "$.properties.osm_id").try_cast("long"), F.col("lat"), F.col("lon")))
    extra = lambda *names: F.coalesce(*[T.as_value(T.collapse(J(item, f"$.properties.extra['{n}']"))) for n in names])
    e = T.escape_markdown
    category = T.as_value(F.concat_ws(":", "p.osm_key", "p.osm_value"))
    website = F.coalesce(U.public_url(extra("website")), U.public_url(extra("contact:website")))
    city = F.coalesce("p.city", "p.locality", "p.district")
    content = T.join_present(
        "\n\n", F.concat(F.lit("## "), e(F.col("title"))), e(F.col("address")), F.concat(F.lit("Category: "), e(category)), F.concat(F.lit("Phone: "), e(extra("phone", "contact:phone"))),
        F.concat(F.lit("Opening hours: "), e(extra("opening_hours"))), F.concat(F.lit("[Website]("), website, F.lit(")")),
        F.concat(F.lit("Coordinates: "), F.col("lat").cast("string"), F.lit(", "), F.col("lon").cast("string")), F.concat(F.lit("[View place]("), F.col("target"), F.lit(")")))
    return entity_rows(
        rows, ["payload_id", "position"], type="document", source="place-search", method="place-search-photon",
        id=F.concat(F.coalesce("p.osm_type", F.lit("")), J(item, "$.properties.osm_id")), url=F.col("target"), title=F.col("title"), content=content, attributes={
            "latitude": F.col("lat"), "longitude": F.col("lon"), "address": F.col("address"), "description": F.col("address"), "street": F.col("p.street"),
            "houseNumber": F.col("p.housenumber"), "postalCode": F.col("p.postcode"), "locality": city, "region": F.col("p.state"), "country": F.col("p.country"),
            "boundingBox": F.col("box"), "category": category, "website": website, "phoneNumber": extra("phone", "contact:phone"), "openingHours": extra("opening_hours"),
            "countryCode": F.when(F.col("p.countrycode").rlike("^[A-Za-z]{2}$"), F.upper("p.countrycode")),
        })


def normalize_quotes(payloads: DataFrame, kind: str = "movers", instrument: str = "EQUITY", base_url: str = "https://facts.example.org") -> DataFrame:
    """Quote rows of a mover list or a symbol search: wanted instrument, valid symbol, the first of each."""
    path = "$.finance.result[0].quotes" if kind == "movers" else "$.quotes"
    rows = exploded(payloads, json_items(J(F.col("body"), path)))
    rows = rows.withColumn("symbol", normalize_symbol(J("item", "$.symbol"))).filter(
        (F.upper(F.trim(J("item", "$.quoteType"))) == instrument) & F.col("symbol").isNotNull())
    rows = keep_first(rows, ["payload_id", "symbol"], ["position"])
    t = lambda *names: F.coalesce(*[T.as_value(T.collapse(J("item", f"$.{n}"))) for n in names])
    name = F.coalesce(t("longName", "longname", "shortName", "shortname", "displayName"), F.col("symbol"))
    exchange = t("fullExchangeName", "exchDisp", "exchange") if kind == "movers" else t("exchDisp", "fullExchangeName", "exchange")
    currency = let(t("currency"), lambda c: F.when(c.rlike(r"^[A-Za-z0-9._-]{1,12}$"), c))
    e = T.escape_markdown
    finite = lambda n: N.as_number(J("item", f"$.{n}"))
    extra = {} if kind != "movers" else {
        "previousClose": finite("regularMarketPreviousClose"), "change": finite("regularMarketChange"), "changePercent": finite("regularMarketChangePercent"),
        "dayHigh": finite("regularMarketDayHigh"), "dayLow": finite("regularMarketDayLow"), "fiftyTwoWeekHigh": finite("fiftyTwoWeekHigh"),
        "fiftyTwoWeekLow": finite("fiftyTwoWeekLow"), "volume": N.as_count(J("item", "$.regularMarketVolume")), "marketState": t("marketState"), "timezone": t("exchangeTimezoneName")}
    return entity_rows(
        rows, ["payload_id", "position"], type="document", source="finance", method="finance-movers-json" if kind == "movers" else "finance-search-json",
        id=F.col("symbol"), url=F.concat(F.lit(f"{base_url}/api/finance?symbol="), F.url_encode("symbol"), F.lit("&format=json")), title=name,
        published_at=from_epoch_seconds(J("item", "$.regularMarketTime")), content=T.join_present(
            "\n\n", F.concat(F.lit("## "), e(name), F.lit(" ("), e(F.col("symbol")), F.lit(")")), F.concat(F.lit("Exchange: "), e(exchange))),
        attributes={"tickerSymbol": F.col("symbol"), "instrumentType": F.lit(instrument), "exchange": exchange, "currency": currency, "sector": t("sector"),
                    "industry": t("industry"), "marketPrice": finite("regularMarketPrice"), **extra})


_CHART = (
    "chart struct<result:array<struct<meta:struct<symbol:string,currency:string,regularMarketPrice:double,regularMarketTime:double,chartPreviousClose:double,previousClose:double>,"
    "timestamp:array<double>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>,events:struct<dividends:map<string,struct<date:double,amount:double>>,"
    "splits:map<string,struct<date:double,numerator:double,denominator:double,splitRatio:string>>>>>,error:struct<description:string>>"
)


def chart_points(payloads: DataFrame, limit: int = 512) -> DataFrame:
    """Price points of chart payloads: parallel arrays zipped by index, empty points dropped, the last 512 kept."""
    r = F.col("r")
    quote = F.get(r["indicators"]["quote"], F.lit(0))
    series = {n: quote[n] for n in ("open", "high", "low", "close", "volume")} | {"adj_close": F.get(r["indicators"]["adjclose"], F.lit(0))["adjclose"]}
    rows = payloads.select("payload_id", F.from_json("body", _CHART).alias("data")).select("payload_id", F.get("data.chart.result", F.lit(0)).alias("r"))
    # Inside the arrays points are only told filled from empty; values are rounded once they are rows, in compiled code.
    raw = F.transform(r["timestamp"], lambda t, i: F.struct(t.alias("second"), i.alias("position"), *[F.get(c, i).alias(n) for n, c in series.items()]))
    priced = lambda v: (v >= 0) & (v < float("inf"))
    counted = lambda v: v.between(0, N.MAX_SAFE_INTEGER) & (v == F.floor(v))
    filled = F.filter(raw, lambda p: (F.abs(p["second"]) < LAST_SECOND) & (
        priced(p["close"]) | priced(p["open"]) | priced(p["high"]) | priced(p["low"]) | priced(p["adj_close"]) | counted(p["volume"])))
    kept = let(filled, lambda f: F.slice(f, F.greatest(F.size(f) - limit + 1, F.lit(1)), limit))
    points = rows_of(rows, ["payload_id", r["meta"]["symbol"].alias("symbol"), r["meta"]["currency"].alias("currency")], kept, "p")
    return points.select(
        "payload_id", "symbol", "currency", F.timestamp_micros((F.col("p.second") * 1_000_000).cast("long")).alias("ts"), F.col("p.position").cast("long").alias("position"),
        *[F.when(priced(F.col(f"p.{n}")), N.market_round(F.col(f"p.{n}"))).alias(n) for n in ("open", "high", "low", "close", "adj_close")],
        F.when(counted(F.col("p.volume")), F.col("p.volume").cast("long")).alias("volume"))


def chart_events(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dividends, splits) of chart payloads."""
    rows = payloads.select("payload_id", F.from_json("body", _CHART).alias("data")).select("payload_id", F.get("data.chart.result", F.lit(0)).alias("r"))
    symbol = F.col("r.meta.symbol").alias("symbol")
    dated = lambda df: df.withColumn("ts", from_epoch_seconds(F.col("e.date"))).filter(F.col("ts").isNotNull())
    dividends = dated(rows.select("payload_id", symbol, F.explode(F.map_values("r.events.dividends")).alias("e")))
    splits = dated(rows.select("payload_id", symbol, F.explode(F.map_values("r.events.splits")).alias("e")))
    positive = lambda c: F.when(F.col(c) > 0, N.market_round(F.col(c)))
    return (
        dividends.select("payload_id", "symbol", "ts", N.market_value(F.col("e.amount")).alias("amount")),
        splits.select("payload_id", "symbol", "ts", positive("e.numerator").alias("numerator"), positive("e.denominator").alias("denominator"), T.as_value(F.trim("e.splitRatio")).alias("split_ratio")),
    )


def find_by_key(key: str):
    """Function that lists the JSON objects stored under a key anywhere in a payload, in document order."""
    @udf(T_.ArrayType(T_.StringType()), useArrow=False)
    def find(body: str) -> list | None:
        def walk(value, out):
            if isinstance(value, dict):
                if isinstance(value.get(key), dict):
                    out.append(json.dumps(value[key], ensure_ascii=False))
                value = [v for k, v in value.items() if k != key]
            if isinstance(value, list):
                for child in value:
                    walk(child, out)
            return out

        try:
            return walk(json.loads(body), [])
        except (TypeError, ValueError, RecursionError):
            return None

    return find


def normalize_videos(payloads: DataFrame) -> DataFrame:
    """Videos whose renderer lies anywhere in a payload; the first of each id."""
    rows = payloads.select("payload_id", "url", find_by_key("videoRenderer")(F.col("body")).alias("found"))
    rows = exploded(rows, F.col("found"))
    item = F.col("item")

    def label(path: str) -> Column:
        runs = F.array_join(F.transform(json_items(J(item, f"{path}.runs")), lambda r: F.coalesce(J(r, "$.text"), F.lit(""))), "")
        return F.coalesce(T.as_value(T.collapse(J(item, f"{path}.simpleText"))), T.as_value(T.collapse(runs)))

    rows = rows.withColumn("id", J(item, "$.videoId")).withColumn("title", label("$.title")).filter(F.col("id").rlike(r"^[\w-]{11}$") & F.col("title").isNotNull())
    rows = keep_first(rows, ["payload_id", "id"], ["position"])
    thumbs = F.filter(F.transform(F.reverse(json_items(J(item, "$.thumbnail.thumbnails"))), lambda t: U.public_url(J(t, "$.url"))), lambda u: u.isNotNull())
    shown = label("$.publishedTimeText")
    return entity_rows(
        rows, ["payload_id", "position"], type="video", source="video-search", method="video-search-json", id=F.col("id"),
        url=F.concat(F.lit("https://www.youtube.com/watch?v="), "id"), title=F.col("title"), author=F.coalesce(label("$.ownerText"), label("$.shortBylineText")),
        published_at=absolute_display_date(shown), content=F.coalesce(label("$.descriptionSnippet"), label("$.detailedMetadataSnippets[0].snippetText"), F.lit("")),
        media=image(F.get(thumbs, F.lit(0)), F.col("title")), attributes={
            "durationSeconds": N.duration_seconds(label("$.lengthText")), "viewCount": N.exact_view_count(label("$.viewCountText")), "publishedAtDisplay": shown})
