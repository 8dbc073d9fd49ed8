"""Page corpus to entities: gates, metadata, readable content and the outcome cascade.

The cheap gates run on the JVM for every page. Pages that pass them cross to Python once, where one parse
gives all content candidates; node arrays are made only for pages that carry marks of a product or a list.
Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import html as H
from factloom.functions import let
from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import iso, modified_date, page_date
from factloom.functions.dom import dom_nodes, json_objects, read_page, shallow_json_objects
from factloom.operators import listings as L

MAX_SOURCE_BYTES = 5 * 1024 * 1024
MAX_OUTPUT_BYTES = 2 * 1024 * 1024
MIN_CONTENT = 80


def size_gate(body: Column, max_bytes: int = MAX_SOURCE_BYTES) -> Column:
    return F.when(F.octet_length(body) > max_bytes, F.lit("content_too_large"))


def page_metadata(pages: DataFrame, as_of: Column) -> DataFrame:
    """Adds struct `meta` (title, author, published_at, description, language, modified_at) from `url` and `html`."""
    clean = H.without_comments(F.col("html"))
    df = (
        pages.withColumn("_metas", H.meta_tags(clean))
        .withColumn("_times", H.tags(clean, "time"))
        .withColumn("_html_lang", H.page_language(F.col("html")))
        .withColumn("_title", F.substring(H.page_title(clean), 1, 500))
        .withColumn("_objects", json_objects(H.ld_blocks(clean)))
    )
    is_article = lambda o: F.coalesce(F.get_json_object(o, "$['@type']"), F.lit("")).rlike("(?i)(?:article|blogposting|newsarticle)")
    df = df.withColumn("_ordered", F.concat(F.filter("_objects", is_article), F.filter("_objects", lambda o: ~is_article(o))))
    ordered, metas = F.col("_ordered"), F.col("_metas")

    def structured(key: str) -> Column:
        texts = F.transform(ordered, lambda o: F.get_json_object(o, f"$.{key}"))
        texts = F.transform(texts, lambda v: T.clean_text(F.when(~v.rlike(r"^[\[{]"), v)))
        return F.get(F.filter(texts, lambda v: v.isNotNull()), F.lit(0))

    def names(value: Column) -> Column:
        each = F.transform(L.json_items(value), lambda a: T.clean_text(
            F.when(a.startswith("{"), F.get_json_object(a, "$.name")).otherwise(a), 300))
        return T.blank_to_null(F.array_join(F.filter(each, lambda n: n.isNotNull()), ", "))

    creators = F.transform(ordered, lambda o: names(F.coalesce(F.get_json_object(o, "$.author"), F.get_json_object(o, "$.creator"))))
    author = F.coalesce(
        H.meta_content(metas, [("name", "author"), ("property", "article:author")]),
        F.get(F.filter(creators, lambda a: a.isNotNull()), F.lit(0)),
    )
    stamped = lambda prop: H.attribute(F.get(F.filter("_times", lambda t: H.attribute(t, "itemprop") == prop), F.lit(0)), "datetime")
    published = F.coalesce(
        H.meta_content(metas, [("property", "article:published_time"), ("name", "date"), ("name", "datePublished"),
                               ("itemprop", "datePublished")]),
        stamped("datePublished"), structured("datePublished"),
    )
    modified = F.coalesce(
        H.meta_content(metas, [("property", "article:modified_time"), ("name", "dateModified"), ("itemprop", "dateModified")]),
        stamped("dateModified"), structured("dateModified"),
    )
    language = F.regexp_replace(F.coalesce(
        T.clean_text(F.col("_html_lang"), 100),
        H.meta_content(metas, [("equiv", "content-language"), ("property", "og:locale")]), structured("inLanguage"),
    ), "_", "-")
    return df.withColumn("meta", F.struct(
        F.coalesce(H.meta_content(metas, [("property", "og:title"), ("name", "twitter:title")]),
                   structured("headline"), structured("name"), T.clean_text(F.col("_title"), 500)).alias("title"),
        F.when(~author.rlike("^(?i)https?://"), author).alias("author"),
        page_date(published, U.path(F.col("url")), as_of).alias("published_at"),
        F.coalesce(H.meta_content(metas, [("property", "og:description"), ("name", "twitter:description"), ("name", "description")]),
                   structured("description")).alias("description"),
        canonical_language(language).alias("language"),
        modified_date(modified, as_of).alias("modified_at"),
    )).drop("_times", "_html_lang", "_title", "_ordered")


def canonical_language(tag: Column) -> Column:
    """Language tag in canonical letter case; null when malformed."""
    parts = F.split(tag, "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p))
                        .when((F.char_length(p) == 4) & p.rlike("^[A-Za-z]+$"), F.initcap(p))
                        .when(F.char_length(p) == 2, F.upper(p)).otherwise(F.lower(p)))
    return F.when(tag.rlike(r"^[A-Za-z]{2,3}(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|\d{3}))?(?:-[A-Za-z0-9]{4,8})*$"), F.array_join(cased, "-"))


def preview_media(df: DataFrame, images: str = "_page.images") -> DataFrame:
    """Adds `media`, the best preview picture: shared metadata first, then structured data, then the page's images.

    Needs the columns of `page_metadata` and an image array of the parsed page.
    """
    html, page = F.col("html"), F.col("url")
    metas = F.col("_metas")
    content = lambda prop: F.get(F.filter(metas, lambda m: F.coalesce(m["property"] == prop, F.lit(False))), F.lit(0))["content"]
    og = (content("og:image:alt"), content("og:image:width"), content("og:image:height"))
    none = F.lit(None).cast("string")

    def candidate(url, score, alt=none, width=none, height=none):
        return F.struct(url.alias("href"), score.cast("int").alias("score"), alt.alias("alt"), width.alias("width"), height.alias("height"))

    def advertised(attribute: str, name: str, score: int) -> Column:
        found = F.filter(metas, lambda m: F.coalesce(m[attribute] == name, F.lit(False)))
        return F.transform(found, lambda m: candidate(m["content"], F.lit(score), *og))

    groups = [
        advertised("property", "og:image:secure_url", 500), advertised("property", "og:image", 490),
        advertised("name", "twitter:image:src", 480), advertised("name", "twitter:image", 470),
    ]
    links = F.filter(H.tags(html, "link"), lambda t: F.coalesce(H.attribute(t, "rel") == "image_src", F.lit(False)))
    groups.append(F.transform(links, lambda t: candidate(H.attribute(t, "href"), F.lit(460), *og)))
    structured = F.flatten(F.transform("_objects", lambda o: F.concat(
        L.json_items(F.get_json_object(o, "$.image")), L.json_items(F.get_json_object(o, "$.thumbnailUrl")))))
    groups.append(F.transform(F.slice(structured, 1, 20), lambda v: F.when(
        v.startswith("{"),
        candidate(F.coalesce(F.get_json_object(v, "$.contentUrl"), F.get_json_object(v, "$.url")), F.lit(440), none,
                  F.get_json_object(v, "$.width"), F.get_json_object(v, "$.height")),
    ).otherwise(candidate(v, F.lit(440)))))
    df = df.withColumn("_title_key", T.comparison_key(F.coalesce(F.col("meta.title"), F.lit(""))))
    title = F.col("_title_key")

    def image_score(image: Column, i: Column) -> Column:
        named = let(T.comparison_key(F.coalesce(image["alt"], F.lit(""))), lambda alt: (
            F.when((title == "") | (alt == ""), 0).when(alt == title, 350)
            .when(title.contains(alt) | alt.contains(title), 180).otherwise(0)
        ))
        large = (F.coalesce(image["width"].try_cast("int"), F.lit(0)) >= 300) & (F.coalesce(image["height"].try_cast("int"), F.lit(0)) >= 180)
        return F.greatest(F.lit(0), 100 - i) + F.when(image["in_main"], 180).otherwise(0) + named + F.when(large, 140).otherwise(0)

    groups.append(F.transform(F.col(images), lambda im, i: candidate(im["src"], image_score(im, i), im["alt"], im["width"], im["height"])))

    def number(value: Column) -> Column:
        return N.as_positive(F.regexp_extract(value, r"^\s*(\d+)", 1))

    def finished(c: Column, i: Column) -> Column:
        return let(U.validate_url(U.absolute_url(c["href"], page))["url"], lambda url: F.struct(
            c["score"].alias("score"), (-i).alias("order"), F.lit("image").alias("type"), url.alias("url"),
            T.as_value(F.trim(c["alt"])).alias("alt"),
            F.coalesce(number(c["width"]), number(U.parameter(url, "width")), number(U.parameter(url, "w"))).alias("width"),
            F.coalesce(number(c["height"]), number(U.parameter(url, "height")), number(U.parameter(url, "h"))).alias("height"),
        ))

    def is_artwork(c: Column) -> Column:
        p = F.lower(U.path(c["url"]))
        icon = p.rlike(r"\.(?:ico|svg)$") | p.rlike(r"(?:^|[/_.-])(?:favicon|logo|icon)(?:[/_.-]|$)")
        tiny = F.coalesce((c["width"] <= 128) & (c["height"] <= 128), F.lit(False))
        return c["url"].isNotNull() & ~icon & ~tiny

    df = df.withColumn("_candidates", F.transform(F.concat(*groups), finished))
    df = df.withColumn("_best", F.array_max(F.filter("_candidates", is_artwork)))
    best = F.col("_best")
    return df.withColumn("media", F.when(best.isNotNull(), F.array(F.struct(
        best["type"].alias("type"), best["url"].alias("url"), best["alt"].alias("alt"), best["width"].alias("width"), best["height"].alias("height")
    ))).otherwise(F.array().cast("array<struct<type:string,url:string,alt:string,width:bigint,height:bigint>>"))).drop("_candidates", "_best", "_title_key")


def choose_content(page: Column, meta: Column) -> Column:
    """struct(content, metadata_only): the focused section, readable block, whole body or description that is long enough."""
    long = lambda c: F.when(F.char_length(c) >= MIN_CONTENT, c)
    bound = F.struct(
        F.coalesce(long(page["focused"]), long(page["readable"]), long(page["fallback"])).alias("body"),
        long(meta["description"]).alias("described"), meta["title"].alias("title"))

    def titled(v: Column) -> Column:
        text = F.coalesce(v["body"], v["described"])
        head = F.when(v["title"].isNotNull() & ~text.startswith("# "), F.concat(F.lit("# "), v["title"], F.lit("\n\n"))).otherwise(F.lit(""))
        return F.struct(F.concat(head, text).alias("content"), (v["body"].isNull() & v["described"].isNotNull()).alias("metadata_only"))

    return let(bound, titled)


def extract_content(pages: DataFrame, as_of: Column, focus: Column | None = None) -> DataFrame:
    """Readable Markdown of every page with its metadata; short pages get `extraction_failed`."""
    wanted = (focus if focus is not None else F.lit(None)).cast("string")
    df = page_metadata(pages, as_of).withColumn("_page", read_page("html", "url", wanted))
    df = preview_media(df).withColumn("_content", choose_content(F.col("_page"), F.col("meta")))
    return df.select(
        *pages.drop("html").columns, "meta.*", "media", "_content.content", "_content.metadata_only",
        T.word_count(F.col("_content.content")).alias("word_count"),
        F.when(F.col("_content.content").isNull(), F.lit("extraction_failed")).alias("error_code"),
    )


ITEM_FIELDS = ("id", "url", "title", "author", "published_at", "content", "price", "currency")


def extract_pages(
    pages: DataFrame, as_of: Column, focus: Column | None = None,
    storefront: DataFrame | None = None, alternates: DataFrame | None = None,
) -> DataFrame:
    """One outcome per page: type, method, title, content, items, or an error code; the first success wins.

    `pages` has page_id, url, html and optionally content_type, link_header. `storefront` holds products
    already normalized from shop payloads and `alternates` results of advertised feeds and embeds, both
    keyed by page_id with (type, method, title, content); they stand in where the cascade asks for them.
    """
    wanted = (focus if focus is not None else F.lit(None)).cast("string")
    df = pages
    for name in ("content_type", "link_header"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    kept = list(pages.drop("html").columns)
    target = U.validate_url(F.col("url"))
    df = df.withColumn("_target", target).withColumn("_route", H.route_content(F.col("content_type"), F.col("html")))
    gate = F.coalesce(
        F.col("_target.error_code"),
        size_gate(F.col("html")),
        F.when(~F.col("_route").isin("text", "html"), F.col("_route")),
        F.when((F.col("_route") == "html") & H.is_interstitial(F.col("html")), F.lit("source_blocked")),
    )
    df = df.withColumn("_gate", gate).withColumn("url", F.coalesce("_target.url", "url"))
    # Rejected and plain-text rows keep their text but send no markup to Python.
    df = df.withColumn("_plain", F.when(F.col("_gate").isNull() & (F.col("_route") == "text"), F.trim("html")))
    df = df.withColumn("html", F.when(F.col("_gate").isNull() & (F.col("_route") == "html"), F.col("html")))
    df = df.withColumn("_render", H.needs_render(F.col("html")))
    df = page_metadata(df, as_of)
    df = df.withColumn("_product", L.product_object(shallow_json_objects(H.ld_blocks(H.without_comments(F.col("html"))))))
    listed = F.col("_product").isNotNull() | L.may_list_products(F.col("html")) | U.is_blog_listing(F.col("url"))
    df = df.withColumn("_nodes", dom_nodes(F.when(listed, F.col("html"))))
    df = df.withColumn("_page", read_page("html", "url", wanted))
    df = df.withColumn("_clean_page", read_page(
        F.when(F.col("_render") & F.col("html").rlike(H.TEMPLATE_EXPRESSION), H.strip_templates(F.col("html"))), F.col("url"), wanted))
    df = preview_media(df)
    df = df.withColumn("_detail", L.product_detail(F.col("_product"), F.col("url")))
    df = df.withColumn("_cards", L.product_cards(F.col("_nodes"), F.col("url")))
    df = df.withColumn("_posts", F.when(U.is_blog_listing(F.col("url")), L.blog_items(F.col("_nodes"), F.col("url"))))
    df = df.withColumn("_first", choose_content(F.col("_page"), F.col("meta")))
    df = df.withColumn("_second", choose_content(F.col("_clean_page"), F.col("meta")))
    templated = F.col("_render") & H.template_dominated(F.col("_first.content"))
    rescued = ~F.col("_second.metadata_only") & (T.word_count(F.col("_second.content")) > T.word_count(F.col("_first.content")))
    df = df.withColumn("_article", F.when(templated, F.when(rescued, F.col("_second"))).otherwise(F.col("_first")))
    shell = F.col("_render") & H.nav_shell(
        F.col("_page.links"), F.col("_page.primary_text").isNotNull(),
        T.word_count(F.coalesce("_page.primary_text", F.lit(""))), F.col("_article.content"))
    df = df.withColumn("_article", F.when(F.col("_article.content").isNotNull() & ~F.coalesce(shell, F.lit(False)), F.col("_article")))

    def outcome(kind, method, title, author, published, content, items=None, price=None, currency=None):
        empty = F.lit(None)
        return F.struct(
            F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"),
            F.lit(method).alias("method") if isinstance(method, str) else method.alias("method"),
            title.alias("title"), author.cast("string").alias("author"), published.cast("timestamp").alias("published_at"),
            content.alias("content"),
            (items if items is not None else empty).cast("array<struct<id:string,url:string,title:string,author:string,published_at:timestamp,content:string,price:bigint,currency:string>>").alias("items"),
            (price if price is not None else empty).cast("bigint").alias("price"),
            (currency if currency is not None else empty).cast("string").alias("currency"),
        )

    none = F.lit(None)
    null_time = none.cast("timestamp")
    card_items = F.transform("_cards", lambda c: F.struct(
        c["id"].alias("id"), c["url"].alias("url"), c["title"].alias("title"), c["brand"].alias("author"), null_time.alias("published_at"),
        L.product_card_markdown(c).alias("content"), c["price"].alias("price"), c["currency"].alias("currency")))
    post_items = F.transform("_posts", lambda p: F.struct(
        p["id"].alias("id"), p["url"].alias("url"), p["title"].alias("title"), p["author"].alias("author"), p["published_at"].alias("published_at"),
        L.blog_item_markdown(p).alias("content"), none.cast("bigint").alias("price"), none.cast("string").alias("currency")))
    listing = lambda title, items: F.array_join(F.concat(
        F.array(F.concat(F.lit("# "), T.escape_markdown(title))), F.transform(items, lambda i: i["content"])), "\n\n---\n\n")
    detail = F.col("_detail")
    details = F.regexp_replace(F.coalesce(F.col("_article.content"), F.lit("")), r"^#\s+.*?\r?\n\r?\n", "")
    df = df.withColumn("_features", L.spec_features(F.col("_nodes")))
    features = F.col("_features")
    line = lambda label, v: F.concat(F.lit(label), T.escape_markdown(v))
    detail_text = T.join_present(
        "\n\n", line("# ", detail["title"]), line("Brand: ", detail["brand"]), line("Price: ", detail["price_display"]),
        line("Availability: ", detail["availability"]), line("Seller: ", detail["seller"]), detail["description"],
        F.when(F.trim(details) != "", F.concat(F.lit("## Details\n\n"), F.trim(details))),
        F.when(F.size(features) > 0, F.concat(F.lit("## Specifications\n\n"), F.array_join(
            F.transform(features, lambda f: F.concat(F.lit("- "), T.escape_markdown(f))), "\n"))),
        F.when(F.size(detail["variants"]) > 0, F.concat(F.lit("## Variants\n\n"), F.array_join(L.variant_lines(detail["variants"]), "\n"))),
        F.concat(F.lit("[View product]("), F.col("url"), F.lit(")")),
    )
    df = df.withColumn("_cards_title", L.listing_title(F.col("_nodes"), "Products")).withColumn(
        "_posts_title", L.listing_title(F.col("_nodes"), "Blog posts"))
    cards_title, posts_title = F.col("_cards_title"), F.col("_posts_title")
    first_date = F.get(F.filter(F.transform("_posts", lambda p: p["published_at"]), lambda d: d.isNotNull()), F.lit(0))
    steps = [
        F.when(F.col("_plain").isNotNull(), outcome("document", "native-markdown", T.title_from_markdown(F.col("_plain")), none, none, F.col("_plain"))),
        F.when(detail.isNotNull(), outcome("product", "product-jsonld", detail["title"], detail["brand"], none, detail_text,
                                           price=detail["price"], currency=detail["currency"])),
        F.when(L.listed(F.col("_cards")).isNotNull(), outcome("feed", "product-list-html", cards_title, none, none, listing(cards_title, card_items), card_items)),
        F.when(L.listed(F.col("_posts")).isNotNull(), outcome("feed", "blog-list-html", posts_title, none, first_date, listing(posts_title, post_items), post_items)),
        F.when(F.col("_article").isNotNull() & ~F.col("_article.metadata_only"), outcome(
            "article", "linkedom", F.col("meta.title"), F.col("meta.author"), F.col("meta.published_at"), F.col("_article.content"))),
    ]
    described = F.when(F.col("_article").isNotNull(), outcome(
        "document", "metadata", F.col("meta.title"), F.col("meta.author"), F.col("meta.published_at"), F.col("_article.content")))

    def given(extra: DataFrame, name: str) -> DataFrame:
        packed = extra.select("page_id", outcome(F.col("type"), F.col("method"), F.col("title"), none, none, F.col("content")).alias(name))
        return df.join(packed, "page_id", "left")

    if storefront is not None:
        df = given(storefront, "_shop")
        steps.insert(1, F.when(F.col("_gate").isNull(), F.col("_shop")))
    if alternates is not None:
        df = given(alternates, "_alternate")
        steps.append(F.when(F.col("_gate").isNull(), F.col("_alternate")))
    steps.append(described)
    done = df.withColumn("_out", F.coalesce(*steps))
    failed = F.coalesce(F.col("_gate"), F.when(F.col("_out").isNull(), F.lit("extraction_failed")))
    return done.select(
        *kept, F.when(failed.isNull(), F.lit("web")).alias("source"), "_out.*",
        F.col("media"), F.col("meta.description").alias("description"), F.col("meta.language").alias("language"),
        iso(F.col("meta.modified_at")).alias("modified_at"), T.word_count(F.col("_out.content")).alias("word_count"),
        failed.alias("error_code"),
    )


def cap_output(df: DataFrame, columns: list[str], max_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """Entities whose JSON form is too long get `content_too_large`."""
    too_long = F.octet_length(F.to_json(F.struct(*columns))) > max_bytes
    return df.withColumn("error_code", F.coalesce(F.col("error_code"), F.when(too_long, F.lit("content_too_large"))))


def classify_status(status: Column) -> Column:
    """struct(code, status) of a failed response; null for a success."""
    answer = lambda code, http: F.struct(F.lit(code).alias("code"), F.lit(http).cast("long").alias("status"))
    return (
        F.when(status.between(200, 299), F.lit(None))
        .when(status.isin(404, 410), answer("not_found", 404))
        .when(status.isin(401, 403, 451), answer("source_blocked", 502))
        .otherwise(answer("upstream_error", 502))
    )
