"""Any address to one entity: each kind of address is read from its own endpoints, and what failed goes on to the next step.

`requests` has page_id (unique) and url. `fetched` holds what the web answered, one row per address: url, body and optionally status, content_type,
link_header. All endpoints that follow from an address alone are joined with it once and kept by step and reader, so that a reader reads its own
bodies only. A step reads only pages that no earlier step answered; addresses that a page itself names (its feeds, its shop's products) are
joined for the pages still open.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom import schema as S
from factloom.functions import html as H
from factloom.functions import urls as U
from factloom.operators import endpoints as E
from factloom.operators.discovery import alternate_links
from factloom.operators.ordered import keep_first
from factloom.operators.pages import MAX_OUTPUT_BYTES, classify_status, extract_pages
from factloom.operators.quality import check_entities
from factloom.session import work_dir
from factloom.sources import catalogs, embeds, feeds, marketplace, networks, social
from factloom.sources.entities import entity_rows

ENTITY = [f.name for f in S.ENTITY.fields]
ITEM = ["position"] + [c for c in ENTITY if c != "method"]
# Errors of a page that no other form of it can mend.
FINAL_ERRORS = ("invalid_url", "unsafe_url", "not_found", "unsupported_content_type", "content_too_large", "timeout")
# Readers of JSON; a body that is none is an error of the source.
JSON_READERS = ("app-lookup", "app-chart", "bluesky-post", "embed", "oembed", "x-post", "chart", "mastodon")
# Readers whose pages are there but hold nothing usable; all others found nothing.
UNUSABLE = ("market-product", "market-search", "market-list", "app-page", "play-page")
# Readers that only add to the page's own outcome; when they fail, its error stays.
SILENT = ("wordpress", "page-oembed", "feed", "inferred", "rendered", "youtube-page")
READERS_AT_ONCE = 8
# Bytes that a task reads. Bodies and entities are sorted in tasks, unpacked and more than once; by default these bytes grow with the tables up to 64 and 128 MB.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "16m"}
Read = tuple[DataFrame, DataFrame | None]


def _stored(df: DataFrame, purpose: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A table in the shared work folder, so that steps are not computed again by the next ones."""
    path = work_dir(df.sparkSession, purpose)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _first_of_body(entities: DataFrame, position: str = "position") -> DataFrame:
    return entities.filter(F.col(position) == 0).drop(position)


def _app_lookup(rows: DataFrame) -> Read:
    found = catalogs.normalize_app_lookup(rows).join(rows.select("payload_id", U.app_store_id(F.col("url")).alias("_wanted")), "payload_id")
    return keep_first(found.filter(F.col("id") == F.col("_wanted")).drop("_wanted"), ["payload_id"], ["position"]).drop("position"), None


def _chart_feed(kind: str, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], Read]:
    def read(rows: DataFrame) -> Read:
        items = parse(rows)
        return networks.feed_parents(items, kind), items.select("payload_id", *ITEM)

    return read


def _community(rows: DataFrame) -> Read:
    """A post's address gives the post, any other one a feed."""
    items = feeds.parse_community_feeds(rows)
    post = U.path(F.col("page_url")).rlike(r"(?i)/comments/[a-z0-9]+")
    many = items.filter(~post)
    return items.filter(post & (F.col("position") == 0)).select("payload_id", *ENTITY).unionByName(networks.feed_parents(many, "reddit")), many.select("payload_id", *ITEM)


def _marketplace(kind: str) -> Callable[[DataFrame], Read]:
    def read(rows: DataFrame) -> Read:
        items = marketplace.card_items(rows, kind)
        return networks.marketplace_parents(items, kind), items.select("payload_id", *ITEM)

    return read


def _creators(rows: DataFrame) -> Read:
    items = networks.creator_posts(rows)
    return networks.profile_parents(items, "tiktok"), items.filter("position >= 0").select("payload_id", *ITEM)


def _instagram_profile(rows: DataFrame) -> Read:
    posts = social.instagram_profile_posts(rows)
    return networks.profile_parents(networks.with_profile(rows, posts), "instagram"), posts.select("payload_id", *ITEM)


def _inferred(rows: DataFrame) -> Read:
    """A guessed feed stands for a listing page; of another page it must hold the page itself."""
    items = feeds.parse_feeds(rows)
    listing = items.filter(U.is_blog_listing(F.col("page_url")))
    same = ~U.is_blog_listing(F.col("page_url")) & (U.canonical_url_key(F.col("url")) == U.canonical_url_key(F.col("page_url")))
    own = keep_first(items.filter(same), ["payload_id"], ["position"]).select("payload_id", *ENTITY)
    return networks.feed_parents(listing, "web").unionByName(own), listing.select("payload_id", *ITEM)


def _alone(parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], Read]:
    return lambda rows: (parse(rows), None)


def _embed(rows: DataFrame) -> Read:
    return networks.normalize_network_embeds(rows.withColumn("kind", F.regexp_replace("kind", "-.*", ""))), None


READERS: dict[str, Callable[[DataFrame], Read]] = {
    "market-product": _alone(marketplace.normalize_products), "market-search": _marketplace("search"), "market-list": _marketplace("list"),
    "app-lookup": _app_lookup, "app-page": _alone(lambda rows: catalogs.normalize_software_pages(rows, "app-store")), "app-chart": _alone(networks.normalize_app_charts),
    "play-page": _alone(catalogs.normalize_software_pages), "news-feed": _chart_feed("google-news", feeds.parse_news_feeds),
    "bluesky-post": _alone(social.normalize_bluesky), "bluesky-profile": _chart_feed("bluesky", feeds.parse_profile_feeds),
    "instagram-post": _alone(social.normalize_instagram), "instagram-profile": _instagram_profile, "embed": _embed,
    "oembed": _alone(embeds.normalize_oembed), "page-oembed": _alone(embeds.normalize_oembed), "tiktok-creator": _creators,
    "tiktok-page": _alone(lambda rows: social.normalize_tiktok(rows).unionByName(social.normalize_tiktok_profiles(rows))), "x-post": _alone(social.normalize_x),
    "chart": _alone(networks.normalize_charts), "reddit": _community, "youtube-feed": _chart_feed("youtube", feeds.parse_video_feeds),
    "mastodon": _alone(social.normalize_mastodon), "wordpress": _alone(embeds.normalize_wordpress), "feed": _chart_feed("web", feeds.parse_feeds), "inferred": _inferred,
}


def route(requests: DataFrame) -> DataFrame:
    """page_id, url (checked), kind and, for addresses that cannot be read, error_code."""
    checked = requests.select("page_id", F.col("url").alias("_asked"), U.validate_url(F.col("url")).alias("_v")).select(
        "page_id", F.coalesce("_v.url", "_asked").alias("url"), F.col("_v.error_code").alias("_bad"))
    kinds = checked.withColumn("kind", F.when(F.col("_bad").isNull(), E.address_kind(F.col("url"))))
    return kinds.select("page_id", "url", "kind", F.coalesce("_bad", E.kind_error(F.col("url"), F.col("kind"))).alias("error_code"))


def _answers(asked: DataFrame, fetched: DataFrame) -> DataFrame:
    """What the asked addresses (`address`) gave; an address without an answer is an error of the source. Addresses are looked up, so that bodies need no sort."""
    given = asked.hint("shuffle_hash").join(fetched.withColumnRenamed("url", "address"), "address", "left")
    failed = F.when(F.col("body").isNull() & F.col("status").isNull(), F.lit("upstream_error")).otherwise(classify_status(F.coalesce("status", F.lit(200)))["code"])
    return given.withColumn("failure", failed)


def _complete(fetched: DataFrame) -> DataFrame:
    df = fetched
    for name, kind in (("status", "int"), ("content_type", "string"), ("link_header", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select("url", F.col("status").cast("int").alias("status"), "content_type", "link_header", "body")


def _payload(rows: DataFrame) -> DataFrame:
    return rows.withColumn("payload_id", F.struct("page_id", "at"))


def _opened(read: Read, reader: str) -> tuple[DataFrame, DataFrame | None]:
    entities, items = read
    entities = entities.select(F.col("payload_id.page_id").alias("page_id"), F.col("payload_id.at").alias("at"), F.lit(reader).alias("reader"), *ENTITY,
                               F.lit(False).alias("provisional"))
    return entities, None if items is None else items.select(F.col("payload_id.page_id").alias("page_id"), F.col("payload_id.at").alias("at"), F.lit(reader).alias("reader"), *ITEM)


def _shops(pages: DataFrame, fetched: DataFrame) -> list[Read]:
    """Products of pages that show a shop's software, from the shop's own JSON."""
    routed = pages.withColumn("route", U.storefront_route(F.col("url"), F.col("body"))).filter("route is not null").withColumn(
        "currency", catalogs.storefront_currency(F.col("body")))
    asked = routed.select("page_id", "at", "url", "route", "currency", E.storefront_address(F.col("url"), F.col("route")).alias("address")).filter("address is not null")
    found = _payload(_answers(asked, fetched).filter("failure is null"))
    found = _stored(found.select("payload_id", "url", "route", "currency", "body"), "dispatch-shops")
    out = []
    for shop, parse in (("shopify", catalogs.normalize_shopify), ("woocommerce", catalogs.normalize_woocommerce)):
        own = found.filter(F.col("route.shop") == shop)
        if own.limit(1).count():
            items = parse(own)
            listed = items.join(own.filter("route.kind <> 'product'").select("payload_id"), "payload_id", "left_semi")
            out.append((networks.shop_parents(items, own, shop), listed.select("payload_id", *ITEM)))
    return out


def _pages(rows: DataFrame, as_of: Column, focus: Column | None, rendered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, items, failures) of ordinary pages. A page of which only the description is known stays open for better forms."""
    html = F.when(F.lit(rendered), H.strip_templates(F.col("body"))).otherwise(F.col("body"))
    given = rows.select("page_id", "at", "url", html.alias("html"), "content_type", "link_header")
    out = _stored(extract_pages(given, as_of, focus), "dispatch-pages")
    done = out.filter("error_code is null")
    if rendered:
        done = done.withColumn("type", F.when(F.col("method").isin("linkedom", "metadata"), "article").otherwise(F.col("type"))).withColumn(
            "method", F.when(F.col("method").isin("linkedom", "metadata"), "browser").otherwise(F.col("method")))
    article = F.col("type").isin("article", "document")
    entities = entity_rows(
        done, ["page_id", "at", F.lit("rendered" if rendered else "page").alias("reader"), (F.col("method") == "metadata").alias("provisional")], type=F.col("type"), source="web",
        method=F.col("method"), url=F.col("url"), title=F.col("title"), author=F.col("author"), published_at=F.col("published_at"), content=F.col("content"), media=F.col("media"), attributes={
            "description": F.when(article, F.col("description")), "language": F.when(article, F.col("language")), "modifiedAt": F.when(article, F.col("modified_at")),
            "wordCount": F.when(article, F.col("word_count")), "price": F.col("price"), "currency": F.col("currency"),
            "productType": F.when(F.col("type") == "product", F.lit("physical")),
            "feedType": F.when(F.col("method") == "product-list-html", F.lit("products")).when(F.col("method") == "blog-list-html", F.lit("blog"))})
    exploded = done.select("page_id", "at", F.col("method").alias("_how"), F.posexplode("items").alias("position", "i"))
    kind = F.when(F.col("_how") == "product-list-html", F.lit("product")).otherwise(F.lit("article"))
    items = entity_rows(
        exploded.withColumn("position", F.col("position").cast("long")), ["page_id", "at", F.lit("rendered" if rendered else "page").alias("reader"), "position"], type=kind, source="web",
        method=F.col("_how"), id=F.col("i.id"), url=F.col("i.url"), title=F.col("i.title"), author=F.col("i.author"), published_at=F.col("i.published_at"), content=F.col("i.content"),
        attributes={"price": F.col("i.price"), "currency": F.col("i.currency")})
    failures = out.filter("error_code is not null").select("page_id", "at", F.lit("page").alias("reader"), F.col("error_code").alias("failure"))
    return entities, items.select("page_id", "at", "reader", *ITEM), failures


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


def extract(
    requests: DataFrame, fetched: DataFrame, as_of: Column, focus: Column | None = None, rendered: DataFrame | None = None, max_bytes: int = MAX_OUTPUT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(entities, items): one row per request with the entity's fields or an error code, and the items of feeds, profiles and lists by position.

    `rendered` (url, html) holds pages as a browser shows them, for those that need one. Rows that break a rule of the entity contract fail with
    `extraction_failed`, those longer than `max_bytes` as JSON, items included, with `content_too_large`.
    """
    with _small_tasks(requests.sparkSession):
        return _told(*_steps(requests, _complete(fetched), as_of, focus, rendered), max_bytes)


def _steps(
    requests: DataFrame, fetched: DataFrame, as_of: Column, focus: Column | None, rendered: DataFrame | None,
) -> tuple[DataFrame, list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Routed requests, and what the steps stored: entities, items and failures."""
    routed = _stored(route(requests), "dispatch-routes")
    asked = routed.filter("error_code is null").select("page_id", "url", "kind", F.explode(E.attempts(F.col("url"), F.col("kind"))).alias("_a")).select("page_id", "url", "kind", "_a.*")
    known = _stored(_answers(asked, fetched), "dispatch-answers", ("step", "reader"))
    columns = [c for c in known.columns if c not in ("step", "reader")]
    found: list[DataFrame] = []
    listed: list[DataFrame] = []
    failures: list[DataFrame] = []
    closed: list[DataFrame] = []
    described: list[DataFrame] = []
    named: DataFrame | None = None
    # Which readers a step has: names of folders, at most one per reader and step.
    present = {(r.step, r.reader) for r in known.select("step", "reader").distinct().collect()}

    def still_open(rows: DataFrame, done: list[DataFrame]) -> DataFrame:
        for some in done:
            rows = rows.join(some, "page_id", "left_anti")
        return rows

    for step in range(max((s for s, _ in present), default=-1) + 2):
        rows = {r: still_open(known.filter((F.col("step") == step) & (F.col("reader") == r)), closed).select(columns) for s, r in sorted(present) if s == step}
        if "inferred" in rows:
            # Where a description is known, it stands unless the page itself names a better form.
            rows["inferred"] = still_open(rows["inferred"], described)
        if named is not None:
            for reader in ("wordpress", "page-oembed", "feed", "youtube-feed", "rendered"):
                extra = still_open(named.filter((F.col("step") == step) & (F.col("reader") == reader)), closed).select(columns)
                rows[reader] = rows[reader].unionByName(extra) if reader in rows else extra
        if "mastodon" in rows:
            # Only a site that describes the address as a post is asked for it.
            posts = known.filter((F.col("step") == step) & (F.col("reader") == "embed") & F.col("failure").isNull() & F.try_parse_json("body").isNotNull())
            rows["mastodon"] = rows["mastodon"].join(posts.select("page_id"), "page_id", "left_semi")
        # Readers do not depend on each other; their plans and jobs overlap.
        with ThreadPoolExecutor(READERS_AT_ONCE) as pool:
            results = [r for r in pool.map(lambda item: _run(*item, step, fetched, as_of, focus), rows.items()) if r is not None]
        for result in results:
            found += [result.entities] if result.entities is not None else []
            listed += [result.items] if result.items is not None else []
            failures += [result.failures] if result.failures is not None else []
        answered = _union([r.entities for r in results if r.entities is not None])
        if answered is not None:
            closed.append(answered.filter("not provisional").select("page_id").distinct())
            described.append(answered.filter("provisional").select("page_id"))
        lost = _union([r.failures for r in results if r.failures is not None])
        if lost is not None:
            closed.append(lost.filter((F.col("reader") == "page") & F.col("failure").isin(*FINAL_ERRORS)).select("page_id"))
        pages = [r.pages for r in results if r.pages is not None]
        if pages:
            fresh = _stored(_named(still_open(_union(pages), closed), step, fetched, rendered, described), "dispatch-named")
            named = fresh if named is None else named.unionByName(fresh)
    return routed, found, listed, failures


def _size(setting: str) -> int:
    """Bytes of a size setting such as 64MB."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def _small_tasks(spark: SparkSession):
    """Tasks of TASK_BYTES at most while the steps run; the session's own settings come back."""
    before = {name: spark.conf.get(name, None) for name in TASK_BYTES}
    try:
        for name, size in TASK_BYTES.items():
            if before[name] is None or _size(before[name]) > _size(size):
                spark.conf.set(name, size)
        yield
    finally:
        for name, size in before.items():
            spark.conf.unset(name) if size is None else spark.conf.set(name, size)


@dataclass
class Result:
    """What a reader made of its bodies: stored entities, items and failures, and pages that may name further addresses."""
    entities: DataFrame | None = None
    items: DataFrame | None = None
    failures: DataFrame | None = None
    pages: DataFrame | None = None


def _run(reader: str, answers: DataFrame, step: int, fetched: DataFrame, as_of: Column, focus: Column | None) -> Result | None:
    # A step late in a chain is often empty; its readers are then not even planned.
    if not answers.limit(1).count():
        return None
    good = _payload(answers.filter("failure is null"))
    named = F.lit(reader).alias("reader")
    failed = [] if reader in SILENT else [answers.filter("failure is not null").select("page_id", "at", named, "failure")]
    if reader == "youtube-page":
        return Result(pages=good)
    items: list[DataFrame] = []
    if reader in ("page", "rendered"):
        entities, rest = [], good
        if reader == "page":
            shops = [_opened(s, "shop") for s in _shops(good, fetched)]
            if shops:
                entities.append(_stored(_union([s[0] for s in shops]), "dispatch-shop-rows"))
                items += [s[1] for s in shops]
                rest = good.join(entities[0].select("page_id"), "page_id", "left_anti")
        got, lines, errors = _pages(rest, as_of, focus, reader == "rendered")
        got, items = _union([*entities, got]), [*items, lines]
        failed += [errors] if reader == "page" else []
    else:
        got, lines = _opened(READERS[reader](good), reader)
        got = _stored(got, "dispatch-read")
        items += [lines] if lines is not None else []
        if reader not in SILENT:
            empty = good.join(got.select("page_id", "at"), ["page_id", "at"], "left_anti")
            code = F.lit("extraction_failed" if reader in UNUSABLE else "not_found")
            if reader in JSON_READERS:
                code = F.when(F.try_parse_json("body").isNull(), F.lit("upstream_error")).otherwise(code)
            if reader.startswith("market"):
                code = F.when(marketplace.is_verification(F.col("body")), F.lit("source_blocked")).otherwise(code)
            failed.append(empty.select("page_id", "at", named, code.alias("failure")))
    tagged = lambda df, purpose: _stored(df.withColumn("step", F.lit(step)), purpose)
    return Result(tagged(got, "dispatch-entities"), tagged(_union(items), "dispatch-items") if items else None,
                  tagged(_union(failed), "dispatch-failures") if failed else None, good if reader == "page" else None)


def _named(good: DataFrame, step: int, fetched: DataFrame, rendered: DataFrame | None, described: list[DataFrame]) -> DataFrame:
    """Answers of addresses that open pages name, for the steps to come: advertised forms next, the page in a browser last."""
    links = alternate_links(good.select("page_id", "url", F.col("body").alias("html"), "link_header"))
    readers = {"wordpress": ("wordpress", 0), "oembed": ("page-oembed", 1), "feed": ("feed", 2)}
    reader = F.lit(None).cast("string")
    order = F.lit(0)
    for kind, (name, at) in readers.items():
        reader, order = F.when(F.col("k") == kind, F.lit(name)).otherwise(reader), F.when(F.col("k") == kind, F.lit(at)).otherwise(order)
    ordinary = F.col("kind").isin("web", "mastodon")
    linked = good.filter(ordinary).select("page_id", "url", "kind").join(links.select("page_id", F.col("kind").alias("k"), F.col("href").alias("address")), "page_id").select(
        "page_id", "url", "kind", F.lit(step + 1).alias("step"), order.alias("at"), reader.alias("reader"), "address")
    channels = good.filter(F.col("kind") == "youtube-feed").select(
        "page_id", "url", "kind", F.lit(step + 1).alias("step"), F.lit(0).alias("at"), F.lit("youtube-feed").alias("reader"), E.channel_feed(F.col("body")).alias("address"))
    out = _answers(linked.unionByName(channels.filter("address is not null")), fetched)
    if rendered is not None:
        # Of pages known by their description only that stands; a browser is for pages that gave nothing.
        shells = good.filter(ordinary & H.needs_render(F.col("body")))
        for some in described:
            shells = shells.join(some, "page_id", "left_anti")
        shown = shells.select("page_id", "url", "kind").join(rendered.select("url", F.col("html").alias("body")), "url")
        out = out.unionByName(shown.select(
            "page_id", "url", "kind", F.lit(step + 3).alias("step"), F.lit(0).alias("at"), F.lit("rendered").alias("reader"), F.col("url").alias("address"), F.lit(200).alias("status"),
            F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("link_header"), "body", F.lit(None).cast("string").alias("failure")))
    return out


def _told(routed: DataFrame, found: list[DataFrame], listed: list[DataFrame], failures: list[DataFrame], max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The best outcome per request, checked against the contract and the output limit."""
    spark = routed.sparkSession
    blank = entity_rows(spark.range(0).select(F.lit(0).cast("long").alias("page_id"), F.lit(0).alias("at"), F.lit("").alias("reader"), F.lit(False).alias("provisional")),
                        ["page_id", "at", "reader", "provisional"], type="", source="", method="", url=F.lit("")).withColumn("step", F.lit(0))
    every = _union(found) if found else blank.withColumn("page_id", F.col("page_id").cast(routed.schema["page_id"].dataType))
    order = [F.col("provisional"), F.col("step"), F.col("at")]
    best = keep_first(every.withColumns({f"_o{i}": c for i, c in enumerate(order)}), ["page_id"], ["_o0", "_o1", "_o2"]).drop("_o0", "_o1", "_o2", "provisional")
    lines = _union(listed) if listed else None
    if lines is not None:
        lines = lines.join(best.select("page_id", "at", "reader", "step"), ["page_id", "at", "reader", "step"], "left_semi").select("page_id", *ITEM)
        sizes = lines.groupBy("page_id").agg(F.sum(F.octet_length(F.to_json(F.struct(*ITEM)))).alias("_items"))
        best = best.join(sizes, "page_id", "left")
    else:
        lines = best.limit(0).select("page_id", F.lit(0).cast("long").alias("position"), *[c for c in ENTITY if c != "method"])
        best = best.withColumn("_items", F.lit(0).cast("long"))
    checked = check_entities(best)
    long = F.octet_length(F.to_json(F.struct(*ENTITY))) + F.coalesce("_items", F.lit(0)) > max_bytes
    checked = checked.withColumn("_broken", F.when(F.size("violations") > 0, F.lit("extraction_failed")).when(long, F.lit("content_too_large")))
    errors = None
    if failures:
        # The error of the page itself, else of the last endpoint asked; an app that some endpoint answered without is not there.
        last = _union(failures).groupBy("page_id").agg(
            F.max_by("failure", F.struct((F.col("reader") == "page").alias("own"), "step", "at")).alias("_failure"),
            F.max(F.col("reader").startswith("app-") & F.col("failure").isin("not_found", "extraction_failed")).alias("_absent"))
        errors = last.select("page_id", F.when(F.col("_absent"), F.lit("not_found")).otherwise(F.col("_failure")).alias("_failure"))
    out = routed.withColumnRenamed("url", "requested_url").join(checked.drop("at", "reader", "step", "violations", "_items"), "page_id", "left")
    out = out.join(errors, "page_id", "left") if errors is not None else out.withColumn("_failure", F.lit(None).cast("string"))
    code = F.coalesce("error_code", "_broken", F.when(F.col("type").isNull(), F.coalesce("_failure", F.lit("extraction_failed"))))
    out = out.withColumn("error_code", code)
    kept = [F.when(F.col("error_code").isNull(), F.col(c)).alias(c) for c in ENTITY]
    entities = out.select("page_id", "requested_url", "kind", *kept, "error_code")
    return entities, lines.join(out.filter("_broken is not null").select("page_id"), "page_id", "left_anti")
