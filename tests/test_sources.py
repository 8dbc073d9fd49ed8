import json

from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators import quality, search
from factloom.sources import catalogs, embeds, feeds, readers, sinks, social
from factloom.sources.entities import entity_rows, public_json


def payloads(spark, *rows):
    return spark.createDataFrame([(i, u, b if isinstance(b, str) else json.dumps(b)) for i, (u, b) in enumerate(rows)], "payload_id long, url string, body string")


def test_feed_forms_and_broken_payloads(spark):
    rss = '<rss><channel><title>F</title><item><title>A</title><guid isPermaLink="false">https://e.com/g</guid><content:encoded><![CDATA[<p>full</p>]]></content:encoded><description>short</description></item></channel></rss>'
    many = "<rss><channel>" + "".join(f"<item><title>{i}</title><link>https://e.com/{i}</link></item>" for i in range(60)) + "</channel></rss>"
    feed = {"version": "https://jsonfeed.org/version/1", "items": [{"id": "1", "title": " ", "content_html": "<b>x</b>", "author": {"name": "Old"}}]}
    out = feeds.parse_feeds(payloads(spark, ("https://e.com/", rss), ("https://e.com/", many), ("https://e.com/", "<rss><chan"), ("https://e.com/", {"version": "other"}), ("https://j.com/", feed))).collect()
    by = {}
    for r in out:
        by.setdefault(r.payload_id, []).append(r)
    assert [(r.url, r.title, r.content) for r in by[0]] == [("https://e.com/g", "A", "full")]
    assert len(by[1]) == 50 and 2 not in by and 3 not in by
    assert [(r.url, r.title, r.author, r.content) for r in by[4]] == [("https://j.com/", None, "Old", "**x**")]


def test_news_videos_community_profiles(spark):
    news = '<rss><channel><item><title>N</title><link>ftp://x</link><guid>https://n.com/1</guid><source url="https://pub.com">Pub</source><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>'
    video = '<feed xmlns:yt="y" xmlns:media="m"><title>C</title><entry><title>t</title><yt:videoId>abcdefghijk</yt:videoId><link rel="alternate" href="https://www.youtube.com/watch?v=abcdefghijk"/><author><name>Ann</name></author><published>2024-01-01T00:00:00+00:00</published><media:group><media:title>MT</media:title><media:thumbnail url="https://i.com/1.jpg"/><media:description>D*</media:description></media:group></entry></feed>'
    post = '<feed><title>r</title><entry><title>P</title><link href="https://www.reddit.com/r/a/comments/xyz1/t/"/><author><name>/u/a</name></author><updated>2024-01-01T00:00:00+00:00</updated><content type="html">&lt;p&gt;hi&lt;/p&gt;</content></entry></feed>'
    profile = "<rss><channel><title>@ann.social - Bluesky</title><item><link>https://bsky.app/profile/ann.social/post/k1</link><description>hey</description></item></channel></rss>"
    n = feeds.parse_news_feeds(payloads(spark, ("u", news))).first()
    assert (n.url, n.author, n.attributes.publisherUrl, n.publishedAt) == ("https://n.com/1", "Pub", "https://pub.com", "2024-01-01T00:00:00.000Z")
    v = feeds.parse_video_feeds(payloads(spark, ("u", video))).first()
    assert (v.id, v.title, v.author, v.media[0].url, v.content) == ("abcdefghijk", "MT", "Ann", "https://i.com/1.jpg", "D\\*\n\n![Video thumbnail](https://i.com/1.jpg)")
    p = feeds.parse_community_feeds(payloads(spark, ("u", post))).first()
    assert (p.id, p.author, p.content) == ("xyz1", "/u/a", "hi")
    b = feeds.parse_profile_feeds(payloads(spark, ("https://bsky.app/profile/ann.social", profile))).first()
    assert (b.id, b.author, b.attributes.handle) == ("k1", "@ann.social", "@ann.social")


def test_shop_price_kinds(spark):
    body = {"products": [{"id": 1, "title": "A", "price": 1999, "compare_at_price": "10.00"}, {"title": "B", "handle": "b c", "variants": [
        {"title": "x", "price": "5.5", "available": False}, {"title": "y", "price": "7", "compare_at_price": "9.00", "available": True}]}, {"title": " "}]}
    rows = payloads(spark, ("https://s.com/collections/all", body)).withColumn("currency", F.lit("USD"))
    a, b = catalogs.normalize_shopify(rows).orderBy("position").collect()
    assert (a.attributes.price, a.attributes.priceDisplay, a.attributes.compareAtPrice) == (1999, "19.99 USD", None)
    assert (b.url, b.attributes.price, b.attributes.compareAtPrice, [v.price for v in b.attributes.variants]) == ("https://s.com/products/b+c".replace("+", "+"), 700, 900, [550, 700])


def test_places_and_bad_features(spark):
    feature = lambda **p: {"properties": {"osm_type": "W", "osm_id": 5, **p}, "geometry": {"coordinates": [13.4, 52.5]}}
    body = {"features": [feature(name="Café", street="Weg", housenumber="1", city="Berlin", state="berlin", country="DE", extra={"contact:phone": "1"}), feature(), {"properties": {"name": "x"}, "geometry": {"coordinates": [0, 91]}}]}
    rows = catalogs.normalize_places(payloads(spark, ("u", body))).collect()
    assert [(r.title, r.attributes.address, r.attributes.phoneNumber, r.url) for r in rows] == [("Café", "Weg 1, Berlin, DE", "1", "https://www.openstreetmap.org/way/5")]


def test_chart_points_and_events(spark):
    body = {"chart": {"result": [{"meta": {"symbol": "X"}, "timestamp": [100, 200, None, 300], "indicators": {"quote": [{"close": [1.5, None, 2, -1], "volume": [10, None, 1, 2.5]}], "adjclose": [{"adjclose": [1.4]}]},
                                   "events": {"dividends": {"1": {"date": 100, "amount": 0.5}}, "splits": {"2": {"date": 50, "numerator": 2, "denominator": 0, "splitRatio": "2:1"}}}}]}}
    df = payloads(spark, ("u", body))
    assert [(r.position, r.close, r.adj_close, r.volume) for r in catalogs.chart_points(df).collect()] == [(0, 1.5, 1.4, 10)]
    d, s = catalogs.chart_events(df)
    assert d.first().amount == 0.5 and (s.first().numerator, s.first().denominator, s.first().split_ratio) == (2.0, None, "2:1")


def test_social_details(spark):
    tweet = {"text": "a*b", "user": {"name": "Ann", "screen_name": "ann", "is_blue_verified": True}, "created_at": "2024-01-01T00:00:00Z", "in_reply_to_status_id_str": "9", "views": {"count": "12"},
             "mediaDetails": [{"type": "photo", "media_url_https": "https://i.com/1.jpg"}, {"type": "video", "media_url_https": "https://i.com/2.jpg", "expanded_url": "https://x.com/v"}]}
    x = social.normalize_x(payloads(spark, ("https://x.com/ann/status/77", tweet))).first()
    assert (x.id, x.author, x.attributes.verified, x.attributes.inReplyToUrl, x.attributes.viewCount, x.attributes.mediaType) == ("77", "Ann (@ann)", True, "https://x.com/i/status/9", 12, "mixed")
    assert "a\\*b" in x.content and "[View attached video](https://x.com/v)" in x.content
    user = {"__DEFAULT_SCOPE__": {"webapp.user-detail": {"userInfo": {"user": {"uniqueId": "u1", "nickname": "U"}, "stats": {"followerCount": 5}}}}}
    page = f'<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__">{json.dumps(user)}</script>'
    p = social.normalize_tiktok_profiles(payloads(spark, ("https://www.tiktok.com/@u1", page), ("https://www.tiktok.com/@u2", "<html></html>"))).collect()
    assert [(r.id, r.author, r.attributes.followerCount) for r in p] == [("u1", "U (@u1)", 5)]
    inner = json.dumps({"context": {"username": "ann", "graphql_media": [{"shortcode_media": {"shortcode": "C1", "is_video": True, "edge_media_to_caption": {"edges": [{"node": {"text": "\nHello #x\nmore"}}]}}}]}})
    posts = social.instagram_profile_posts(payloads(spark, ("https://www.instagram.com/ann/", '{"contextJSON":' + json.dumps(inner) + "}"))).collect()
    assert [(r.url, r.title, r.attributes.hashtags) for r in posts] == [("https://www.instagram.com/reel/C1/", "Hello #x", ["x"])]


def test_embedded_json_needs_valid_json(values):
    assert values(lambda c: embeds.embedded_json(c, "m"), ['<script type="a" id="m">{"a":1}</script>', '<script id="m">{bad</script>', "<p>"]) == ['{"a":1}', None, None]


def test_license_filter(spark):
    rows = [("BY-NC 4.0", None, False, True), ("BY-ND", None, True, False), ("CC0 1.0", None, True, True), (None, None, False, False), (None, "https://creativecommons.org/licenses/by-nc-nd/4.0/", False, False)]
    df = spark.createDataFrame([r[:2] for r in rows], "n string, u string")
    got = [(r.r.commercial, r.r.modify) for r in df.select(search.license_rights(F.col("n"), F.col("u")).alias("r")).collect()]
    assert got == [r[2:] for r in rows]


def test_json_payload_errors(spark):
    out = readers.read_json_payloads(payloads(spark, ("u", {"a": 1}), ("u", "{bad"), ("u", "[1]")), S._struct([("a", S.L)])).orderBy("payload_id").collect()
    assert [r.error_code for r in out][:2] == [None, "upstream_error"] and out[0].data.a == 1


def test_url_list_and_ranked_domains(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\nhttps://a.example.com/1\n\nftp://b.com/\nhttps://www.example.com/2\nhttps://c.org/\nhttps://d.org/\n")
    assert [r.site for r in readers.read_url_list(spark, str(tmp_path / "urls.txt"), 2).collect()] == ["example.com", "c.org"]
    (tmp_path / "top.csv").write_text("1,a.com\n2,-b.com\n3,c\nx,d.com\n4, e.org\n")
    assert [(r["rank"], r.domain) for r in readers.read_ranked_domains(spark, str(tmp_path / "top.csv")).collect()] == [(1, "a.com"), (4, "e.org")]


def test_billing_tables_have_fixed_schemas(spark, tmp_path):
    for name, schema in S.BILLING_TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    tables = readers.read_billing(spark, str(tmp_path))
    assert tables["billing_ledger"].columns[:3] == ["id", "user_id", "kind"] and len(tables) == 12


def test_large_pages_become_error_rows(spark, tmp_path):
    spark.createDataFrame([(1, "https://e.com/", "x" * 50), (2, "https://e.com/", "y")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    out = {r.page_id: (r.html, r.error_code) for r in readers.read_pages(spark, str(tmp_path / "p"), 10).collect()}
    assert out == {1: (None, "content_too_large"), 2: ("y", None)}


def test_entities_are_written_without_lineage(spark, tmp_path):
    df = spark.createDataFrame([("T", "# Text")], "t string, c string")
    rows = entity_rows(df, [], type="article", source="web", method="linkedom", url=F.lit("https://e.com/"), title=F.col("t"), content=F.col("c"), attributes={"wordCount": F.lit(1)})
    ok, bad = quality.validate_entities(rows)
    assert ok.count() == 1 and bad.count() == 0
    sinks.write_entities(rows, str(tmp_path / "j"))
    text = spark.read.text(str(tmp_path / "j")).first().value
    assert '"schemaVersion":1' in text and "method" not in text and '"wordCount":1' in text and "price" not in text
    sinks.write_entities(rows, str(tmp_path / "m"), "markdown")
    assert spark.read.text(str(tmp_path / "m")).first().value == "# Text"
    sinks.write_report(df, str(tmp_path / "r"), "2024", df.select(F.col("c").alias("content")))
    assert spark.read.json(str(tmp_path / "r/latest/json")).first().t == "T"
    assert json.loads(rows.select(public_json().alias("j")).first().j)["title"] == "T"


def test_contract_rules(spark):
    base = dict(source="web", method="linkedom", url=F.lit("https://e.com/"), content=F.lit("c"))
    df = spark.range(1)
    good = entity_rows(df, [], type="product", attributes={"price": F.lit(1999), "currency": F.lit("EUR")}, **base)
    market = entity_rows(df, [], type="document", attributes={"currency": F.lit("GBp"), "latitude": F.lit(91.0)}, **base)
    post = entity_rows(df, [], type="post", attributes={"likeCount": F.lit(-1), "price": F.lit(1)}, **base)
    _, bad = quality.validate_entities(good.unionByName(market).unionByName(post))
    assert sorted((r.path, r.code) for r in bad.collect()) == [("attributes.latitude", "out_of_range"), ("attributes.likeCount", "too_small"), ("attributes.price", "unrecognized_key")]


def test_contract_document():
    names = [f["name"] for f in json.loads(S.contract_json())["fields"]]
    assert names[:4] == ["type", "source", "id", "url"] and len(S.ATTRIBUTES_TYPE.names) > 100 and len(S.METHODS) == 48 and len(S.SOURCES) == 23


def test_chart_values_are_rounded_as_rows(spark):
    from factloom.sources.catalogs import chart_points

    body = ('{"chart": {"result": [{"meta": {"symbol": "A", "currency": "EUR"}, "timestamp": [1, 2, null, 9e12, 5, 6], "indicators": {"quote": [{"open": [1.123456789, null, 3, 4, -1, "NaN"], '
            '"close": [null, null, 3, 4, null, 1e400], "volume": [1.5, 2.5, 3, 4, 7, -2]}], "adjclose": [{"adjclose": [null, null, 1, 1]}]}}]}}')
    payloads = spark.createDataFrame([("p", body), ("broken", "{"), ("none", None)], "payload_id string, body string")
    out = chart_points(payloads)
    # Values inside the arrays are interpreted one by one; rows are compiled.
    plan = out._jdf.queryExecution().executedPlan().toString()
    generated = plan[plan.index("Generate posexplode"):]
    assert "FLOOR" not in generated.split("+- Project")[0].replace("FLOOR(lambda", "")
    rows = sorted((r.payload_id, r.position, r.ts.timestamp(), r.open, r.close, r.adj_close, r.volume) for r in out.collect())
    assert rows == [("p", 0, 1.0, 1.12345679, None, None, None), ("p", 4, 5.0, None, None, None, 7)]
    assert [r.position for r in chart_points(payloads, 1).collect()] == [4]


def test_posts_are_read_once_per_body(spark):
    deep = {"user": {"screen_name": "a", "name": 'A "q"', "n": [1, {"b": "ü"}]}, "created_at": "", "text": None, "favorite_count": 3, "entities": "none"}
    rows = payloads(spark, ("u", deep), ("u", [deep]), ("u", '{"user": {"screen_name": "a"'), ("u", ""), ("u", '{"user": "a"}'), ("u", "{'text': 'single'}"), ("u", '{"text": "a\tb"}'), ("u", "[] {}"), ("u", "nothing"))
    paths = ["user/screen_name", "user/name", "user/n", "created_at", "text", "favorite_count", "entities/hashtags"]
    read, field = embeds.json_fields(rows, F.col("body"), paths)
    pairs = [(field(p), F.get_json_object("body", "$." + p.replace("/", "."))) for p in paths]
    for row in read.select(F.array(*[a for a, _ in pairs]).alias("got"), F.array(*[b for _, b in pairs]).alias("want"), "body").collect():
        assert row.got == row.want, row.body
    for parse in (social.normalize_bluesky, social.normalize_mastodon, social.normalize_x, social.normalize_tiktok, social.normalize_instagram):
        made = rows.withColumn("body", F.concat("body", F.lit(" ")))
        plan = parse(made)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("concat(body") == 1 and "get_json_object(body" not in plan, parse.__name__
