"""Addresses of every kind through their endpoints, fallbacks and rescues."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.plans import api

J = json.dumps
requests, fetched = [], []
long = "A long enough sentence of public prose, with commas, that a reader takes for content. " * 6


def r(page_id, url):
    requests.append((page_id, url))


def f(url, body, status=200, content_type=None, link=None):
    fetched.append((url, status, content_type, link, body if isinstance(body, str) else J(body)))


r(1,'https://www.amazon.de/dp/B000000001')
f('https://www.amazon.de/gp/aw/d/B000000001','<html><body><span id="productTitle">Kettle</span><a id="bylineInfo">Marke: Acme</a><div id="corePrice_feature_div"><span class="a-price"><span class="a-offscreen">19,99 €</span></span></div><div class="basisPrice"><span class="a-price"><span class="a-offscreen">29,99 €</span></span></div><div id="feature-bullets"><ul><li><span class="a-list-item">Boils fast</span></li></ul></div><div id="twister"><li data-asin="B000000002" title="Red"></li></div></body></html>')
r(2,'https://www.amazon.de/s?k=tea+pot'); f('https://www.amazon.de/gp/aw/s?k=tea+pot','<div data-component-type="s-search-result" data-asin="B000000003"><h2>Pot</h2><span class="a-price"><span class="a-offscreen">9,99 €</span></span></div>')
r(3,'https://www.amazon.com/hz/wishlist/ls/ABCDE12345'); f('https://www.amazon.com/hz/wishlist/ls/ABCDE12345','<html><body>Sorry, we just need to make sure you\'re not a robot.</body></html>')
r(4,'https://apps.apple.com/de/app/x/id123456'); f('https://itunes.apple.com/lookup?id=123456&country=de&entity=software',{'results':[{'trackId':123456,'trackName':'App','artistName':'Dev','price':0,'currency':'EUR','formattedPrice':'Gratis'}]})
r(5,'https://play.google.com/store/apps/details?id=com.a.b'); f('https://play.google.com/store/apps/details?id=com.a.b&hl=en','<script type="application/ld+json">{"@type":"SoftwareApplication","name":"Play","author":{"name":"Dev"}}</script>')
r(6,'https://news.google.com/search?q=tea'); f('https://news.google.com/rss/search?q=tea&hl=en-US&gl=US&ceid=US%3Aen','<rss><channel><title>News</title><item><title>T1</title><link>https://n.example.org/1</link><pubDate>Sat, 03 Feb 2024 04:05:06 GMT</pubDate><source url="https://n.example.org">Pub</source></item></channel></rss>')
r(7,'https://bsky.app/profile/a.b/post/k1'); f('https://public.api.bsky.app/xrpc/app.bsky.feed.getPostThread?uri=at%3A%2F%2Fa.b%2Fapp.bsky.feed.post%2Fk1&depth=0&parentHeight=0',{'thread':{'post':{'author':{'handle':'a.b'},'record':{'text':'Hi'}}}})
r(8,'https://bsky.app/profile/a.b'); f('https://bsky.app/profile/a.b/rss','<rss><channel><title>@a.b - Bluesky</title><description>Bio</description><item><link>https://bsky.app/profile/a.b/post/1</link><description>Post one</description><pubDate>03 Feb 2024 04:05 +0000</pubDate></item></channel></rss>')
r(9,'https://www.instagram.com/p/AbC/'); f('https://graph.facebook.com/v25.0/instagram_oembed?url=https%3A%2F%2Fwww.instagram.com%2Fp%2FAbC%2F',{'html':'<blockquote>x</blockquote>'})
r(10,'https://www.instagram.com/somebody/'); 
ctx=J({'context':{'username':'somebody','full_name':'Some Body','followers_count':1200,'graphql_media':[{'shortcode_media':{'shortcode':'S1','edge_media_to_caption':{'edges':[{'node':{'text':'Hello #tag'}}]}}}]}})
f('https://www.instagram.com/somebody/embed/','<script>x({"contextJSON":'+J(ctx)+'})</script>')
r(11,'https://vimeo.com/123'); f('https://vimeo.com/api/oembed.json?url=https%3A%2F%2Fvimeo.com%2F123',{'title':'V','author_name':'A','duration':61})
r(12,'https://soundcloud.com/a/b'); f('https://soundcloud.com/oembed?format=json&url=https%3A%2F%2Fsoundcloud.com%2Fa%2Fb',{'title':'S'})
r(13,'https://open.spotify.com/track/abc'); f('https://open.spotify.com/oembed?url=https%3A%2F%2Fopen.spotify.com%2Ftrack%2Fabc',{'title':'Sp'})
r(14,'https://www.tiktok.com/@u/video/77'); f('https://www.tiktok.com/@u/video/77','<html>no model</html>'); f('https://www.tiktok.com/oembed?url=https%3A%2F%2Fwww.tiktok.com%2F%40u%2Fvideo%2F77',{'title':'Tk','author_name':'U','html':'<p>text</p>'})
r(15,'https://www.tiktok.com/@u'); f('https://www.tiktok.com/embed/@u?lang=en-US','<script id="__FRONTITY_CONNECT_STATE__" type="application/json">'+J({'source':{'data':{'/embed/@u':{'userInfo':{'uniqueId':'u','nickname':'You','followerCount':5},'videoList':[{'id':'9','desc':'clip','playCount':3}]}}}})+'</script>')
r(16,'https://x.com/u/status/55'); f('https://publish.x.com/oembed?url=https%3A%2F%2Fx.com%2Fu%2Fstatus%2F55&omit_script=true&dnt=true',{'html':'<p>post</p>','author_name':'Name','author_url':'https://x.com/u'})
r(17,'https://finance.yahoo.com/quote/AAA/'); f('https://query1.finance.yahoo.com/v8/finance/chart/AAA?interval=1d&range=1mo&events=div%2Csplits&includeAdjustedClose=true',{'chart':{'result':[{'meta':{'symbol':'AAA','currency':'USD','regularMarketPrice':12.5,'regularMarketTime':1706933106},'timestamp':[1706846706,1706933106],'indicators':{'quote':[{'open':[1,2],'high':[1,2],'low':[1,2],'close':[10,12.5],'volume':[5,6]}]}}]}})
r(18,'https://www.reddit.com/r/a/comments/x1/t/'); f('https://www.reddit.com/r/a/comments/x1/t/.rss','<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>P</title><link href="https://www.reddit.com/r/a/comments/x1/t/"/><author><name>/u/z</name></author><content type="html">body</content></entry></feed>')
r(19,'https://www.reddit.com/r/a/'); f('https://www.reddit.com/r/a/.rss','<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><updated>2024-02-03T04:05:06Z</updated><entry><title>P</title><link href="https://www.reddit.com/r/a/comments/x1/t/"/><content type="html">body</content></entry><entry><title>P2</title><link href="https://www.reddit.com/r/a/comments/x2/t/"/></entry></feed>')
r(20,'https://www.youtube.com/watch?v=abcdefghijk'); f('https://www.youtube.com/oembed?url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3Dabcdefghijk&format=json',{'title':'Yt','author_name':'Ch'})
r(21,'https://www.youtube.com/@chan'); f('https://www.youtube.com/@chan','<html>"channelId":"UCabc"</html>'); f('https://www.youtube.com/feeds/videos.xml?channel_id=UCabc','<feed xmlns="http://www.w3.org/2005/Atom"><title>Chan</title><entry><title>V1</title><link rel="alternate" href="https://www.youtube.com/watch?v=v1"/></entry></feed>')
r(22,'https://m.example.org/@a/99'); f('https://m.example.org/api/oembed?url=https%3A%2F%2Fm.example.org%2F%40a%2F99',{'title':'M','author_name':'A'}); f('https://m.example.org/api/v1/statuses/99',{'id':'99','content':'<p>toot</p>','account':{'acct':'a','display_name':'A'}})
r(23,'https://n.example.org/@a/98'); f('https://n.example.org/@a/98',f'<html><head><title>Page</title></head><body><article><p>{long}</p></article></body></html>')
r(24,'https://w.example.org/a'); f('https://w.example.org/a',f'<html><head><title>Page</title></head><body><article><p>{long}</p></article></body></html>')
block='<html><head><title>Just a moment...</title><link rel="alternate" type="application/rss+xml" href="/feed.xml"></head><body>Checking your browser<form id="challenge-form"></form></body></html>'
r(25,'https://w.example.org/blocked'); f('https://w.example.org/blocked',block); f('https://w.example.org/feed.xml','<rss><channel><title>Fd</title><item><title>S</title><link>https://w.example.org/story</link><description>Story text</description></item></channel></rss>')
r(26,'https://w.example.org/news/story-1'); f('https://w.example.org/news/story-1','<html><body></body></html>'); f('https://w.example.org/news/rss.xml','<rss><channel><title>Fd</title><item><title>S1</title><link>https://w.example.org/news/story-1?utm_source=x</link><description>Story one</description></item></channel></rss>')
r(27,'https://w.example.org/shell'); f('https://w.example.org/shell','<html><body><div id="root"></div><script src="/app.js"></script></body></html>')
r(28,'https://w.example.org/missing'); f('https://w.example.org/missing','',404)
r(29,'http://localhost/x'); r(30,'not a url'); r(31,'https://x.com/nobody'); r(32,'https://w.example.org/never')
r(33,'https://shop.example.org/products/cup'); f('https://shop.example.org/products/cup','<html><body class="shopify-section"><script>Shopify.currency = {"active":"EUR"}</script></body></html>'); f('https://shop.example.org/products/cup.js',{'id':5,'title':'Cup','handle':'cup','price':1250,'variants':[]})
r(34,'https://shop.example.org/collections/all'); f('https://shop.example.org/collections/all','<html><body class="shopify-section"></body></html>'); f('https://shop.example.org/collections/all/products.json?limit=50',{'products':[{'id':5,'title':'Cup','handle':'cup'},{'id':6,'title':'Pan','handle':'pan'}]})
r(35,'https://w.example.org/described'); f('https://w.example.org/described',f'<html><head><title>D</title><meta name="description" content="{long[:200]}"><link rel="alternate" type="application/json+oembed" href="/oe"></head><body></body></html>'); f('https://w.example.org/oe',{'title':'Embedded','html':'<p>x</p>'})
r(36,'https://w.example.org/described2'); f('https://w.example.org/described2',f'<html><head><title>D</title><meta name="description" content="{long[:200]}"></head><body></body></html>')

r(37, "https://w.example.org/plain")
f("https://w.example.org/plain", "# Notes\n\n" + long, 200, "text/markdown")
r(38, "https://www.tiktok.com/@gone/video/1")
f("https://www.tiktok.com/oembed?url=https%3A%2F%2Fwww.tiktok.com%2F%40gone%2Fvideo%2F1", "not json")
r(39, "https://apps.apple.com/de/app/y/id999999")
f("https://itunes.apple.com/lookup?id=999999&country=de&entity=software", {"results": []})
r(40, "https://apps.apple.com/us/app/z/id888888")
f("https://rss.marketingtools.apple.com/api/v2/us/apps/top-paid/100/apps.json", {"feed": {"results": [{"id": "888888", "name": "Charted", "artistName": "Dev"}]}})
r(41, "https://w.example.org/listing")
f("https://w.example.org/listing", "<html><body><h1>Things</h1>" + "".join(
    f'<div class="product-card"><a href="/p/{i}"><h3>Thing {i}</h3></a><span class="price">{i},00 €</span></div>' for i in range(1, 4)) + "</body></html>")


# page_id: kind, source, type, method, id, title, error
WANT = {
    1: ("amazon-product", "amazon", "product", "amazon-html", "B000000001", "Kettle", None),
    2: ("amazon-search", "amazon", "feed", "amazon-search-html", None, "Amazon search: tea pot", None),
    3: ("amazon-list", None, None, None, None, None, "source_blocked"),
    4: ("app-store", "app-store", "product", "app-store-lookup", "123456", "App", None),
    5: ("google-play", "google-play", "product", "google-play-html", "com.a.b", "Play", None),
    6: ("google-news", "google-news", "feed", "google-news-rss", "tea", "News", None),
    7: ("bluesky-post", "bluesky", "post", "bluesky-api", "k1", "Post by @a.b", None),
    8: ("bluesky-profile", "bluesky", "profile", "bluesky-rss", "a.b", "@a.b - Bluesky", None),
    9: ("instagram-post", "instagram", "post", "instagram-embed", "AbC", "Instagram post", None),
    10: ("instagram-profile", "instagram", "profile", "instagram-profile", "somebody", "Some Body", None),
    11: ("vimeo", "vimeo", "video", "vimeo-oembed", "123", "V", None),
    12: ("soundcloud", "soundcloud", "audio", "soundcloud-oembed", "b", "S", None),
    13: ("spotify", "spotify", "audio", "spotify-oembed", "abc", "Sp", None),
    14: ("tiktok-post", "tiktok", "post", "tiktok-oembed", "77", "Tk", None),
    15: ("tiktok-profile", "tiktok", "profile", "tiktok-profile-embed", "u", "You", None),
    16: ("x", "x", "post", "x-oembed", "55", "Post by @u", None),
    17: ("yahoo-finance", "yahoo-finance", "document", "yahoo-finance-chart", "AAA", "AAA (AAA)", None),
    18: ("reddit", "reddit", "post", "reddit-rss", "x1", "P", None),
    19: ("reddit", "reddit", "feed", "reddit-rss", "a", "F", None),
    20: ("youtube-video", "youtube", "video", "youtube-oembed", "abcdefghijk", "Yt", None),
    21: ("youtube-feed", "youtube", "feed", "youtube-atom", None, "Chan", None),
    22: ("mastodon", "mastodon", "post", "mastodon-oembed", "99", "Mastodon post by @a@m.example.org", None),
    23: ("mastodon", "web", "article", "linkedom", None, "Page", None),
    24: ("web", "web", "article", "linkedom", None, "Page", None),
    25: ("web", "web", "feed", "discovered-feed", None, "Fd", None),
    26: ("web", "web", "article", "discovered-feed", None, "S1", None),
    27: ("web", "web", "article", "browser", None, "App", None),
    28: ("web", None, None, None, None, None, "not_found"),
    29: (None, None, None, None, None, None, "invalid_url"),
    30: (None, None, None, None, None, None, "invalid_url"),
    31: ("x", None, None, None, None, None, "invalid_url"),
    32: ("web", None, None, None, None, None, "upstream_error"),
    33: ("web", "shopify", "product", "shopify-json", "5", "Cup", None),
    34: ("web", "shopify", "feed", "shopify-json", "all", "Shopify collection products", None),
    35: ("web", "web", "document", "oembed", None, "Embedded", None),
    36: ("web", "web", "document", "metadata", None, "D", None),
    37: ("web", "web", "document", "native-markdown", None, "Notes", None),
    38: ("tiktok-post", None, None, None, None, None, "upstream_error"),
    39: ("app-store", None, None, None, None, None, "not_found"),
    40: ("app-store", "app-store", "product", "app-store-chart", "888888", "Charted", None),
    41: ("web", "web", "feed", "product-list-html", None, "Things", None),
}


@pytest.fixture(scope="module")
def outcome(spark):
    bodies = spark.createDataFrame(fetched, "url string, status int, content_type string, link_header string, body string")
    shown = spark.createDataFrame([("https://w.example.org/shell", f"<html><head><title>App</title></head><body><article><p>{long}</p></article></body></html>")], "url string, html string")
    entities, items = api.extract_url(spark.createDataFrame(requests, "page_id long, url string"), bodies, F.lit("2026-01-01").cast("timestamp"), rendered=shown)
    lines = {}
    for i in items.orderBy("page_id", "position").collect():
        lines.setdefault(i.page_id, []).append(i)
    return {x.page_id: x for x in entities.collect()}, lines


def test_every_kind_has_its_outcome(outcome):
    rows, _ = outcome
    assert {k: (x.kind, x.source, x.type, x.method, x.id, x.title, x.error_code) for k, x in rows.items()} == WANT


def test_items_stand_in_a_table_of_their_own(outcome):
    _, items = outcome
    assert {k: [i.title for i in v] for k, v in items.items()} == {
        2: ["Pot"], 6: ["T1"], 8: [None], 10: ["Hello #tag"], 15: ["clip"], 19: ["P", "P2"], 21: ["V1"], 25: ["S"], 34: ["Cup", "Pan"], 41: ["Thing 1", "Thing 2", "Thing 3"]}


def test_details(outcome):
    rows, _ = outcome
    product = rows[1].attributes
    assert (product.brand, product.price, product.currency, product.compareAtPrice, product.features) == ("Acme", 1999, "EUR", 2999, ["Boils fast"])
    assert [(v.id, v.title) for v in product.variants] == [("B000000002", "Red")]
    chart = rows[17].attributes
    assert (chart.marketPrice, chart.previousClose, chart.change, chart.changePercent, len(chart.history)) == (12.5, 10.0, 2.5, 25.0, 2)
    assert rows[10].attributes.followerCount == 1200 and "Followers: 1,200" in rows[10].content
    assert rows[26].content == "Story one" and rows[26].url.endswith("story-1?utm_source=x")
    assert rows[28].content is None and rows[28].attributes is None


def test_output_limit_counts_items(spark):
    feed = "<rss><channel><title>Fd</title>" + "".join(f"<item><title>{i}</title><link>https://w.example.org/{i}</link><description>{long}</description></item>" for i in range(20)) + "</channel></rss>"
    from factloom.operators import dispatch

    bodies = spark.createDataFrame([("https://w.example.org/feed.xml", feed), ("https://w.example.org/blocked", block)], "url string, body string")
    one = spark.createDataFrame([(1, "https://w.example.org/blocked")], "page_id long, url string")
    for limit, error, n in ((30_000, None, 20), (20_000, "content_too_large", 0)):
        entities, items = dispatch.extract(one, bodies, F.lit("2026-01-01").cast("timestamp"), max_bytes=limit)
        assert [x.error_code for x in entities.collect()] == [error] and items.count() == n


def test_no_requests(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    entities, items = api.extract_url(none, spark.createDataFrame([], "url string, body string"), F.lit("2026-01-01").cast("timestamp"))
    assert entities.count() == 0 and items.count() == 0


def test_steps_run_in_small_tasks_and_without_sorts_of_bodies(spark):
    from factloom.operators import dispatch as D

    name, files = list(D.TASK_BYTES)
    before = spark.conf.get(name), spark.conf.get(files)
    try:
        spark.conf.set(name, "64MB")
        spark.conf.set(files, "1m")
        with D._small_tasks(spark):
            assert (spark.conf.get(name), spark.conf.get(files)) == ("8m", "1m")
        assert (spark.conf.get(name), spark.conf.get(files)) == ("64MB", "1m")
    finally:
        spark.conf.set(name, before[0])
        spark.conf.set(files, before[1])
    asked = spark.createDataFrame([(1, "https://a.example.org/"), (2, "https://b.example.org/"), (3, None)], "page_id long, address string")
    given = D._complete(spark.createDataFrame([("https://a.example.org/", "x")], "url string, body string"))
    out = D._answers(asked, given)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.page_id, r.body, r.failure) for r in out.collect()) == [(1, "x", None), (2, None, "upstream_error"), (3, None, "upstream_error")]
