"""Addresses of every kind and pages that need another form, answered by a table of fetched bodies that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans import api
from factloom.plans.tables import register_into, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)


def js(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def at(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def markup(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


AS_OF = "2026-01-01"

# One document of three lacks its first endpoint, so that the kind's next one, or none, answers.
@query("""with d as (select doc_id, doc_id % 22 as k, (doc_id // 22) % 3 = 2 as broken, cast(doc_id as varchar) as n, cast(10000000 + doc_id as varchar) as big, coalesce(text, '') as plain from documents),
r as (select *, case k
  when 0 then ['amazon','product','amazon-html','B' || lpad(n, 9, '0'),'Item ' || n] when 1 then ['amazon','feed','amazon-search-html',null,'Amazon search: tea ' || n]
  when 2 then ['app-store','product',case when broken then 'app-store-html' else 'app-store-lookup' end,big,case when broken then 'Page ' else 'App ' end || n]
  when 3 then ['google-play','product','google-play-html','com.e.a' || n,'Play ' || n] when 4 then ['google-news','feed','google-news-rss','tea ' || n,'News ' || n]
  when 5 then ['bluesky','post','bluesky-api','k' || n,'Post by @u' || n || '.e'] when 6 then ['bluesky','profile','bluesky-rss','u' || n || '.e','@u' || n || '.e - Bluesky']
  when 7 then ['instagram','post','instagram-embed','C' || n,case when broken then 'Instagram post' else 'Instagram post by @u' || n end]
  when 8 then ['instagram','profile','instagram-profile','u' || n,'User ' || n] when 9 then ['vimeo','video','vimeo-oembed',n,'Film ' || n]
  when 10 then ['soundcloud','audio','soundcloud-oembed','t' || n,'Song ' || n] when 11 then ['spotify','audio','spotify-oembed','t' || n,'Track ' || n]
  when 12 then ['tiktok','post',case when broken then 'tiktok-oembed' else 'tiktok-hydration' end,n,case when broken then 'Clip ' || n else 'TikTok post by @u' || n end]
  when 13 then ['tiktok','profile',case when broken then 'tiktok-hydration' else 'tiktok-profile-embed' end,'id' || n,'User ' || n]
  when 14 then ['x','post',case when broken then 'react-tweet' else 'x-oembed' end,n,'Post by @u' || n] when 15 then ['yahoo-finance','document','yahoo-finance-chart','T' || n,'Firm ' || n || ' (T' || n || ')']
  when 16 then ['reddit','post','reddit-rss','p' || n,'Thread ' || n] when 17 then ['reddit','feed','reddit-rss','r' || n,'Board ' || n]
  when 18 then ['youtube','video','youtube-oembed',lpad(n, 11, '0'),'Video ' || n] when 19 then ['youtube','feed','youtube-atom','UC' || n,'Channel ' || n]
  when 20 then ['mastodon','post','mastodon-oembed',n,case when broken then 'Mastodon post by Ann' else 'Mastodon post by @u@m.example.org' end]
  else ['web','document','native-markdown',null,null] end as e,
  case when k = 21 and broken then 'not_found' when k = 21 and length(trim(plain, ' ')) < 40 then 'extraction_failed' when broken and k not in (2, 7, 12, 13, 14, 20) then 'upstream_error' end as error_code from d)
select doc_id as page_id, e[1] as source, e[2] as type, e[3] as method, e[4] as id, e[5] as title, cast(case k when 1 then 1 when 4 then 2 when 6 then 1 when 8 then 1 when 13 then case when broken then 0 else 1 end when 17 then 2 when 19 then 1 else 0 end as bigint) as items,
  error_code from r where error_code is null
union all select doc_id, null, null, null, null, null, 0, error_code from r where error_code is not null""")
def dispatch_kinds(spark, folder):
    """Every document as an address of one of 22 kinds, read from that kind's endpoints."""
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("plain"))
    d = d.select("*", (F.col("doc_id") % 22).alias("k"), (F.floor(F.col("doc_id") / 22) % 3 == 2).alias("broken"), F.col("doc_id").cast("string").alias("n"),
                 (F.col("doc_id") + 10_000_000).cast("string").alias("big"))
    n, plain, big = F.col("n"), F.col("plain"), F.col("big")
    said = F.concat(F.lit("said "), plain)
    user, q = at("u", n), F.url_encode
    rss = lambda title, *items: at("<rss><channel><title>", title, "</title>", *[at("<item><title>", t, "</title><link>", u, "</link><description>", markup(markup(plain)), "</description></item>") for t, u in items], "</channel></rss>")
    atom = lambda title, *items: at('<feed xmlns="http://www.w3.org/2005/Atom"><title>', title, "</title>", *[at(
        "<entry><title>", t, '</title><link rel="alternate" href="', u, '"/><content type="html">', markup(markup(plain)), "</content></entry>") for t, u in items], "</feed>")
    model = lambda scope: at('<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__">{"__DEFAULT_SCOPE__":', F.replace(scope, F.lit("<"), F.lit("\\u003c")), "}</script>")
    quoted = lambda inner: at('<script>x({"contextJSON":', F.regexp_replace(F.regexp_replace(js(v=inner), r'^\{"v":', ""), r"\}$", ""), "})</script>")
    ld = lambda title: at('<script type="application/ld+json">', js(**{"@type": F.lit("SoftwareApplication"), "name": title, "author": js_struct(name=F.lit("Dev"))}), "</script>")
    asin, tag, video = at("B", F.lpad(n, 9, "0")), at("p", n), F.lpad(n, 11, "0")
    bsky, tweet, tok, watch = at("https://bsky.app/profile/u", n, ".e"), at("https://x.com/u", n, "/status/", n), at("https://www.tiktok.com/@u", n), at("https://www.youtube.com/watch?v=", video)
    toot, post, song = at("https://m.example.org/@u/", n), at("https://www.instagram.com/p/C", n, "/"), at("https://soundcloud.com/a/t", n)
    track, film, board = at("https://open.spotify.com/track/t", n), at("https://vimeo.com/", n), at("https://www.reddit.com/r/r", n)
    # Per kind: the address asked for, its first endpoint with the answer, and another one.
    kinds = [
        (at("https://www.amazon.de/x/dp/", asin), at("https://www.amazon.de/gp/aw/d/", asin), at(
            '<span id="productTitle">Item ', n, '</span><a id="bylineInfo">Marke: Acme</a><div id="feature-bullets"><ul><li><span class="a-list-item">', markup(said), "</span></li></ul></div>")),
        (at("https://www.amazon.com/s?k=tea+", n), at("https://www.amazon.com/gp/aw/s?k=tea+", n), at(
            '<div data-component-type="s-search-result" data-asin="', asin, '"><h2>', markup(said), "</h2></div>")),
        (at("https://apps.apple.com/de/app/x/id", big), at("https://itunes.apple.com/lookup?id=", big, "&country=de&entity=software"), js(results=F.array(js_struct(
            trackId=F.col("doc_id") + 10_000_000, trackName=at("App ", n), description=plain))), at("https://apps.apple.com/de/app/x/id", big), ld(at("Page ", n))),
        (at("https://play.google.com/store/apps/details?id=com.e.a", n), at("https://play.google.com/store/apps/details?id=com.e.a", n, "&hl=en"), ld(at("Play ", n))),
        (at("https://news.google.com/search?q=tea+", n), at("https://news.google.com/rss/search?q=tea+", n, "&hl=en-US&gl=US&ceid=US%3Aen"), rss(
            at("News ", n), (at("One"), at("https://n.example.org/", n, "/1")), (at("Two"), at("https://n.example.org/", n, "/2")))),
        (at(bsky, "/post/k", n), at("https://public.api.bsky.app/xrpc/app.bsky.feed.getPostThread?uri=", q(at("at://u", n, ".e/app.bsky.feed.post/k", n)), "&depth=0&parentHeight=0"), js(
            thread=js_struct(post=js_struct(author=js_struct(handle=at("u", n, ".e")), record=js_struct(text=said))))),
        (bsky, at(bsky, "/rss"), rss(at("@u", n, ".e - Bluesky"), (at("x"), at(bsky, "/post/1")))),
        (post, at(post, "embed/captioned/"), quoted(js(gql_data=js_struct(shortcode_media=js_struct(owner=js_struct(username=user), edge_media_to_caption=js_struct(
            edges=F.array(js_struct(node=js_struct(text=said)))))))), at("https://graph.facebook.com/v25.0/instagram_oembed?url=", q(post)), js(html=F.lit("<p>x</p>"))),
        (at("https://www.instagram.com/u", n, "/"), at("https://www.instagram.com/u", n, "/embed/"), quoted(js(context=js_struct(username=user, full_name=at("User ", n), graphql_media=F.array(
            js_struct(shortcode_media=js_struct(shortcode=F.lit("S"), edge_media_to_caption=js_struct(edges=F.array(js_struct(node=js_struct(text=said)))))))))) ),
        (film, at("https://vimeo.com/api/oembed.json?url=", q(film)), js(title=at("Film ", n), description=markup(plain))),
        (song, at("https://soundcloud.com/oembed?format=json&url=", q(song)), js(title=at("Song ", n), description=markup(plain))),
        (track, at("https://open.spotify.com/oembed?url=", q(track)), js(title=at("Track ", n), description=markup(plain))),
        (at(tok, "/video/", n), at(tok, "/video/", n), model(js(**{"webapp.video-detail": js_struct(itemInfo=js_struct(itemStruct=js_struct(id=n, desc=said, author=js_struct(uniqueId=user))))})),
         at("https://www.tiktok.com/oembed?url=", q(at(tok, "/video/", n))), js(title=at("Clip ", n), html=markup(said))),
        (tok, at("https://www.tiktok.com/embed/@u", n, "?lang=en-US"), at('<script id="__FRONTITY_CONNECT_STATE__">', F.replace(js(source=js_struct(data=js_struct(page=js_struct(
            userInfo=js_struct(uniqueId=user, id=at("id", n), nickname=at("User ", n)), videoList=F.array(js_struct(id=n, desc=said)))))), F.lit("<"), F.lit("\\u003c")), "</script>"),
         tok, model(js(**{"webapp.user-detail": js_struct(userInfo=js_struct(user=js_struct(uniqueId=user, id=at("id", n), nickname=at("User ", n), signature=plain)))}))),
        (tweet, at("https://publish.x.com/oembed?url=", q(tweet), "&omit_script=true&dnt=true"), js(html=markup(said), author_name=F.lit("Ann"), author_url=at("https://x.com/u", n)),
         at("https://cdn.syndication.twimg.com/tweet-result?id=", n), js(text=said, user=js_struct(name=F.lit("Ann"), screen_name=user))),
        (at("https://finance.yahoo.com/quote/T", n, "/"), at("https://query1.finance.yahoo.com/v8/finance/chart/T", n, "?interval=1d&range=1mo&events=div%2Csplits&includeAdjustedClose=true"), js(
            chart=js_struct(result=F.array(js_struct(meta=js_struct(symbol=at("T", n), longName=at("Firm ", n), regularMarketPrice=F.lit(2.5))))))),
        (at(board, "/comments/", tag, "/t/"), at(board, "/comments/", tag, "/t/.rss"), atom(at("Board ", n), (at("Thread ", n), at(board, "/comments/", tag, "/t/")))),
        (at(board, "/"), at(board, "/.rss"), atom(at("Board ", n), (at("A"), at(board, "/comments/a/")), (at("B"), at(board, "/comments/b/")))),
        (watch, at("https://www.youtube.com/oembed?url=", q(watch), "&format=json"), js(title=at("Video ", n), author_name=said)),
        (at("https://www.youtube.com/channel/UC", n), at("https://www.youtube.com/feeds/videos.xml?channel_id=UC", n), atom(at("Channel ", n), (at("V"), at("https://www.youtube.com/watch?v=v")))),
        (toot, at("https://m.example.org/api/v1/statuses/", n), js(id=n, content=markup(said), account=js_struct(acct=F.lit("u"))), at("https://m.example.org/api/oembed?url=", q(toot)), js(author_name=F.lit("Ann"))),
        (at("https://w.example.org/", n), at("https://w.example.org/", n), plain),
    ]
    none = F.lit(None).cast("string")
    answer = lambda url, body: F.struct(url.alias("url"), body.alias("body"))
    asked, answers = none, F.array().cast("array<struct<url:string,body:string>>")
    for i, (url, first, body, *more) in enumerate(kinds):
        here = F.col("k") == i
        asked = F.when(here, url).otherwise(asked)
        rest = F.array(answer(more[0], more[1])) if more else F.array().cast("array<struct<url:string,body:string>>")
        answers = F.when(here & F.col("broken"), rest).when(here, F.concat(F.array(answer(first, body)), rest)).otherwise(answers)
    d = d.withColumn("url", asked)
    # A page that is gone answers, too.
    gone = F.col("broken") & (F.col("k") == 21)
    fetched = d.select("k", F.explode(F.when(gone, F.array(answer(F.col("url"), F.lit("")))).otherwise(answers)).alias("a"), gone.alias("gone")).select(
        "a.url", F.when(F.col("gone"), 404).otherwise(200).alias("status"), F.when(F.col("k") == 21, F.lit("text/markdown")).alias("content_type"), "a.body")
    entities, items = api.extract_url(d.select(F.col("doc_id").alias("page_id"), "url"), fetched, F.lit(AS_OF).cast("timestamp"))
    counts = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("items"))
    return entities.join(counts, "page_id", "left").select(
        "page_id", "source", "type", "method", "id", F.when(F.col("kind") != "web", F.col("title")).alias("title"), F.coalesce("items", F.lit(0)).alias("items"), "error_code")


def js_struct(**fields):
    return F.struct(*[v.alias(k) for k, v in fields.items()])


@query("""with p as (select page_id, page_id % 10 as k, cast(page_id as varchar) as n from pages)
select page_id, case k when 1 then 'wordpress-json' when 2 then 'discovered-feed' when 0 then 'discovered-feed' when 4 then 'discovered-feed' when 5 then 'browser' when 6 then 'metadata' when 9 then 'oembed' end as method,
  case k when 1 then 'article' when 2 then 'feed' when 0 then 'feed' when 4 then 'article' when 5 then 'article' when 6 then 'document' when 9 then 'document' end as type,
  case k when 1 then 'Post ' || n when 2 then 'Feed ' || n when 0 then 'Feed ' || n when 4 then 'Story ' || n when 5 then 'App ' || n when 6 then 'Page ' || n when 9 then 'Embed ' || n end as title,
  case k when 3 then 'source_blocked' when 7 then 'not_found' when 8 then 'source_blocked' end as error_code from p""")
def page_rescue(spark, folder):
    """Blocked, empty and described pages, rescued by what they advertise, by guessed feeds, or by a browser's view."""
    p = table(spark, folder, "pages").select("page_id", (F.col("page_id") % 10).alias("k"), F.col("page_id").cast("string").alias("n"), F.coalesce("html", F.lit("")).alias("raw"))
    n, k = F.col("n"), F.col("k")
    site = at("https://s", n, ".example.org")
    url = at(site, F.when(k == 4, F.lit("/news/story-")).otherwise(F.lit("/p/")), n)
    long = F.concat(F.lit("A page, whose text is long enough to be read as content by anyone, says: "), F.repeat(F.lit("something useful, again. "), 12))
    link = lambda kind, href: f'<link rel="alternate" type="{kind}" href="{href}">'
    feed, wp, oembed = link("application/rss+xml", "/feed.xml"), link("application/json", "/wp-json/wp/v2/posts/1"), link("application/json+oembed", "/oembed")
    wall = lambda links: at(f"<html><head><title>Just a moment...</title>{links}</head><body>Checking your browser<form id=\"challenge-form\"></form></body></html>")
    described = lambda links: at("<html><head><title>Page ", n, '</title><meta name="description" content="', long, f'">{links}</head><body></body></html>')
    body = (
        F.when(k == 0, wall(feed)).when(k == 1, wall(wp + feed)).when(k == 2, wall(oembed + feed)).when(k == 3, wall("")).when(k == 4, F.lit("<html><body></body></html>"))
        .when(k == 5, F.lit('<html><body><div id="root"></div><script src="/app.js"></script></body></html>')).when(k == 6, described("")).when(k == 7, F.lit(""))
        .when(k == 8, F.lit("")).otherwise(described(oembed)))
    escaped = markup(markup(F.col("raw")))
    rss = at("<rss><channel><title>Feed ", n, "</title><item><title>Other</title><link>", site, "/other</link></item><item><title>Story ", n, "</title><link>", url,
             "?utm_source=feed</link><description>", escaped, "</description></item></channel></rss>")
    answer = lambda path, text, status=200: F.struct(at(site, path).alias("url"), F.lit(status).alias("status"), text.alias("body"))
    page = F.struct(url.alias("url"), F.when(k == 7, 404).when(k == 8, 403).otherwise(200).alias("status"), body.alias("body"))
    others = F.when(k.isin(0, 2, 7), F.array(answer("/feed.xml", rss), answer("/oembed", F.lit("{}")))).when(
        k == 1, F.array(answer("/feed.xml", rss), answer("/wp-json/wp/v2/posts/1", js(id=F.col("page_id"), title=js_struct(rendered=at("Post ", n)),
                        content=js_struct(rendered=at("<p>said ", markup(F.col("raw")), "</p>")))))).when(
        k == 4, F.array(answer("/news/rss.xml", F.lit("no feed")), answer("/news/feed", rss))).when(
        k == 9, F.array(answer("/oembed", js(title=at("Embed ", n), html=at("<p>", markup(F.col("raw")), "</p>"))), answer("/none", F.lit("")))).otherwise(
        F.array(answer("/none", F.lit("")), answer("/none2", F.lit(""))))
    fetched = p.select(F.explode(F.concat(F.array(page), others)).alias("a")).select("a.*")
    rendered = p.filter(k == 5).select(url.alias("url"), at("<html><head><title>App ", n, "</title></head><body><article><p>", long, "</p></article></body></html>").alias("html"))
    entities, _ = api.extract_url(p.select("page_id", url.alias("url")), fetched, F.lit(AS_OF).cast("timestamp"), rendered=rendered)
    return entities.select("page_id", "method", "type", "title", "error_code")
