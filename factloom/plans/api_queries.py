"""The public jobs and request rules over the given tables, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import controls as C
from factloom.functions import urls as U
from factloom.operators.pages import cap_output
from factloom.plans import api
from factloom.plans.market_queries import TICKS_SQL, bars_sql, day
from factloom.plans.page_queries import search_queries, search_sql
from factloom.plans.tables import TICK_ORDER, register_into, table, ticks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)


@query("""with r as (select event_id, ['10','0','3.0','51','x','7'][(event_id % 6) + 1] as l, ['EN-us','de','zh-hans-cn','not a tag!','fr-FR'][(event_id % 5) + 1] as g, ['us',' de ','usa'][(event_id % 3) + 1] as c,
  ['7d','any','2w'][(event_id % 3) + 1] as t, ['Example.com.','sub.example.org','http://x.com','localhost'][(event_id % 4) + 1] as s from events),
n as (select event_id, case l when '10' then '10' when '3.0' then '3' when '7' then '7' end as l, case g when 'EN-us' then 'en-US' when 'de' then 'de' when 'zh-hans-cn' then 'zh-Hans-CN' when 'fr-FR' then 'fr-FR' end as g,
  case c when 'us' then 'US' when ' de ' then 'DE' end as c, case when t <> '2w' then t end as t, case s when 'Example.com.' then 'example.com' when 'sub.example.org' then 'sub.example.org' end as s from r)
select event_id, l as "limit", g as language, c as country, t as timeframe, s as site, case when l is null or g is null or c is null or t is null or s is null then 'invalid_request' end as error_code from n""")
def request_controls(spark, folder):
    """Controls of every request, with the error of a bad one."""
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    rows = table(spark, folder, "events").select(
        "event_id", pick("10", "0", "3.0", "51", "x", "7").alias("limit"), pick("EN-us", "de", "zh-hans-cn", "not a tag!", "fr-FR").alias("language"),
        pick("us", " de ", "usa").alias("country"), pick("7d", "any", "2w").alias("timeframe"), pick("Example.com.", "sub.example.org", "http://x.com", "localhost").alias("site"))
    return C.normalize_controls(rows, "news")


@query("""select event_id, case when event_id % 3 = 0 then 'https://facts.example.org/mine?x=1' else 'https://facts.example.org/api/finance/movers?' || case when event_id % 2 = 0 then 'list=losers&' else '' end
  || case when user_id % 10 <> 0 then 'limit=' || user_id || '&' else '' end || 'format=json' end as url from events""")
def result_urls(spark, folder):
    """Public addresses with defaults left out; foreign caller addresses are not taken over."""
    e = table(spark, folder, "events")
    caller = F.when(F.col("event_id") % 3 == 0, "https://facts.example.org/mine?x=1").otherwise("https://other.example.com/")
    which = F.when(F.col("event_id") % 2 == 0, "losers").otherwise("gainers")
    limit = F.when(F.col("user_id") % 10 == 0, F.lit("10")).otherwise(F.col("user_id").cast("string"))
    params = [("list", which, "gainers"), ("limit", limit, "10"), ("format", F.lit("json"), None)]
    return e.select("event_id", C.result_url("https://facts.example.org", "finance/movers", params, caller, own_host=True).alias("url"))


@query(r"""select event_id, source, id, canonical from (select event_id, unnest([
  struct_pack(source := 'amazon', id := 'B' || lpad(cast(event_id as varchar), 9, '0'), canonical := 'https://www.amazon.de/dp/B' || lpad(cast(event_id as varchar), 9, '0')),
  struct_pack(source := 'x', id := cast(event_id as varchar), canonical := 'https://x.com/i/status/' || event_id),
  struct_pack(source := 'instagram', id := 'C' || event_id, canonical := 'https://www.instagram.com/reel/C' || event_id || '/'),
  struct_pack(source := 'yahoo-finance', id := 'T' || event_id, canonical := 'https://finance.yahoo.com/quote/t' || event_id || '/history'),
  struct_pack(source := 'google-news', id := cast(null as varchar), canonical := 'https://news.google.com/topics/T' || event_id || '?hl=de-DE&gl=DE&ceid=DE%3Ade'),
  struct_pack(source := 'mastodon', id := cast(event_id as varchar), canonical := 'https://m.example.org/@a/' || event_id),
  struct_pack(source := 'web', id := cast(null as varchar), canonical := 'https://x.com.example.org/a/status/' || event_id)]) as s from events), lateral (select s.source as source, s.id as id, s.canonical as canonical)""")
def source_classes(spark, folder):
    """Source, identifier and stable address of recognizable addresses and a lookalike."""
    n = F.col("event_id").cast("string")
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    urls = F.array(
        at("https://www.amazon.de/some-thing/dp/b", F.lpad(n, 9, "0"), "?th=1"), at("https://twitter.com/someone/status/", n, "?s=20"), at("https://www.instagram.com/reel/C", n, "/?igsh=1"),
        at("https://finance.yahoo.com/quote/t", n, "/history"), at("https://news.google.com/topics/T", n, "?hl=de-DE&gl=DE&ceid=DE:de"), at("https://m.example.org/@a/", n), at("https://x.com.example.org/a/status/", n))
    rows = table(spark, folder, "events").select("event_id", F.explode(urls).alias("url"))
    u = F.col("url")
    return rows.select("event_id", U.classify_source(u).alias("source"), U.extract_ids(u).alias("id"), U.canonical_entity_url(u).alias("canonical"))


@query("""select doc_id, case when octet_length(encode(cast(to_json({'content': text}) as varchar))) > 4000 then 'content_too_large' end as error_code from documents""")
def output_cap(spark, folder):
    """Entities whose JSON, escapes and all, is over the limit (here 4000 bytes)."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("error_code"))
    return cap_output(rows, ["content"], 4_000).select("doc_id", "error_code")


@query(f"""with {search_sql()}, r as (select query_id, doc_id, row_number() over (partition by query_id order by matched desc, doc_id) as pos from hits qualify pos <= 3)
select query_id, count(*) filter (pos is not null) as result_count, '# Search results for ' || any_value(q) || coalesce(string_agg(chr(10) || chr(10) || pos || '. [Document ' || doc_id || '](https://d.example.org/' || doc_id || ')', '' order by pos), '') as content
from (select item_id as query_id, text as q from benchmark) left join r using (query_id) group by query_id""")
def search_feeds(spark, folder):
    """Web search as feeds with numbered links; queries without a result get an empty feed."""
    asked = search_queries(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("https://d.example.org/"), "doc_id").alias("url"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("text").alias("content"))
    # Titles and addresses hold no query words, so relevance is that of the text.
    found = api.search_web(asked, [(docs, True)], limit=3).withColumn("content", F.lit(""))
    return api.feeds(found, asked, "Search").drop("query")


@query("""with a as (select user_id as query_id, event_id as position, case when event_type <> 'error' then ts end as published_at from events)
select query_id, position, row_number() over (partition by query_id order by position) as pos from a where published_at >= timestamp '2024-01-25 00:00:00' - interval 7 day and published_at is not null and query_id in (select c_custkey from customer) qualify pos <= 10""")
def news_feed(spark, folder):
    """Articles of the last week in feed order, ten per query."""
    rows = table(spark, folder, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("position"), F.when(F.col("event_type") != "error", F.col("ts")).alias("published_at"))
    asked = table(spark, folder, "customer").select(F.col("c_custkey").alias("query_id"))
    return api.search_news(asked, rows, F.lit("2024-01-25").cast("timestamp"), "7d").select("query_id", "position", "pos")


@query("""with p as (select user_id as query_id, event_id as position, case when event_type = 'error' then null else 'Ann ' || (user_id % 4) end as author, event_id % 2 as level, 'https://' || case when event_id % 3 = 0 then 'www.youtube.com' else 'v.example.org' end || '/' || event_id as url from events),
a as (select *, 0 as source_rank from p where level = 0 and author = 'Ann 1'),
b as (select *, 1 as source_rank from p where level = 1 and author = 'Ann 1' and starts_with(url, 'https://www.youtube') and query_id not in (select query_id from a))
select query_id, position, source_rank::bigint as source_rank, row_number() over (partition by query_id order by position) as pos from (select * from a union all select * from b) qualify pos <= 10""")
def video_feed(spark, folder):
    """The fallback alone is tested for platform and relevance."""
    e = table(spark, folder, "events")
    host = F.when(F.col("event_id") % 3 == 0, "www.youtube.com").otherwise("v.example.org")
    rows = e.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("position"), F.concat(F.lit("https://"), host, F.lit("/"), "event_id").alias("url"), F.lit("clip").alias("title"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("Ann "), F.col("user_id") % 4)).alias("author"), F.lit("").alias("content"), F.col("ts").alias("published_at"), F.lit(None).cast("string").alias("displayed_age"))
    asked = rows.select("query_id").distinct().withColumn("query", F.lit("the clip"))
    out = api.search_videos(asked, rows.filter(F.col("position") % 2 == 0), rows.filter(F.col("position") % 2 == 1), "youtube", "@ann 1")
    return out.select("query_id", "position", "source_rank", "pos")


@query(f"""with {bars_sql('day', "ts <= timestamp '2000-06-30' and ts > timestamp '2000-06-30' - interval 1 year")},
r as (select *, row_number() over (partition by symbol order by bar desc) as n from bars)
select symbol, strftime(max(bar), '%Y-%m-%d') as ts, max(case when n = 1 then close end) as price, max(case when n = 2 then close end) as previous_close, count(*) as points from r group by symbol""")
def market_data(spark, folder):
    """History and snapshot of a year."""
    bars, quotes = api.market_data(ticks(spark, folder), "1y", F.lit("2000-06-30").cast("timestamp"), TICK_ORDER)
    points = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("points"))
    return quotes.select("symbol", day("ts").alias("ts"), "price", "previous_close").join(points, "symbol")
