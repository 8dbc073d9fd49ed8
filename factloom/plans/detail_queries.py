"""Functions and sinks that other jobs use in passing, each over a whole table and with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import page_date
from factloom.operators import billing as B
from factloom.operators import cachelog, joins, market, places, quality, reports
from factloom.plans.tables import register_into, table
from factloom.session import work_dir
from factloom.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)

SECRET = "pepper"
PADS = [bytes(k ^ pad for k in SECRET.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


def at(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"""with m as (select event_id, strftime(ts, '%Y-%m-%d') as day, '10.0.' || user_id % 7 || '.' || user_id as client from events)
select event_id, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(day || chr(10) || client)))) as pseudonym from m""")
def client_pseudonyms(spark, folder):
    """a keyed hash of day and client for every event."""
    n, user = F.col("event_id"), F.col("user_id")
    return table(spark, folder, "events").select(n, ids.client_pseudonym(F.date_format("ts", "yyyy-MM-dd"), at("10.0.", user % 7, ".", user), SECRET).alias("pseudonym"))


@query(r"""select doc_id, 'A <' || source || '> é€… "' || lang || '" & x' as decoded, '# ' || source as first_line, source as title, array_to_string(kept, ' ') as tags, case doc_id % 4 when 0 then 'weather ' || lang when 1 then 'of' when 2 then 'germany ' || 'green ' || source || ' party' else 'Berlin ' || lang end as discovery
from (select *, case when doc_id % 3 = 0 then ['t' || doc_id, 'Größe_1'] else ['t' || doc_id] end as kept from documents)""")
def text_details(spark, folder):
    """entities, first line, heading, hashtags and the query sent to an index."""
    d, n = table(spark, folder, "documents"), F.col("doc_id")
    source, lang = F.col("source"), F.col("lang")
    markup = at("A &lt;", source, "&gt; &eacute;&#8364;&hellip; &quot;", lang, "&quot; &amp; x")
    post = at("\n  \n# ", source, "\nsecond #t", n, F.when(n % 3 == 0, " #Größe_1").otherwise(""), " #t", n, " a# b")
    asked = F.when(n % 4 == 0, at("what is the weather ", lang)).when(n % 4 == 1, "in of").when(n % 4 == 2, at("die green ", source, " party")).otherwise(at("Berlin ", lang))
    return d.select(
        n, T.decode_entities(markup).alias("decoded"), T.first_line(post).alias("first_line"), T.title_from_markdown(post).alias("title"), F.array_join(T.hashtags(post), " ").alias("tags"),
        T.discovery_query(asked, F.when(n % 2 == 0, F.lit("Germany"))).alias("discovery"))


@query("""with p as (select *, ts from (select event_id, ts, case event_id % 4 when 0 then '' when 1 then '/' else '/a/' || event_id end as path from events))
select event_id, epoch_us(case when path not in ('', '/') and ts <= timestamp '2024-01-11 00:00:00' then date_trunc('second', ts) end) as published_us from p""")
def page_dates(spark, folder):
    """published dates, dropped on a site's root and when more than a day ahead."""
    n = F.col("event_id")
    path = F.when(n % 4 == 0, "").when(n % 4 == 1, "/").otherwise(at("/a/", n))
    stated = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, folder, "events").select(n, F.unix_micros(page_date(stated, U.path(at("https://a.example.com", path)), F.lit("2024-01-10").cast("timestamp"))).alias("published_us"))


@query("""select c_custkey, 'https://n' || c_custkey || case when c_custkey % 3 = 0 then '.xn--bcher-kva.example.com/x?y=ü' else '.example.com/x?y=ü' end as url,
  case c_custkey % 5 when 0 then true when 1 then false when 2 then false when 3 then true else false end as valid, c_custkey % 3 > 0 as within from customer""")
def international_hosts(spark, folder):
    """Hosts outside ASCII, valid domain names, hosts below a site."""
    n = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(n, at("https://n", n, F.when(n % 3 == 0, ".bücher").otherwise(""), ".example.com/x?y=ü").alias("url"))
    name = F.when(n % 5 == 0, at("a", n, ".example.com")).when(n % 5 == 1, at("-a", n, ".com")).when(n % 5 == 2, at("a", n)).when(
        n % 5 == 3, at("x-", n, ".y.org")).otherwise(at("a_", n, ".com"))
    out = U.encode_international_hosts(rows, "url")
    site = F.when(n % 3 == 1, at("n", n, ".example.com")).when(n % 3 == 2, "example.com").otherwise("other.example.com")
    return out.select(n, "url", U.valid_domain(name).alias("valid"), U.matches_site(F.col("url"), site).alias("within"))


@query("""with o as (select o_orderkey, cast(floor(o_totalprice) as bigint) as cap, o_custkey % 4 * 1000000 as trigger, case when o_orderkey % 5 = 0 then 999 else 20000 end as amount from orders)
select o_orderkey, trigger between 0 and 10000000 and amount between 1000 and 490000 and cap >= amount and cap <= 490000 as valid, rows from o left join
  (select o_custkey, count(*) as rows from orders group by o_custkey having count(*) > 1) k on k.o_custkey = o.o_orderkey""")
def funding_rules(spark, folder):
    """Settings of automatic funding, and customers whose key would break a unique constraint."""
    o = table(spark, folder, "orders")
    settings = B.valid_auto_funding((F.col("o_custkey") % 4 * 1_000_000), F.when(F.col("o_orderkey") % 5 == 0, 999).otherwise(20_000), F.floor("o_totalprice").cast("long"))
    repeated = quality.unique_violations(o, ["o_custkey"]).withColumnRenamed("o_custkey", "o_orderkey")
    return joins.enrich(o.select("o_orderkey", settings.alias("valid")), repeated, ["o_orderkey"])


@query("""with s as (select l_partkey as part, l_suppkey as seller, case when l_linenumber % 3 > 0 then l_extendedprice / l_quantity end as price, l_orderkey, l_linenumber from lineitem),
c as (select * from s where price is not null qualify row_number() over (partition by part order by price, l_orderkey, l_linenumber) = 1)
select part, seller, price, case when part % 2 = 0 then 'Teil ' || part end as name, case when part % 3 = 0 then 'Apotheke' when part % 3 = 1 then 'pharmacy' else 'museum' end as category from c""")
def localized_offers(spark, folder):
    """The cheapest offer per part with its localized name, null where there is none, and localized category."""
    part = F.col("part")
    offers = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("seller"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber")
    names = table(spark, folder, "part").filter(F.col("p_partkey") % 2 == 0).select(F.col("p_partkey").alias("part"), at("Teil ", F.col("p_partkey")).alias("name"))
    best = market.with_localized_names(market.cheapest_offers(offers, "part", "price", ["l_orderkey", "l_linenumber"]), names, "part")
    asked = F.when(part % 3 == 2, "museum").otherwise("pharmacy")
    return best.select(part, "seller", "price", "name", places.localized_category(asked, F.when(part % 3 == 0, "DE").otherwise("US")).alias("category"))


@query("""with u as (select c_custkey as target, 0 as source_rank from customer union all select o_custkey + 7, 1 from orders)
select target, min(source_rank) as first_source, count(*) as n, dense_rank() over (order by target) <= 50 as chosen from u group by target""")
def ranked_targets(spark, folder):
    """An ordered union of two sources and its first fifty distinct targets."""
    first = table(spark, folder, "customer").select(F.col("c_custkey").alias("target"))
    second = table(spark, folder, "orders").select((F.col("o_custkey") + 7).alias("target"))
    ranked = joins.union_ranked([first, second]).groupBy("target").agg(F.min("source_rank").cast("int").alias("first_source"), F.count(F.lit(1)).alias("n"))
    chosen = reports.distinct_targets([first, second], "target", 50).withColumn("chosen", F.lit(True))
    return joins.enrich(ranked, chosen, ["target"], {"chosen": F.lit(False)})


@query("""with l as (select c_custkey, case when c_custkey % 10 = 0 then '# note' when c_custkey % 10 = 1 then '' else 'https://p' || c_custkey || '.site' || c_custkey // 3 || '.com/a' end as line from customer)
select 'https://p' || min(c_custkey) || '.site' || c_custkey // 3 || '.com/a' as url, 'site' || c_custkey // 3 || '.com' as site from l where line like 'https%' group by c_custkey // 3""")
def url_list(spark, folder):
    """A text file of addresses, the first of each site, in the order of its lines however the file is cut."""
    n = F.col("c_custkey")
    line = F.when(n % 10 == 0, "# note").when(n % 10 == 1, "").otherwise(at("  https://p", n, ".site", F.expr("c_custkey div 3"), ".com/a "))
    path = work_dir(spark, "url-list")
    table(spark, folder, "customer").repartitionByRange(3, n).sortWithinPartitions(n).select(line.alias("value")).write.text(path)
    return readers.read_url_list(spark, path)


@query("""with d as (select doc_id, lang, n_chars from documents)
select doc_id, case when doc_id % 4 = 0 then null else lang end as lang, case when doc_id % 4 = 0 or doc_id % 4 = 1 then null else n_chars end as n_chars, case when doc_id % 4 < 2 then 'upstream_error' end as error_code from d""")
def json_payloads(spark, folder):
    """Typed JSON payloads; malformed and wrongly shaped ones are error rows."""
    d, n = table(spark, folder, "documents"), F.col("doc_id")
    good = F.to_json(F.struct("lang", "n_chars"))
    body = F.when(n % 4 == 0, F.concat(F.lit("{"), good)).when(n % 4 == 1, F.to_json(F.struct("lang", F.struct("lang").alias("n_chars")))).otherwise(good)
    out = readers.read_json_payloads(d.select(n, body.alias("body")), "lang string, n_chars long")
    return out.select("doc_id", "data.lang", "data.n_chars", "error_code")


@query("""select 'written' as kind, doc_id as id, 'Doc ' || doc_id as text from documents
union all select 'billing', o_orderkey, cast(o_custkey as varchar) from orders union all select 'report', count(*), 'latest' from documents""")
def written_tables(spark, folder):
    """Entities, a report and a billing table, written and read back."""
    path = work_dir(spark, "written")
    d = table(spark, folder, "documents")
    entities = d.select("doc_id", at("Doc ", F.col("doc_id")).alias("title"), "lang", F.lit("linkedom").alias("method"))
    sinks.write_entities(entities, f"{path}/entities", partitions=["lang"])
    back = spark.read.schema("doc_id long, title string, schemaVersion long").json(f"{path}/entities").filter("schemaVersion = 1")
    sinks.write_report(d.agg(F.count(F.lit(1)).alias("n")), f"{path}/report", "2026-01-01")
    report = spark.read.schema("n long").json(f"{path}/report/latest/json")
    orders = table(spark, folder, "orders")
    for name in readers.S.BILLING_TABLES:
        schema = readers.S.BILLING_TABLES[name]
        rows = orders.select(*[F.col("o_orderkey").cast("string").alias("id") if f.name == "id" else F.col("o_custkey").cast("string").alias("user_id") if f.name == "user_id" else
                               F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        (rows if name == "billing_ledger" else rows.limit(0)).write.parquet(f"{path}/billing/{name}")
    ledger = readers.read_billing(spark, f"{path}/billing")["billing_ledger"]
    return back.select(F.lit("written").alias("kind"), F.col("doc_id").alias("id"), F.col("title").alias("text")).unionByName(
        ledger.select(F.lit("billing").alias("kind"), F.col("id").cast("long").alias("id"), F.col("user_id").alias("text"))).unionByName(
        report.select(F.lit("report").alias("kind"), F.col("n").alias("id"), F.lit("latest").alias("text")))


@query("""with e as (select event_id, user_id, cast(event_id as varchar) as n from events),
k as (select event_id, case event_id % 9 when 0 then '/api/extract?url=' || url_encode('https://a.example.com/' || n) || '&format=json&focus=prices#extract-1'
  when 1 then '/api/search?q=' || 'tea+' || n || '&format=json&limit=10&language=de-DE&country=US&site=example.com#search-1'
  when 2 then '/api/news?q=tea+' || n || '&format=json&limit=10&language=en-US&country=US&timeframe=7d#news-1'
  when 3 then '/api/images?q=tea+' || n || '&format=json&limit=10&usage=all&orientation=any#images-1'
  when 4 then '/api/videos?q=tea+' || n || '&format=json&limit=10&language=en-US&country=US&platform=any&sort=date&creator=#videos-1'
  when 5 then '/api/places?q=tea+' || n || '&format=json&limit=5&language=en&lat=52.5&lon=13&type=any#places-1'
  when 6 then '/api/finance?symbol=T' || n || '&format=json&timeframe=1mo#finance-1' when 7 then '/api/finance/search?q=tea+' || n || '&format=json&limit=10&instrument=equity#finance-search-1'
  else '/api/finance/movers?format=json&limit=10&list=losers#finance-movers-1' end as text from e)
select event_id, replace(text, '%20', '+') as text, sha256(replace(text, '%20', '+')) as key from k""")
def cache_keys_all(spark, folder):
    """P25: canonical keys of all nine endpoints and their two other names, with defaults filled and unknown controls dropped."""
    n, k = F.col("event_id"), F.col("event_id") % 9
    given = lambda **values: F.map_concat(F.create_map(F.lit("utm"), F.lit("x")), *[F.create_map(F.lit(a), b if not isinstance(b, str) else F.lit(b)) for a, b in values.items()])
    tea = at("  tea   ", n, " ")
    asked = [
        ("/mcp-cache", given(url=at(" https://a.example.com/", n), focus=" prices ")), ("/api/search", given(q=tea, language="de-de", site="Example.COM.")),
        ("/api/news", given(q=tea, timeframe="7d", format="")), ("/api/images", given(q=tea, usage="")), ("/api/videos", given(q=tea, sort="date", creator="")),
        ("/api/maps", given(q=tea, lat="52.50", lon="13.0")), ("/api/finance", given(symbol=at("t", n))), ("/api/finance/search", given(q=tea)), ("/api/finance/movers", given(list="losers"))]
    endpoint, params = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for i, (name, values) in enumerate(asked):
        endpoint, params = F.when(k == i, name).otherwise(endpoint), F.when(k == i, values).otherwise(params)
    rows = table(spark, folder, "events").select(n, cachelog.cache_key(endpoint, params).alias("text"))
    return rows.withColumn("key", cachelog.key_digest(F.col("text")))
