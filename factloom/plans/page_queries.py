"""Jobs over the page and document tables, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators import discovery, feeds, pages as P, reports, search
from factloom.operators.ordered import keep_first, nearest_rank, summarize
from factloom.operators import hosts
from factloom.operators.joins import with_fallback
from factloom.plans.tables import register_into, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)


SITE_SQL = """case when len(string_split(host, '.')) > 2 and array_to_string(string_split(host, '.')[-2:], '.') in
  ('ac.uk','co.jp','co.kr','co.nz','co.uk','com.ar','com.au','com.br','com.cn','com.mx','com.sg','com.tr','com.tw','com.ua',
   'gov.uk','net.au','ne.jp','org.au','org.uk') then array_to_string(string_split(host, '.')[-3:], '.')
  else array_to_string(string_split(host, '.')[-2:], '.') end"""


def url_key_sql(source: str) -> str:
    return f"""
parts as (select *, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as host,
    rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') as p,
    list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(?i)(utm_[^=]+|fbclid|gclid|dclid|mc_cid|mc_eid)(=|$)'))) as q
  from {source}),
keyed as (select *, host || case when p = '' then '/' else p end
    || case when len(q) = 0 then '' else '?' || array_to_string(q, '&') end as url_key from parts)"""


@query(f"with {url_key_sql('pages')} select page_id, url_key, {SITE_SQL} as site from keyed")
def url_canonical_keys(spark, folder):
    """Canonical key and site of every page."""
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", U.canonical_url_key(url).alias("url_key"), U.site_key(U.host(url)).alias("site"))


@query(f"""with copies as (select page_id, url, 0 as copy from pages union all
    select page_id, replace(replace(url, 'http://', 'https://'), '#top', '') || case when contains(url, '?') then '&' else '?' end || 'utm_medium=x', 1 from pages),
{url_key_sql("copies")}
select url_key, min(page_id) as page_id, arg_min(url, page_id * 2 + copy) as url, count(*) as copies from keyed group by url_key""")
def url_dedupe_keep_first(spark, folder):
    """The pages and a re-tagged copy of each; the first of every canonical key stays."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    url = F.col("url")
    tagged = F.concat(
        F.regexp_replace(F.regexp_replace(url, "^http://", "https://"), "#top", ""),
        F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_medium=x"))
    both = pages.withColumn("copy", F.lit(0)).unionByName(pages.withColumn("url", tagged).withColumn("copy", F.lit(1)))
    keyed = both.withColumn("url_key", U.canonical_url_key(url)).withColumn("pos", F.col("page_id") * 2 + F.col("copy"))
    first = keep_first(keyed, ["url_key"], ["pos"])
    counts = keyed.groupBy("url_key").agg(F.count(F.lit(1)).alias("copies"))
    return first.join(counts, "url_key").select("url_key", "page_id", "url", "copies")


# Each page address is also tried in spellings that the target rules reject.
URL_SPELLINGS = (
    ("plain", r"^(https?)://([^/?#]+)", "$1://$2", "\\1://\\2", None),
    ("credentials", r"^(https?)://([^/?#]+)", "$1://user:secret@$2", "\\1://user:secret@\\2", "unsafe_url"),
    ("port", r"^(https?)://([^/?#]+)", "$1://$2:8443", "\\1://\\2:8443", "unsafe_url"),
    ("scheme", r"^(https?)://([^/?#]+)", "ftp://$2", "ftp://\\2", "unsafe_url"),
    ("label", r"^(https?)://([^/?#]+)", "$1://bad_$2", "\\1://bad_\\2", "invalid_url"),
    ("address", r"^(https?)://([^/?#]+)", "$1://0x7f.1", "\\1://0x7f.1", "unsafe_url"),
    ("private", r"^(https?)://([^/?#]+)", "$1://printer.local", "\\1://printer.local", "unsafe_url"),
    ("bare", r"^(https?)://", "", "", "invalid_url"),
)


@query(" union all ".join(
    f"""select page_id, '{name}' as spelling, {f"'{code}'" if code else "cast(null as varchar)"} as error_code,
      {"regexp_replace(case when regexp_matches(url, '^https?://[^/?#]+$') then url || '/' else url end, '#.*$', '')" if not code else "cast(null as varchar)"} as target,
      regexp_matches(url, '^https?://(blog|news|press)\\.[^/?#]*/?([?#]|$)') as blog_listing
    from pages""" for name, _, _, _, code in URL_SPELLINGS))
def url_validation_codes(spark, folder):
    """Target rules over every page address and its rejected spellings."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    spelled = F.array(*[
        F.struct(F.lit(n).alias("spelling"), F.regexp_replace("url", p, r).alias("candidate")) for n, p, r, _, _ in URL_SPELLINGS])
    rows = pages.select("page_id", "url", F.explode(spelled).alias("s")).select("page_id", "url", "s.*")
    checked = U.validate_url(F.col("candidate"))
    return rows.select(
        "page_id", "spelling", checked["error_code"].alias("error_code"), checked["url"].alias("target"),
        U.is_blog_listing(F.col("url")).alias("blog_listing"))


@query(f"""with {url_key_sql('pages')}
select {SITE_SQL} as site, host, count(*) as pages, count(distinct url_key) as distinct_pages,
  cast(count_if(starts_with(url, 'https:')) as bigint) as secure, cast(count_if(len(q) > 0) as bigint) as with_query from keyed group by all""")
def site_summary(spark, folder):
    """Pages and distinct pages per site and host."""
    url = F.col("url")
    keyed = table(spark, folder, "pages").select(
        U.host(url).alias("host"), U.canonical_url_key(url).alias("url_key"), (U.scheme(url) == "https").alias("secure"))
    return keyed.groupBy(U.site_key(F.col("host")).alias("site"), "host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_distinct("url_key").alias("distinct_pages"),
        F.count_if("secure").alias("secure"), F.count_if(F.col("url_key").contains("?")).alias("with_query"))


DECODE_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)&nbsp;|&#160;', ' ', 'g'),
  '(?i)&lt;|&#60;', '<', 'g'), '(?i)&gt;|&#62;', '>', 'g'), '(?i)&quot;|&#34;', '"', 'g'), '(?i)&amp;|&#38;', '&', 'g')"""


def collapsed_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


@query(f"""select page_id, nullif(left({collapsed_sql(DECODE_SQL.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))}, 500), '') as title,
  nullif(regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1), '') as language from pages""")
def page_title_lang(spark, folder):
    """H1, F1: title and language of every page."""
    return table(spark, folder, "pages").select(
        "page_id", T.blank_to_null(F.substring(H.page_title(F.col("html")), 1, 500)).alias("title"), H.page_language(F.col("html")).alias("language"))


NOISE_SQL = r"(?i)\b(?:accept all cookies|advertisement|all rights reserved|cookie settings|log in|navigation|privacy policy|sign in|subscribe|terms of (?:service|use))\b"
WORDS_SQL = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"


def noise_sql(text: str) -> str:
    return (f"floor(cast(len(regexp_extract_all({text}, '{NOISE_SQL}')) as double) / "
            f"greatest(len(regexp_extract_all({text}, '[^\\s\\x{{A0}}]+')), 1) * 1000 * 100 + 0.5) / 100")


@query(f"""with t as (select page_id, {collapsed_sql(DECODE_SQL.format("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')"))} as body from pages)
select page_id, length(body) as chars, cast(len(regexp_extract_all(body, '{WORDS_SQL}')) as bigint) as words, {noise_sql('body')} as noise,
  length(body) >= 80 as useful from t""")
def page_text_word_counts(spark, folder):
    """H5 (text form), F8, H16: article text, its words and noise."""
    body = table(spark, folder, "pages").select("page_id", H.article_text(F.col("html")).alias("body"))
    return body.select(
        "page_id", F.char_length("body").cast("long").alias("chars"), T.word_count(F.col("body")).alias("words"),
        T.noise_per_thousand(F.col("body")).alias("noise"), (F.char_length("body") >= 80).alias("useful"))


CHALLENGE_HTML = "<title>Just a moment...</title></head><body><div id=\"challenge-form\"></div>"


@query(f"""with variants as (select page_id, 0 as variant, html from pages union all
  select page_id, 1, '<html><head>{CHALLENGE_HTML}' || left(html, 0) || '<p>' || url || '</p></body></html>' from pages union all
  select page_id, 2, '<html><head><title>About</title><script src="/app.js"></script></head><body><div id="root"></div>' || html from pages)
select page_id, variant, variant = 1 as interstitial,
  regexp_matches(html, '(?i)<script\\b') and regexp_matches(html, '(?i)(?:<script\\b[^>]*\\bsrc\\s*=|\\bid\\s*=\\s*["''](?:app|root|__next|__nuxt)["'']|\\bdata-(?:reactroot|server-rendered)\\b|<[^>]+-[^>]+>)') as needs_render,
  octet_length(encode(html)) > 5242880 as too_large from variants""")
def page_gates(spark, folder):
    """Every page as it is, behind a challenge and as a client application."""
    pages = table(spark, folder, "pages")
    blocked = F.concat(F.lit(f"<html><head>{CHALLENGE_HTML}<p>"), F.col("url"), F.lit("</p></body></html>"))
    app = F.concat(F.lit('<html><head><title>About</title><script src="/app.js"></script></head><body><div id="root"></div>'), F.col("html"))
    rows = pages.select("page_id", F.posexplode(F.array("html", blocked, app)).alias("variant", "html"))
    return rows.select(
        "page_id", F.col("variant").cast("int").alias("variant"), H.is_interstitial(F.col("html")).alias("interstitial"),
        H.needs_render(F.col("html")).alias("needs_render"), P.size_gate(F.col("html")).isNotNull().alias("too_large"))


AS_OF = "2026-01-01 00:00:00"


@query()
def page_extract_cascade(spark, folder):
    """The outcome of every page."""
    out = P.extract_pages(table(spark, folder, "pages"), F.lit(AS_OF).cast("timestamp"))
    return out.select("page_id", "source", "type", "method", "title", "language", "word_count", "error_code",
                      F.char_length("content").cast("long").alias("content_chars"), F.size("media").cast("long").alias("n_media"))


@query()
def page_markdown(spark, folder):
    """H1, H3-H5: Markdown, metadata and preview of every page."""
    out = P.extract_content(table(spark, folder, "pages"), F.lit(AS_OF).cast("timestamp"))
    return out.select("page_id", "title", "author", "published_at", "description", "language", "modified_at", "content", "metadata_only", "media", "word_count", "error_code")


@query(r"""with t as (select page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) as origin, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as host from pages)
select page_id, case when regexp_matches(host, '^(blog|news|press)\.') then origin || '/feed ' || origin || '/rss.xml ' || origin || '/feed.xml ' || origin || '/atom.xml' else '' end as guesses from t""")
def feed_guesses(spark, folder):
    """Addresses where the publisher of a page may keep its feed."""
    return table(spark, folder, "pages").select("page_id", F.array_join(discovery.inferred_feeds(F.col("url")), " ").alias("guesses"))


@query(r"""select page_id, position, kind, href from (
  select page_id, url, 0 as position, 'wordpress' as kind, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/wp-json/wp/v2/posts/' || page_id as href from pages union all
  select page_id, url, 1, 'oembed', 'https://embeds.example.org/o?id=' || page_id from pages union all
  select page_id, url, 2, 'feed', regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/feed' from pages)""")
def page_alternates(spark, folder):
    """First advertised link of each kind; the pages are given links in their head and header."""
    pages = table(spark, folder, "pages")
    head = F.concat(
        F.lit('<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" type="text/html" href="/print">'),
        F.lit('<link rel="alternate" type="application/json" href="/wp-json/wp/v2/posts/'), F.col("page_id").cast("string"), F.lit('">'), F.col("html"))
    header = F.concat(F.lit('<https://embeds.example.org/o?id='), F.col("page_id").cast("string"),
                      F.lit('>; rel="alternate"; type="application/json+oembed", </late>; rel="next"'))
    out = discovery.alternate_links(pages.withColumn("html", head).withColumn("link_header", header))
    return out.select("page_id", F.col("position").cast("int").alias("position"), "kind", "href")


@query(f"""with {url_key_sql('(select page_id, url from pages)')},
items as (select url_key, min(page_id) as position, 'Entry ' || min(page_id) as title from keyed group by url_key)
select k.page_id, i.position, i.title from keyed k join items i using (url_key)""")
def feed_item_match(spark, folder):
    """Pages matched with feed items that carry tracking parameters on the same address."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    tagged = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=feed"))
    fixed = F.when(F.col("url").contains("#"), F.col("url")).otherwise(tagged)
    items = pages.select(fixed.alias("url"), F.col("page_id").alias("position"), F.concat(F.lit("Entry "), F.col("page_id")).alias("title"))
    return discovery.match_feed_items(pages, items).select("page_id", "position", "title")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def terms_sql(query_text: str) -> str:
    words = f"regexp_extract_all(lower({query_text}), '[\\p{{L}}\\p{{N}}]+')"
    kept = f"list_filter({words}, lambda w: not list_contains({STOP_SQL}, w))"
    return f"list_distinct(case when len({kept}) > 0 then {kept} else {words} end)"


def search_sql(docs: str = "documents", columns: str = "") -> str:
    return f"""
asked as (select item_id as query_id, {terms_sql("text")} as terms from benchmark),
words as (select doc_id {columns}, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as tokens from {docs}),
pairs as (select query_id, doc_id {columns}, len(list_intersect(terms, tokens)) as matched, len(terms) as n from asked, words),
hits as (select * from pairs where n > 0 and matched >= n // 2 + 1)"""


def search_queries(spark, folder):
    """Every benchmark item, its whole text, as a search."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"""with {search_sql()}
select query_id, doc_id, cast(matched as bigint) as matched, pos from
 (select *, row_number() over (partition by query_id order by matched desc, doc_id) as pos from hits) where pos <= 10""")
def doc_search_topk(spark, folder):
    """Relevant documents per query, ten best."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    matches = search.relevance_join(search_queries(spark, folder), docs, F.col("text")).drop("text")
    return search.rank_results(matches).select("query_id", "doc_id", "matched", "pos")


@query(f"""with {search_sql(columns=", lang")},
first as (select *, 0 as source_rank from hits where lang <> 'en'),
second as (select *, 1 as source_rank from hits where lang = 'en' and query_id not in (select query_id from first))
select query_id, doc_id, cast(matched as bigint) as matched, cast(source_rank as bigint) as source_rank, pos from
 (select *, row_number() over (partition by query_id order by matched desc, doc_id) as pos from (select * from first union all select * from second)) where pos <= 5""")
def doc_search_fallback(spark, folder):
    """The English corpus serves only queries that the others leave unanswered."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    matches = search.relevance_join(search_queries(spark, folder), docs, F.col("text")).select("query_id", "doc_id", "matched", "lang")
    answered = with_fallback([matches.filter(F.col("lang") != "en"), matches.filter(F.col("lang") == "en")], "query_id")
    return search.rank_results(answered, 5).select("query_id", "doc_id", "matched", "source_rank", "pos")


@query(f"""select item_id as query_id, {collapsed_sql('text')} as query_text, length({collapsed_sql('text')}) > 200 as too_long,
  array_to_string(list_sort({terms_sql("text")}), ' ') as terms from benchmark""")
def query_normalization(spark, folder):
    """Collapsed queries, their length rule and meaningful terms."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), T.collapse(F.col("text")).alias("query_text"),
        (T.normalize_query(F.col("text"))["error_code"].isNotNull()).alias("too_long"),
        F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query(f"""select source, lang, count(*) as documents, floor(avg({noise_sql('text')}) * 10000 + 0.5) / 10000 as noise,
  cast(sum(len(regexp_extract_all(text, '{WORDS_SQL}'))) as bigint) as words, floor(avg(case when n_chars >= 80 then 1.0 else 0.0 end) * 10000 + 0.5) / 10000 as useful_rate
  from documents group by all""")
def doc_noise_report(spark, folder):
    """Noise, words and useful share per source and language."""
    docs = table(spark, folder, "documents")
    noise = F.avg(T.noise_per_thousand(F.col("text")))
    return docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("documents"), (F.floor(noise * 10000 + 0.5) / 10000).alias("noise"),
        F.sum(T.word_count(F.col("text"))).alias("words"),
        (F.floor(F.avg(F.when(F.col("n_chars") >= 80, 1.0).otherwise(0.0)) * 10000 + 0.5) / 10000).alias("useful_rate"))


@query("""with e as (select conv_id, turn, role, trim(regexp_replace(text, '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g')) as body from conversations)
select conv_id, count(*) as result_count, string_agg('## ' || role || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as content
from e where turn < 50 group by conv_id""")
def feed_assembly(spark, folder):
    """The turns of a conversation as one feed."""
    turns = table(spark, folder, "conversations")
    content = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), T.escape_markdown(F.col("text")))
    return feeds.assemble_feed(turns, ["conv_id"], "turn", content).drop("published_at")


@query("""with t as (select n_chars as v, source from documents), s as (select source, v, row_number() over (partition by source order by v) - 1 as i, count(*) over (partition by source) as n from t)
select source, max(n) as n, max(case when i = least(n - 1, cast(floor(n * 0.5) as bigint)) then v end) as p50, max(case when i = least(n - 1, cast(floor(n * 0.95) as bigint)) then v end) as p95,
  max(v) as maximum from s group by source""")
def doc_length_percentiles(spark, folder):
    """Nearest-rank percentiles of document length per source."""
    docs = table(spark, folder, "documents").select("source", "n_chars")
    return nearest_rank(docs, ["source"], "n_chars", {"p50": 0.5, "p95": 0.95, "maximum": 1.0})


def site_digest(spark, folder):
    """Flagship: pages, distinct addresses, words and median words per host, from scan to report."""
    url = F.col("url")
    read = table(spark, folder, "pages").select(
        U.host(url).alias("host"), U.canonical_url_key(url).alias("url_key"), T.word_count(H.article_text(F.col("html"))).alias("words"))
    return summarize(read, ["host"], {"words": (F.col("words"), {"median_words": 0.5})}, {"_words": F.col("words").cast("long")}, {"distinct_pages": F.col("url_key")}).select(
        "host", F.col("rows").alias("pages"), "distinct_pages", F.col("_words").alias("words"), F.col("median_words").cast("long").alias("median_words"))


QUERIES["site_digest"] = site_digest
ORACLES["site_digest"] = f"""with {url_key_sql('pages')},
t as (select host, url_key, len(regexp_extract_all({collapsed_sql(DECODE_SQL.format("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')"))}, '{WORDS_SQL}')) as w from keyed),
s as (select *, row_number() over (partition by host order by w) - 1 as i, count(*) over (partition by host) as n from t)
select host, count(*) as pages, count(distinct url_key) as distinct_pages, cast(sum(w) as bigint) as words,
  cast(max(case when i = least(n - 1, cast(floor(n * 0.5) as bigint)) then w end) as bigint) as median_words from s group by host"""


@query("""with r as (select 's' || n_nationkey || '.example' || n_nationkey % 3 || '.com' as domain, case when n_nationkey % 2 = 1 then 'exclude' else 'include' end as action from nation
  union all select 'n' || n_nationkey % 7 || '.s' || n_nationkey || '.example' || n_nationkey % 3 || '.com', 'include' from nation where n_nationkey % 4 = 1
  union all select 'example' || r_regionkey || '.com', case when r_regionkey = 1 then 'exclude' else 'include' end from region),
e as (select event_id, 'n' || event_id % 7 || '.s' || user_id % 40 || '.example' || user_id % 40 % 5 || '.' || case when event_id % 11 = 0 then 'net' else 'com' end as host from events)
select event_id, arg_max(domain, length(domain)) as rule, coalesce(arg_max(action, length(domain)), 'include') as action from e left join r on host = domain or ends_with(host, '.' || domain) group by event_id""")
def host_rules(spark, folder):
    """Include and exclude rules on hosts and whole domains; the longest suffix decides."""
    k = F.col("n_nationkey")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rules = nation.select(at("s", k, ".Example", k % 3, ".com").alias("domain"), F.when(k % 2 == 1, "exclude").otherwise("include").alias("action")).unionByName(
        nation.filter(k % 4 == 1).select(at("n", k % 7, ".s", k, ".example", k % 3, ".com").alias("domain"), F.lit("include").alias("action"))).unionByName(
        region.select(at("*.example", F.col("r_regionkey"), ".com").alias("domain"), F.when(F.col("r_regionkey") == 1, "exclude").otherwise("include").alias("action")))
    n, s = F.col("event_id"), F.col("user_id") % 40
    rows = table(spark, folder, "events").select(n, at("https://n", n % 7, ".s", s, ".example", s % 5, ".", F.when(n % 11 == 0, "net").otherwise("com"), "/", n).alias("url"))
    return hosts.with_host_rules(rows, rules).drop("url")
