import random

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.search import rank_results, relevance_join
from factloom.plans import api


def test_relevance_equals_brute_force_with_a_hot_word(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=6) + (["hot"] if i % 3 else []))) for i in range(300)]
    asked = [(q, " ".join(rng.sample(words, rng.randint(1, 5)) + (["hot"] if q % 2 else []))) for q in range(25)] + [(99, "the of"), (100, "unknown words")]
    got = relevance_join(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"), F.col("text"))
    want = set()
    for q, query in asked:
        terms = set(query.split()) - set(T.STOP_WORDS) or set(query.split())
        for d, text in docs:
            n = len(terms & set(text.split()))
            if n >= len(terms) // 2 + 1:
                want.add((q, d, n))
    rows = [(r.query_id, r.doc_id, r.matched) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and want
    best = rank_results(got, 3).collect()
    assert max(r.pos for r in best) <= 3 and all((r.query_id, r.doc_id, r.matched) in want for r in best)


def test_fallback_feed_and_repeats(spark):
    queries = spark.createDataFrame([(1, "red hat"), (2, "blue sea"), (3, "none")], "query_id long, query string")
    corpus = lambda rows: spark.createDataFrame(rows, "doc_id long, url string, title string, content string")
    first = corpus([(1, "https://a.com/1", "Red hat", "x"), (2, "https://a.com/1", "Red hat again", "x"), (3, "https://b.com/", "other", "x")])
    second = corpus([(4, "https://c.com/", "Red hat", "late"), (5, "https://c.com/sea", "Blue sea", "y"), (6, "https://c.com/sea", "Blue sea", "z")])
    items = api.search_web(queries, [(first, True), (second, False)])
    assert sorted((r.query_id, r.doc_id, r.source_rank, r.pos) for r in items.collect()) == [(1, 1, 0, 1), (2, 5, 1, 1)]
    feeds = {r.query_id: (r.result_count, r.content) for r in api.feeds(items, queries, "Search").collect()}
    assert feeds[2] == (1, "# Search results for blue sea\n\n1. [Blue sea](https://c.com/sea)\n\n   y") and feeds[3] == (0, "# Search results for none")
    only = api.search_web(queries, [(first, True), (second, False)], site=F.lit("c.com"))
    assert sorted((r.query_id, r.doc_id) for r in only.collect()) == [(1, 4), (2, 5)]


def test_host_rules_by_longest_suffix(spark):
    from factloom.operators import hosts

    rules = spark.createDataFrame([("example.com", "exclude"), ("*.good.example.com", "include"), ("b.org", "include"), ("b.org", "exclude"), ("COM", "include")], "domain string, action string")
    urls = ["https://example.com/a", "https://x.example.com/", "https://a.good.example.com/x", "https://notexample.com/", "https://c.b.org/", "https://b.net", None, "no address"]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "i long, url string, domain string")
    got = {r.i: (r.rule, r.action) for r in hosts.with_host_rules(df, rules).collect()}
    assert got == {0: ("example.com", "exclude"), 1: ("example.com", "exclude"), 2: ("good.example.com", "include"), 3: ("com", "include"), 4: ("b.org", "exclude"), 5: (None, "include"),
                   6: (None, "include"), 7: (None, "include")}
    assert sorted(r.i for r in hosts.allowed(df, rules).collect()) == [2, 3, 5, 6, 7] and hosts.allowed(df, rules).columns == df.columns


def test_conversion_of_listing_units(spark):
    from factloom.operators import market as M

    day = lambda n: f"2024-01-{n:02d}"
    points = spark.createDataFrame([("EUR", day(5), 1.123456789), ("USD", day(1), 2.0), ("USD", day(9), 2.0), ("JPY", day(9), 100.0), ("GBp", day(9), 5.0), ("CHF", day(9), 5.0), (None, day(9), 1.0)],
                                   "currency string, d string, price double").withColumn("ts", F.to_timestamp("d"))
    rates = spark.createDataFrame([("USDEUR", day(3), 0.9), ("USDEUR", day(8), 0.8), ("EURUSD", day(8), 7.0), ("EURJPY", day(1), 160.0), ("CHFEUR", day(1), 0.0)], "pair string, d string, close double").withColumn("ts", F.to_timestamp("d"))
    out = {(r.currency, r.d): (r.price, r.rate, r.error_code) for r in M.convert_listed(points, rates, "EUR", ["price"]).collect()}
    assert out == {("EUR", day(5)): (1.123456789, 1.0, None), ("USD", day(1)): (1.8, 0.9, None), ("USD", day(9)): (1.6, 0.8, None), ("JPY", day(9)): (0.625, 0.00625, None),
                   ("GBp", day(9)): (None, None, "upstream_error"), ("CHF", day(9)): (None, None, "upstream_error"), (None, day(9)): (None, None, "upstream_error")}
