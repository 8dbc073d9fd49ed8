"""A sample of the named jobs against their SQL; tools/check.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = """url_dedupe_keep_first site_digest doc_search_topk feed_assembly fx_asof_convert market_snapshot movers_by_brand cheapest_offer funding_epochs
quota_with_refunds rate_limit_trailing failure_streaks reversal_state cache_hit_miss composite_score stratified_sample payload_rss payload_charts product_list_pages search_feeds
usage_alerts running_balance reversal_ledger smoke_report host_rules fx_listed_convert client_pseudonyms text_details international_hosts localized_offers ranked_targets url_list written_tables
cache_keys_all page_gates stream_cache stream_auto_funding stream_versions""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_job_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    res = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda row, names: tuple(repr(row[names.index(c)]) for c in sorted(names))
    want = sorted(key(r, columns) for r in res.fetchall())
    got = sorted(key(tuple(r), df.columns) for r in df.collect())
    assert got == want and got


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_grow_by_repeats(spark):
    """Applying a keep-first job to its own input twice gives the same rows."""
    from factloom.operators.ordered import keep_first

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    once = keep_first(pages, ["url"], ["page_id"])
    twice = keep_first(pages.unionByName(pages), ["url"], ["page_id"])
    assert once.exceptAll(twice).count() == 0 and once.count() == twice.count()


def test_scans_read_only_needed_columns(spark):
    plan = entry.queries()["movers_active"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "CartesianProduct" not in plan
