from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.operators import billing as B
from factloom.operators import cachelog, joins, reports

T0 = datetime(2026, 8, 1, 12)


def metering(spark, rows):
    """(account, kind, credits) in order, one second apart."""
    return spark.createDataFrame([(a, i, T0 + timedelta(seconds=i), k, c) for i, (a, k, c) in enumerate(rows)], "account string, seq long, ts timestamp, kind string, credits long")


def test_each_threshold_alerts_once(spark):
    rows = [("a", "grant", 10)] + [("a", "commit", -1)] * 10 + [("b", "grant", 1), ("b", "commit", -1), ("b", "commit", -1), ("b", "commit", -1), ("a", "grant", 5), ("a", "commit", -1)]
    got = sorted((r.account, r.epoch, r.percent, r.seq) for r in B.usage_alerts(metering(spark, rows), 5).collect())
    assert got == [("a", 1, 80, 8), ("a", 1, 90, 9), ("a", 1, 100, 10), ("b", 1, 80, 12), ("b", 1, 90, 13), ("b", 1, 100, 14)]


def test_balance_may_become_negative(spark):
    rows = [("a", "grant", 2), ("a", "commit", -1), ("a", "commit", -1), ("a", "reverse", -2)]
    assert [r.balance for r in B.running_balance(metering(spark, rows)).orderBy("seq").collect()] == [2, 1, 0, -2]


def test_credit_amounts(spark):
    df = spark.createDataFrame([(10_000,), (1_000,), (2_000,), (999,), (490_001,)], "c long")
    assert [r.x for r in df.select(B.credits_for_amount(F.col("c")).alias("x")).collect()] == [204_081, 20_408, 40_816, None, None]


def steps(spark, rows):
    return spark.createDataFrame([(c, r, k, T0 + timedelta(seconds=s)) for c, r, k, s in rows], "client string, reservation_id string, kind string, ts timestamp")


def test_ten_of_twentyfive_are_admitted(spark):
    rows = [("x", f"r{i:02d}", "reserve", 0) for i in range(25)] + [("x", "r00", "reserve", 1)]
    out = B.daily_admission(steps(spark, rows))
    assert out.count() == 25 and out.filter("admitted").count() == 10


def test_refund_and_expiry_free_a_slot(spark):
    rows = [("x", "a", "reserve", 0), ("x", "b", "reserve", 1), ("x", "a", "refund", 2), ("x", "c", "reserve", 3), ("x", "c", "commit", 4), ("x", "d", "reserve", 5), ("x", "e", "reserve", 1000)]
    got = {r.reservation_id: r.admitted for r in B.daily_admission(steps(spark, rows), 2).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": True}


def test_one_pending_charge_and_a_cap():
    state, cap = {}, 4_000
    run = lambda kind, ref: B.charge(state, kind, ref, 2_000, cap)
    assert [run("reserve", "a"), run("reserve", "b"), run("reserve", "a"), run("commit", "b"), run("commit", "a"), run("commit", "a"), run("reserve", "c"), run("release", "c"),
            run("reserve", "d"), run("commit", "d"), run("reserve", "e")] == [
        "reserved", "charge_pending", "idempotent", "different_charge_pending", "committed", "idempotent", "reserved", "released", "reserved", "committed", "monthly_limit"]


def test_streaks_stop_after_three_or_a_hard_decline(spark):
    rows = [("a", True, "X"), ("a", True, "X"), ("a", False, None), ("a", True, "x"), ("a", True, "x"), ("a", True, "x"), ("b", True, "lost_card")]
    df = spark.createDataFrame([(a, i, T0 + timedelta(days=i), f, c) for i, (a, f, c) in enumerate(rows)], "account string, seq long, ts timestamp, failed boolean, error_code string")
    out = B.failure_streaks(df).orderBy("seq").collect()
    assert [(r.streak, r.status) for r in out] == [(1, "retry_wait"), (2, "retry_wait"), (0, "active"), (1, "retry_wait"), (2, "retry_wait"), (3, "requires_attention"), (1, "requires_attention")]
    assert out[0].next_retry_at == T0 + timedelta(days=3)


def notices(spark, rows):
    return spark.createDataFrame([(p, i, k, T0 + timedelta(seconds=s), 7, c) for i, (p, k, s, c) in enumerate(rows)], "payment_ref string, event_id long, kind string, ts timestamp, account long, credits long")


REVERSALS = [("early", "refund", 1, None), ("early", "grant", 5, 10), ("won", "grant", 1, 10), ("won", "dispute_opened", 2, None), ("won", "dispute_won", 3, None),
             ("late", "grant", 1, 10), ("late", "dispute_won", 9, None), ("late", "dispute_opened", 2, None), ("open", "grant", 1, 10), ("open", "dispute_opened", 2, None),
             ("final", "grant", 1, 10), ("final", "refund", 2, None), ("final", "dispute_won", 3, None), ("lost", "refund", 2, None)]
EXPECTED = {"early": (0, False), "won": (10, False), "late": (10, False), "open": (0, False), "final": (0, False), "lost": (0, True)}


def test_reversals_in_any_order(spark):
    for rows in (REVERSALS, REVERSALS[::-1]):
        assert {r.payment_ref: (r.net_credits, r.pending) for r in B.reversal_state(notices(spark, rows)).collect()} == EXPECTED
    refs = {r.external_ref for r in B.reversal_rows(notices(spark, REVERSALS)).collect()}
    assert refs == {"reversal:refund:early", "reversal:dispute:open", "reversal:refund:final", "reversal:dispute:won", "restore:dispute:won", "reversal:dispute:late", "restore:dispute:late"}
    # A refund during a dispute books nothing more, and none is given back after it.
    rows = [("a", "grant", 1, 10), ("a", "dispute_opened", 2, None), ("a", "refund", 3, None), ("a", "dispute_won", 4, None), ("b", "dispute_opened", 0, None), ("b", "grant", 1, 5)]
    assert [(r.external_ref, r.credits) for r in B.reversal_rows(notices(spark, rows)).orderBy("payment_ref").collect()] == [("reversal:dispute:a", -10), ("reversal:dispute:b", -5)]


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", 1, "x", 5)], "id string, at long, v string, n long")
    new = spark.createDataFrame([("a", 2, None, 3), ("a", 3, "y", 9), ("b", 1, "z", 1)], "id string, at long, v string, n long")
    merge = {"at": "max", "v": "fill", "n": "min"}
    got = {r.id: (r.at, r.v, r.n) for r in joins.upsert(old, new, ["id"], merge, "at").collect()}
    assert got == {"a": (3, "y", 3), "b": (1, "z", 1)}
    first = joins.upsert(old, new, ["id"], {"v": "first", "n": "first", "at": "first"}, "at")
    assert {r.id: r.v for r in first.collect()} == {"a": "x", "b": "z"}


def test_cache_keys_join_equal_requests(spark):
    rows = [("/api/search", {"q": " a  b "}), ("/api/search", {"q": "a b", "limit": "10", "language": "EN-us", "country": "us", "format": "json", "zzz": "1"}),
            ("/api/search", {"q": "a b", "site": ""}), ("/api/search", {"q": "a b", "country": "DE"}), ("/api/maps", {"q": "x", "lat": "52.50", "lon": "13"}), ("/api/places", {"q": "x", "lat": "52.5", "lon": "13.0"})]
    df = spark.createDataFrame([(i, e, p) for i, (e, p) in enumerate(rows)], "i int, e string, p map<string,string>")
    keys = [r.k for r in df.select("i", cachelog.cache_key(F.col("e"), F.col("p")).alias("k")).orderBy("i").collect()]
    assert keys[0] == keys[1] and len({keys[0], keys[2], keys[3]}) == 3 and keys[4] == keys[5]


def test_cache_validity_is_half_open(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    requests = spark.createDataFrame([(i, "k", at(s)) for i, s in enumerate((0, 10, 19, 20))], "id int, key string, ts timestamp")
    results = spark.createDataFrame([("k", at(10), 10, True), ("k", at(5), 1000, False)], "key string, stored_at timestamp, ttl long, ok boolean")
    assert [r.outcome for r in cachelog.cache_lookup(requests, results, 4).orderBy("id").collect()] == ["MISS", "HIT", "HIT", "MISS"]


def test_sample_takes_the_next_unseen_site(spark):
    names = ["a.com", "x.a.com", "b.com", "a.com", "c.com", "-bad.com", "d.com", "b.com"]
    df = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank long, domain string")
    got = reports.stratified_sample(df, 4, ((1, 4, 0.5), (5, 8, 0.5))).orderBy("slot").collect()
    assert [(r["rank"], r.domain) for r in got] == [(2, "x.a.com"), (5, "c.com"), (7, "d.com"), (8, "b.com")]
    assert len({r.site for r in got}) == len(got)


def test_percentile_of_an_empty_report(spark):
    empty = spark.createDataFrame([], "url string, outcome string, duration_ms long")
    row = reports.smoke_report(empty, 1).first()
    assert (row.attempted, row.success_rate, row.attempted_ok, row.passed) == (0, 0.0, False, False)


def test_admission_by_busy_periods_equals_one_fold(spark):
    """Many clients, days that end in the middle of a busy period, all limits."""
    state, rows = 7, []
    for client in range(12):
        at = 0
        for i in range(90):
            state = (state * 1103515245 + 12345) % 2**31
            at += state // 5 % (200 if client % 3 else 2500)
            rid, ts = f"c{client}-{i}", T0 + timedelta(seconds=at)
            rows.append((client if client else None, rid, "reserve", ts))
            kind = state // 11 % 4
            if kind < 2:
                rows.append((client if client else None, rid, ("commit", "refund")[kind], ts + timedelta(seconds=state // 3 % 1200)))
    events = spark.createDataFrame(rows, "client long, reservation_id string, kind string, ts timestamp").repartition(6)
    # The day of a reservation is that of its start.
    events = events.join(events.filter("kind = 'reserve'").select("reservation_id", F.col("ts").alias("_s")), "reservation_id")
    late = F.date_format("ts", "yyyy-MM-dd") > F.date_format("_s", "yyyy-MM-dd")
    events = events.withColumn("ts", F.when(late, F.date_trunc("day", "ts") - F.expr("INTERVAL 1 MICROSECOND")).otherwise(F.col("ts"))).drop("_s")
    intervals = B.reservation_intervals(events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day", "client"]).collect()
    for limit in (1, 2, 5):
        want, live = {}, {}
        for r in sorted(intervals, key=lambda r: (r.start, r.reservation_id)):
            want[r.reservation_id] = B.admit(live.setdefault((r.day, r.client), []), r.start, r.free_at, limit)
        assert {r.reservation_id: r.admitted for r in B.daily_admission(events, limit, 600).collect()} == want
        assert 0 < sum(want.values()) < len(want)
