from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.operators import billing as B
from factloom.sources.readers import read_events_stream
from factloom.streaming import events as E
from factloom.streaming import state as K

from test_billing import EXPECTED, REVERSALS, T0, metering, notices


def as_stream(spark, tmp_path, batches):
    """Each DataFrame becomes one file and one micro-batch."""
    folder = str(tmp_path / "in")
    for df in batches:
        df.coalesce(1).write.mode("append").parquet(folder)
    return read_events_stream(spark, folder, batches[0].schema, files=1)


def test_alerts_equal_the_batch_job(spark, tmp_path):
    rows = [("a", "grant", 10)] + [("a", "commit", -1)] * 9 + [("a", "refund", 1), ("b", "grant", 4), ("b", "commit", -1)] + [("a", "commit", -1)] * 2 + [("a", "grant", 3)] + [("a", "commit", -1)] * 20
    events = metering(spark, rows)
    parts = [events.filter((F.col("seq") >= i) & (F.col("seq") < i + 9)) for i in range(0, len(rows), 9)]
    out = E.run_available(spark, K.usage_alerts(as_stream(spark, tmp_path, parts), events.schema["account"].dataType), "alerts-test")
    key = lambda df: sorted((r.account, r.epoch, r.percent, r.seq) for r in df.collect())
    assert key(out) == key(B.usage_alerts(events)) and out.count() > 4


def test_reversals_do_not_depend_on_arrival(spark, tmp_path):
    for name, rows in (("a", REVERSALS), ("b", REVERSALS[::-1])):
        events = notices(spark, rows)
        parts = [events.filter(F.col("event_id") % 3 == i) for i in (2, 0, 1)]
        out = E.run_available(spark, K.payment_reversals(as_stream(spark, tmp_path / name, parts)), "reversals-test")
        last = out.groupBy("payment_ref").agg(F.max_by(F.struct("net_credits", "pending"), "version").alias("s"))
        assert {r.payment_ref: (r.s.net_credits, r.s.pending) for r in last.collect()} == EXPECTED


def reservation_events(spark, rows):
    return spark.createDataFrame([("a", i, T0 + timedelta(seconds=s), k, r, c) for i, (s, k, r, c) in enumerate(rows)], "account string, seq long, ts timestamp, kind string, reservation_id string, credits long")


def test_reservations(spark, tmp_path):
    rows = [(0, "grant", "g1", 1), (1, "grant", "g1", 1), (2, "reserve", "a", 0), (3, "reserve", "b", 0), (4, "refund", "a", 0), (5, "refund", "a", 0), (6, "reserve", "c", 0), (7, "commit", "c", 0), (8, "commit", "c", 0),
            (9, "commit", "zz", 0), (10, "grant", "g2", 1), (11, "reserve", "d", 0), (2000, "reserve", "e", 0)]
    events = reservation_events(spark, rows)
    out = E.run_available(spark, K.reservations(as_stream(spark, tmp_path, [events]), events.schema["account"].dataType), "reservations-test").collect()
    got = [(r.kind, r.reservation_id, r.outcome, r.balance) for r in out]
    assert got[:13] == [
        ("grant", "g1", "grant", 1), ("grant", "g1", "idempotent", 1), ("reserve", "a", "reserved", 0), ("reserve", "b", "insufficient_credits", 0), ("refund", "a", "refunded", 1),
        ("refund", "a", "idempotent", 1), ("reserve", "c", "reserved", 0), ("commit", "c", "committed", 0), ("commit", "c", "idempotent", 0), ("commit", "zz", "unknown_reservation", 0),
        ("grant", "g2", "grant", 1), ("reserve", "d", "reserved", 0), ("expire", "d", "stale_refunded", 1)]
    assert got[13] == ("reserve", "e", "reserved", 0)


def test_idle_accounts_expire_by_timer(spark, tmp_path):
    first = reservation_events(spark, [(0, "grant", "g", 1), (1, "reserve", "a", 0)])
    other = first.limit(1).withColumn("account", F.lit("z")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    out = E.run_available(spark, K.reservations(as_stream(spark, tmp_path, [first, other]), first.schema["account"].dataType), "timer-test")
    assert [(r.reservation_id, r.outcome, r.balance) for r in out.filter("kind = 'expire'").collect()] == [("a", "stale_refunded", 1)]


def test_intake_is_once_per_id(spark, tmp_path):
    rows = [(i % 5, T0 + timedelta(minutes=i), "x") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, v string")
    parts = [df.filter(F.minute("ts") < 6), df.filter(F.minute("ts") >= 6)]
    out = E.intake(spark, as_stream(spark, tmp_path, parts))
    assert sorted(r.event_id for r in out.collect()) == [0, 1, 2, 3, 4]


def test_intake_takes_failed_events_again(spark, tmp_path):
    rows = [(1, 0, True), (2, 0, False), (1, 1, True), (2, 1, False), (1, 2, False), (3, 2, False), (1, 3, False), (2, 900, True)]
    df = spark.createDataFrame(rows, "event_id long, day int, failed boolean").withColumn("ts", F.lit(T0).cast("timestamp") + F.make_interval(days=F.col("day")))
    parts = [df.filter(F.col("day") == d) for d in (0, 1, 2, 3, 900)]
    out = E.intake(spark, as_stream(spark, tmp_path, parts), failed="failed")
    assert sorted((r.event_id, r.day, r.failed) for r in out.collect()) == [(1, 0, True), (1, 1, True), (1, 2, False), (2, 0, False), (3, 2, False)]


def ledger_of(changes):
    last = {}
    for r in sorted(changes, key=lambda r: r.version):
        last[r.payment_ref, r.kind] = (r.op, r.credits, r.account)
    return {(*k, *v[1:]) for k, v in last.items() if v[0] == "book"}


def test_the_ledger_does_not_depend_on_how_notices_are_split(spark, tmp_path):
    kinds = ["grant", "refund", "dispute_opened", "dispute_won"]
    rows, state = [], 12345
    for payment in range(60):
        for i in range(1 + payment % 7):
            state = (state * 1103515245 + 12345) % 2**31
            rows.append((f"p{payment}", len(rows), kinds[state // 7 % 4], T0 + timedelta(minutes=state % 500), 7, 5 + payment))
    events = spark.createDataFrame(rows, "payment_ref string, event_id long, kind string, ts timestamp, account long, credits long").withColumn("credits", F.when(F.col("kind") == "grant", F.col("credits")))
    want = {(r.payment_ref, r.kind, r.credits, int(r.user_id)) for r in B.reversal_rows(events).collect()}
    for name, parts in (("one", 1), ("three", 3), ("seven", 7)):
        split = [events.filter(F.pmod(F.xxhash64("event_id", F.lit(name)), F.lit(parts)) == i) for i in range(parts)]
        # Repeats change nothing.
        out = E.run_available(spark, K.reversal_log(as_stream(spark, tmp_path / name, [*split, split[0]])), "log-test").collect()
        assert ledger_of(out) == want and len(want) > 20
        assert parts == 1 or any(r.op == "retract" for r in out)


def test_closed_ids_and_minutes_are_forgotten(spark, tmp_path):
    day = 86_400
    rows = [(0, "grant", "g", 3), (1, "reserve", "a", 0), (2, "reserve", "b", 0), (3, "commit", "a", 0), (day, "commit", "a", 0), (3 * day, "commit", "a", 0), (3 * day + 1, "reserve", "a", 0)]
    parts = [reservation_events(spark, rows).filter((F.col("seq") >= i) & (F.col("seq") < i + 2)) for i in range(0, len(rows), 2)]
    out = E.run_available(spark, K.reservations(as_stream(spark, tmp_path, parts), parts[0].schema["account"].dataType), "forget-test").collect()
    got = {(r.seq, r.kind, r.reservation_id, r.outcome, r.balance) for r in out}
    assert got == {(0, "grant", "g", "grant", 3), (1, "reserve", "a", "reserved", 2), (2, "reserve", "b", "reserved", 1), (3, "commit", "a", "committed", 1),
                   (None, "expire", "b", "stale_refunded", 2), (4, "commit", "a", "idempotent", 2), (5, "commit", "a", "unknown_reservation", 2), (6, "reserve", "a", "reserved", 1)}


def test_slices_follow_their_slots(spark):
    df = spark.range(40).withColumn("ts", F.timestamp_seconds(F.col("id")))
    out = E.run_available(spark, E.sliced(df, F.col("id") % 3), "slice-test")
    assert sorted(r.id for r in out.collect()) == list(range(40))
    first = out.groupBy(F.col("id") % 3).agg(F.min("batch").alias("b")).orderBy(F.col("(id % 3)")).collect()
    assert [r.b for r in first] == sorted(r.b for r in first) and len({r.b for r in first}) == 3


def test_versions_rewrite_touched_buckets_once(spark, tmp_path):
    from factloom.sources.versions import VersionedTable

    schema = spark.range(0).selectExpr("id", "id as at", "cast(null as string) as v", "id as n").schema
    kept = VersionedTable(spark, str(tmp_path / "t"), schema, ["id"], {"at": "max", "v": "fill", "n": "sum"}, "at", buckets=8)
    assert kept.read().count() == 0
    first = spark.range(40).selectExpr("id", "1L as at", "concat('a', id) as v", "1L as n")
    assert set(kept.upsert(first, 0).values()) == {1}
    change = spark.createDataFrame([(3, 2, None, 5), (3, 3, "z", 1)], "id long, at long, v string, n long")
    written = kept.upsert(change, 1)
    version, at, batch = kept.manifest()
    assert len(written) == 1 and (version, batch) == (2, 1) and sorted(at.values()) == [1] * 7 + [2]
    old = kept.read()
    # A batch that comes again, and one without rows.
    assert kept.upsert(change, 1) == {} and kept.upsert(change.limit(0), 2) == {}
    # A writer that was lost before its manifest leaves nothing that is read.
    change.write.parquet(str(tmp_path / "t/data/v=4/bucket=0"))
    spark.range(1).write.parquet(str(tmp_path / "t/manifest/v=9"))
    (tmp_path / "t/manifest/v=9/_SUCCESS").unlink()
    rows = {r.id: (r["at"], r.v, r.n) for r in kept.read().collect()}
    assert rows[3] == (3, "z", 7) and rows[4] == (1, "a4", 1) and len(rows) == 40
    kept.upsert(spark.createDataFrame([(99, 1, "n", 1)], "id long, at long, v string, n long"), 3)
    assert old.count() == 40 and kept.read().count() == 41 and kept.touching(change).filter("id = 3").count() == 1


def test_ended_results_leave_the_state(spark, tmp_path):
    rows = [("a", 0, 0, True, 60), ("a", 1, 30, True, 60), ("a", 2, 100, True, 60), ("b", 3, 400_000, True, 60), ("a", 4, 400_001, True, 60), ("b", 5, 400_030, False, 60), ("c", 6, 800_000, False, 60),
            ("c", 7, 800_001, True, 60), ("c", 8, 800_002, True, 60)]
    df = spark.createDataFrame([(k, i, T0 + timedelta(seconds=s), ok, ttl) for k, i, s, ok, ttl in rows], "key string, seq long, ts timestamp, ok boolean, ttl int")
    parts = [df.filter((F.col("seq") >= i) & (F.col("seq") < i + 3)) for i in (0, 3, 6)]
    out = E.run_available(spark, K.cached_requests(as_stream(spark, tmp_path, parts), "0 seconds"), "cache-test")
    assert {r.seq: r.outcome for r in out.collect()} == {0: "MISS", 1: "HIT", 2: "MISS", 3: "MISS", 4: "MISS", 5: "HIT", 6: "MISS", 7: "MISS", 8: "HIT"}


class Kept:
    """A value of state that counts how often it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def clear(self):
        self.asked += 1
        self.value = None


class Handle:
    def __init__(self):
        self.kept, self.timers, self.calls = Kept(), set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self.kept

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)
        self.calls += 1


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_bucket_of_keys_asks_for_state_once():
    import pandas as pd

    at = pd.Timestamp(T0)
    rows = [(f"p{i % 50}", i, kind, at + pd.Timedelta(minutes=i), 7, 5) for i, kind in enumerate(["grant"] * 50 + ["refund"] * 50)]
    notices = pd.DataFrame(rows, columns=["payment_ref", "event_id", "kind", "ts", "account", "credits"])
    steps = pd.DataFrame([(i % 50, i, kind, at + pd.Timedelta(seconds=i), rid, 9) for i, (kind, rid) in enumerate([("grant", "g")] * 50 + [("reserve", "r")] * 50)],
                         columns=["account", "seq", "kind", "ts", "reservation_id", "credits"])
    for job, whole, made in ((K.Reversals(), notices, 50), (K.ReversalLog(), notices, 50), (K.Reservations(86_400), steps, 100)):
        handle = Handle()
        job.init(handle)
        first = list(job.handleInputRows((0,), iter([whole[:50]]), Clock(0)))
        out = pd.concat([*first, *job.handleInputRows((0,), iter([whole[50:]]), Clock(0))])
        # A read and a write per micro-batch, whatever the number of keys.
        assert handle.kept.asked <= 6 and handle.calls <= 3 and len(handle.timers) <= 1
        assert len(out) == (100 if job.columns[1] == "version" and "op" not in job.columns else made)
    # All reservations are stale at one call, and the timer then waits for the closed ids to be forgotten.
    end = int(at.value // 10**6) + 3_600_000
    late = pd.concat(job.handleExpiredTimer((0,), Clock(end), Clock(end)))
    assert sorted(late.account) == list(range(50)) and set(late.balance) == {9} and set(late.outcome) == {"stale_refunded"}
