"""Streams over the event files, run to the end of the present input, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from factloom.plans.metering_queries import EPOCH_SQL, LEDGER_SQL, REVERSAL_SQL, alert_step
from factloom.plans.tables import payment_events, register_into, table
from factloom.session import work_dir
from factloom.sources.readers import read_events_stream
from factloom.sources.versions import VersionedTable
from factloom.streaming import events as E
from factloom.streaming import state as K

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def stream(spark, folder):
    """The event file of a folder as a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_events_stream(spark, folder, EVENTS, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""select event_id, user_id from events""")
def stream_intake(spark, folder):
    """Every event arrives twice and is taken once."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id")
    twice = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("delivery"))
    # The second delivery comes in another micro-batch.
    parts = E.sliced(twice, F.pmod(F.xxhash64("event_id", "delivery"), F.lit(3))).drop("delivery")
    return E.intake(spark, parts).select("event_id", "user_id")


@query("""select user_id as id, epoch_us(min(ts)) as created_us, epoch_us(max(ts)) as seen_us, max(value) as top, count(*) as n, arg_max(props, ts) as props from events group by user_id""")
def stream_versions(spark, folder):
    """A keyed table kept by a stream, a version per micro-batch; a batch that comes again changes nothing."""
    rows = E.sliced(table(spark, folder, "events").select("user_id", "ts", "value", "props"), F.expr("unix_seconds(ts) div 864000"))
    totals = lambda batch: batch.groupBy(F.col("user_id").alias("id")).agg(
        F.min("ts").alias("created"), F.max("ts").alias("seen"), F.max("value").alias("top"), F.count(F.lit(1)).alias("n"), F.max_by("props", "ts").alias("props"))
    path = work_dir(spark, "versions")
    schema = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("created", T.TimestampType()), ("seen", T.TimestampType()), ("top", T.DoubleType()),
                                                            ("n", T.LongType()), ("props", T.StringType()))])
    kept = VersionedTable(spark, f"{path}/table", schema, ["id"], {"created": "min", "seen": "max", "top": "max", "n": "sum", "props": "last"}, "seen", buckets=16)
    E.start(rows, f"{path}/out", f"{path}/state", sink=kept.sink(totals)).awaitTermination()
    kept.upsert(totals(table(spark, folder, "events")), batch=0)
    return kept.read().select("id", F.unix_micros("created").alias("created_us"), F.unix_micros("seen").alias("seen_us"), "top", "n", "props")


@query("""select user_id as client, epoch_us(time_bucket(interval '30 minutes', ts)) as window_us, count(*) as requests, count(*) > 1 as over_limit from events group by all""")
def stream_request_counts(spark, folder):
    """Requests per client and half hour."""
    e = stream(spark, folder).select(F.col("user_id").alias("client"), "ts")
    out = E.run_available(spark, E.request_counts(e, 1, 1800), "counts", "update")
    last = out.groupBy("client", "window_start").agg(F.max("requests").alias("requests"))
    return last.select("client", F.unix_micros("window_start").alias("window_us"), "requests", (F.col("requests") > 1).alias("over_limit"))


@query("""select user_id as client, strftime(ts, '%Y-%m-%d') as day, count(*) as requests, least(count(*), 3)::bigint as used, (3 - least(count(*), 3))::bigint as remaining from events group by all""")
def stream_daily_quota(spark, folder):
    """Used and remaining requests per client and UTC day (limit 3)."""
    e = stream(spark, folder).select(F.col("user_id").alias("client"), "ts")
    out = E.run_available(spark, E.daily_quota(e, 3), "quota", "update")
    return out.groupBy("client", "day").agg(F.max("requests").alias("requests"), F.max("used").alias("used"), F.min("remaining").alias("remaining"))


def metered(e):
    kind = F.when(F.col("event_type") == "purchase", "grant").when(F.col("event_type") == "click", "commit").when(F.col("event_type") == "error", "refund")
    credits = F.when(F.col("kind") == "grant", F.greatest(F.floor("value"), F.lit(1))).when(F.col("kind") == "commit", -1).otherwise(1)
    rows = e.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return rows.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), "ts", "kind", credits.cast("long").alias("credits"))


@query(f"""with {EPOCH_SQL}, {alert_step(80, None)}, {alert_step(90, 'a80')}, {alert_step(100, 'a90')}
select account, epoch, cast(percent as bigint) as percent, seq from (select * from a80 union all select * from a90 union all select * from a100)""")
def stream_alerts(spark, folder):
    """T5: usage alerts, equal to the batch job."""
    out = E.run_available(spark, K.usage_alerts(metered(stream(spark, folder))), "alerts")
    return out.select("account", "epoch", "percent", "seq")


@query(f"""with {REVERSAL_SQL} select payment_ref, account, granted, refund_final, dispute_active,
  cast(case when granted is null or refund_final or dispute_active then 0 else granted end as bigint) as net_credits, granted is null and (refund_final or dispute_active) as pending from ac""")
def stream_reversals(spark, folder):
    """Payment states after notices in any order, equal to the batch job."""
    # Notices arrive in four parts that have nothing to do with their time.
    rows = E.sliced(payment_events(spark, folder), F.pmod(F.xxhash64("event_id"), F.lit(4)))
    out = E.run_available(spark, K.payment_reversals(rows), "reversals")
    last = out.groupBy("payment_ref").agg(F.max_by(F.struct("account", "granted", "refund_final", "dispute_active", "net_credits", "pending"), "version").alias("s"))
    return last.select("payment_ref", "s.*")


@query("""with recursive n as (select props as key, event_id as seq, ts, event_type <> 'error' as ok, case when value > 30 then 7200 else 43200 end as ttl, row_number() over (partition by props order by ts) as i from events),
fold as (select key, seq, i, 'MISS' as outcome, case when ok then ts end as stored, case when ok then ttl end as ttl from n where i = 1
  union all select n.key, n.seq, n.i, case when n.ts < f.stored + to_seconds(f.ttl) then 'HIT' else 'MISS' end,
    case when n.ts < f.stored + to_seconds(f.ttl) or not n.ok then f.stored else n.ts end, case when n.ts < f.stored + to_seconds(f.ttl) or not n.ok then f.ttl else n.ttl end
  from fold f join n on n.key = f.key and n.i = f.i + 1)
select key, seq, outcome from fold""")
def stream_cache(spark, folder):
    """Hits and misses of a cache that stores the result of every successful miss."""
    rows = stream(spark, folder).select(
        F.col("props").alias("key"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"), F.when(F.col("value") > 30, 7200).otherwise(43200).alias("ttl"))
    return E.run_available(spark, K.cached_requests(rows), "cache").select("key", "seq", "outcome")


@query(f"""{LEDGER_SQL} select payment_ref, books as kind, case when books = 'dispute_reversed' then granted else -granted end as credits, account from s where books is not null""")
def stream_reversal_ledger(spark, folder):
    """Reversal rows of a ledger that is mended as late notices come in, equal to the batch job."""
    rows = E.sliced(payment_events(spark, folder), F.pmod(F.xxhash64("event_id"), F.lit(4)))
    out = E.run_available(spark, K.reversal_log(rows), "reversal-log", "append")
    last = out.groupBy("payment_ref", "kind").agg(F.max_by(F.struct("op", "credits", "account"), "version").alias("s"))
    return last.filter("s.op = 'book'").select("payment_ref", "kind", "s.credits", "s.account")


# One step per event of an account: what is stale expires first, then the event is applied. Closed ids are known for two days.
RESERVATION_SQL = """with recursive e as (select user_id as account, event_id, epoch_us(ts) as us, event_type from events),
p as (select * from e where event_type in ('click', 'view')),
r as (select account, event_id * 10 as seq, us, case event_type when 'purchase' then 'grant' else 'reserve' end as kind, cast(event_id as varchar) as id from e where event_type in ('purchase', 'click', 'view')
  union all select account, event_id * 10 + 1, us + 600000000, 'commit', cast(event_id as varchar) from p where event_id % 3 = 0
  union all select account, event_id * 10 + 2, us + 1200000000, 'refund', cast(event_id as varchar) from p where event_id % 3 = 1
  union all select account, event_id * 10 + 3, us + 86400000000, 'commit', cast(event_id as varchar) from p where event_id % 7 = 0
  union all select account, event_id * 10 + 4, us + 259200000000, 'commit', cast(event_id as varchar) from p where event_id % 11 = 0),
n as (select *, row_number() over (partition by account order by us, seq) as i from r),
f as (select account, 0::bigint as i, null::bigint as seq, null::varchar as id, null::varchar as kind, null::varchar as outcome, 0::bigint as balance,
    []::struct(t bigint, id varchar)[] as open, []::struct(t bigint, id varchar)[] as closed, []::struct(t bigint, id varchar)[] as stale, 0::bigint as held from (select distinct account from n)
  union all
  select account, i, seq, id, kind, outcome,
    held + case outcome when 'grant' then 2 when 'refunded' then 1 else 0 end - case when outcome = 'reserved' and not was_open then 1 else 0 end,
    case when outcome = 'reserved' and not was_open then list_append(open, {'t': us, 'id': id}) when outcome in ('committed', 'refunded') then list_filter(open, lambda o: o.id <> cur) else open end,
    case when outcome in ('grant', 'committed', 'refunded') then list_append(closed, {'t': us, 'id': id}) else closed end, stale, held
  from (select *, id as cur, case kind when 'grant' then case when was_open or known then 'idempotent' else 'grant' end
      when 'reserve' then case when was_open then 'reserved' when known then 'closed' when held < 1 then 'insufficient_credits' else 'reserved' end
      else case when not was_open then case when known then 'idempotent' else 'unknown_reservation' end when kind = 'commit' then 'committed' else 'refunded' end end as outcome
    from (select *, len(list_filter(open, lambda o: o.id = id)) > 0 as was_open, len(list_filter(closed, lambda o: o.id = id and us <= o.t + 172800000000)) > 0 as known
      from (select n.account, n.i, n.seq, n.id, n.kind, n.us, list_filter(f.open, lambda o: o.t >= n.us - 900000000) as open,
          list_sort(list_filter(f.open, lambda o: o.t < n.us - 900000000)) as stale, f.balance + len(list_filter(f.open, lambda o: o.t < n.us - 900000000)) as held,
          list_concat(list_filter(f.closed, lambda o: n.us <= o.t + 172800000000), list_transform(list_filter(f.open, lambda o: o.t < n.us - 900000000), lambda o: {'t': o.t + 900000000, 'id': o.id})) as closed
        from f join n on n.account = f.account and n.i = f.i + 1))))"""


@query(f"""{RESERVATION_SQL}, w as (select max(us) as us from r),
z as (select f.account, f.balance, list_sort(list_filter(f.open, lambda o: (o.t // 60000000 + 1) * 60000000 + 900000000 <= w.us)) as stale from f, w qualify row_number() over (partition by f.account order by f.i desc) = 1),
x as (select account, balance as held, stale, true as late from z union all select account, held - len(stale), stale, false from f where i > 0)
select account, seq, id as reservation_id, kind, outcome, balance from f where i > 0
union all select account, null, stale[k].id, 'expire', 'stale_refunded', held + k from (select account, held, stale, unnest(range(1, len(stale) + 1)) as k from x)""")
def stream_reservations(spark, folder):
    """T4: outcome of every reserve, commit and refund, in five parts; reservations expire after 15 minutes, closed ids are known for two days."""
    e = table(spark, folder, "events").filter(F.col("event_type").isin("purchase", "click", "view"))
    number, held = F.col("event_id"), F.col("event_type") != "purchase"
    step = lambda test, offset, seconds, kind: F.when(test, F.struct((number * 10 + offset).alias("seq"), (F.unix_micros("ts") + seconds * 1_000_000).alias("us"), F.lit(kind).alias("kind")))
    steps = F.array_compact(F.array(
        step(~held, 0, 0, "grant"), step(held, 0, 0, "reserve"), step(held & (number % 3 == 0), 1, 600, "commit"), step(held & (number % 3 == 1), 2, 1200, "refund"),
        step(held & (number % 7 == 0), 3, 86_400, "commit"), step(held & (number % 11 == 0), 4, 259_200, "commit")))
    rows = e.select(F.col("user_id").alias("account"), number.cast("string").alias("reservation_id"), F.explode(steps).alias("s")).select(
        "account", "s.seq", F.timestamp_micros("s.us").alias("ts"), "s.kind", "reservation_id", F.lit(2).cast("long").alias("credits"))
    parts = E.sliced(rows, F.expr("unix_seconds(ts) div 604800"))
    out = E.run_available(spark, K.reservations(parts), "reservations")
    return out.select("account", "seq", "reservation_id", "kind", "outcome", "balance")


@query("""with recursive n as (select user_id as account, event_id as seq, ts, strftime(ts, '%Y-%m') as period, case event_type when 'purchase' then 'paid' when 'error' then 'failed' else 'usage' end as kind,
    cast(floor(value) as bigint) as balance, case when event_id % 17 = 0 then 'LOST_CARD' else 'X' end as code, row_number() over (partition by user_id order by ts) as i from events),
fold as (select account, 0::bigint as i, null::bigint as seq, null::varchar as outcome, ''::varchar as period, 0::bigint as spent, false as pending, 0::bigint as failures, timestamp '1970-01-01' as retry, false as stopped from (select distinct account from n)
  union all
  select n.account, n.i, n.seq,
    case when n.kind = 'usage' then case when f.stopped then 'requires_attention' when n.ts < f.retry then 'retry_wait' when n.balance > 40 then 'above_trigger'
        when f.pending and f.period = n.period then 'charge_pending' when (case when f.period = n.period then f.spent else 0 end) + 2000 > 6000 then 'monthly_limit' else 'reserved' end
      when not (f.pending and f.period = n.period) then 'idempotent' when n.kind = 'paid' then 'committed' else 'released' end,
    n.period,
    (case when f.period = n.period then f.spent else 0 end) + case when n.kind = 'paid' and f.pending and f.period = n.period then 2000 else 0 end,
    case when n.kind <> 'usage' then false when f.pending and f.period = n.period then true
      else not f.stopped and n.ts >= f.retry and n.balance <= 40 and (case when f.period = n.period then f.spent else 0 end) + 2000 <= 6000 end,
    case when n.kind = 'paid' then 0 when n.kind = 'failed' then f.failures + 1 else f.failures end,
    case when n.kind = 'paid' then timestamp '1970-01-01' when n.kind = 'failed' then case when f.stopped or f.failures + 1 >= 3 or n.code = 'LOST_CARD' then timestamp '1970-01-01' else n.ts + interval 3 day end else f.retry end,
    f.stopped or (n.kind = 'failed' and (f.failures + 1 >= 3 or n.code = 'LOST_CARD'))
  from fold f join n on n.account = f.account and n.i = f.i + 1)
select account, seq, outcome, spent::bigint as spent_cents, failures::bigint as failures from fold where i > 0""")
def stream_auto_funding(spark, folder):
    """Automatic charges below a trigger with a monthly cap, waiting and stopping after failures."""
    kind = F.when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "error", "failed").otherwise("usage")
    rows = stream(spark, folder).select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.floor("value").cast("long").alias("balance"), F.when(F.col("event_id") % 17 == 0, "LOST_CARD").otherwise("X").alias("code"))
    out = E.run_available(spark, K.automatic_funding(rows, 40, 2_000, 6_000), "funding")
    return out.select("account", "seq", "outcome", "spent_cents", "failures")
