"""Jobs over the event log and the account-like tables, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators import billing as B
from factloom.operators import cachelog, joins, reports, search
from factloom.operators.ordered import nearest_rank, top_k
from factloom.plans.tables import meter_events, payment_events, register_into, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)

METER_SQL = """meter as (select user_id as account, event_id as seq, ts,
  case event_type when 'purchase' then 'grant' when 'click' then 'commit' else 'refund' end as kind,
  cast(case event_type when 'purchase' then greatest(floor(value), 1) when 'click' then -1 else 1 end as bigint) as credits
  from events where event_type in ('purchase', 'click', 'error'))"""
PAYMENT_SQL = """pay as (select event_id, 'pay_' || (event_id // 6) as payment_ref, user_id as account, ts,
  case event_type when 'purchase' then 'grant' when 'error' then 'refund' when 'signup' then 'dispute_opened' else 'dispute_won' end as kind,
  case when event_type = 'purchase' then cast(greatest(floor(value), 1) as bigint) end as credits
  from events where event_type in ('purchase', 'error', 'signup', 'view'))"""
OVER = "over (partition by account order by ts, seq)"


@query(f"with {METER_SQL} select account, cast(coalesce(sum(credits), 0) as bigint) as net_credits from meter group by account")
def ledger_net_balance(spark, folder):
    """A1: net credits per account."""
    return B.net_credits(meter_events(spark, folder), "account")


@query("""select o_orderkey, cents, case when cents between 1000 and 490000 then cast(floor(cents * 1000 // 49) as bigint) end as credits,
  cents between 1000 and 490000 as valid from (select o_orderkey, cast(floor(cast(o_totalprice as decimal(18,2)) * 10) as bigint) as cents from orders)""")
def credits_per_amount(spark, folder):
    """Credits of a purchase within the allowed amounts."""
    cents = F.floor(F.col("o_totalprice").cast("decimal(18,2)") * 10).cast("long")
    amounts = table(spark, folder, "orders").select("o_orderkey", cents.alias("cents"))
    return amounts.select("o_orderkey", "cents", B.credits_for_amount(F.col("cents")).alias("credits"), B.valid_purchase(F.col("cents")).alias("valid"))


@query(f"with {METER_SQL} select account, seq, kind, credits, cast(sum(credits) {OVER} as bigint) as balance from meter")
def running_balance(spark, folder):
    """Balance after every event; it may become negative."""
    return B.running_balance(meter_events(spark, folder)).select("account", "seq", "kind", "credits", "balance")


EPOCH_SQL = f"""{METER_SQL},
bal as (select *, cast(sum(credits) {OVER} as bigint) as balance, cast(sum((kind = 'grant')::int) {OVER} as bigint) as epoch from meter),
ep as (select *, coalesce(last_value(case when kind = 'grant' then greatest(balance, 0) end ignore nulls) {OVER}, 0) as basis from bal),
used as (select *, greatest(basis - balance, 0) as used from ep)"""


@query(f"with {EPOCH_SQL} select account, seq, kind, balance, epoch, cast(basis as bigint) as basis, cast(used as bigint) as used from used")
def funding_epochs(spark, folder):
    """Funding epoch, its basis and the used credits at every event."""
    return B.funding_epochs(meter_events(spark, folder)).select("account", "seq", "kind", "balance", "epoch", "basis", "used")


def alert_step(percent: int, after: str | None) -> str:
    later = f"join {after} a using (account, epoch) where (u.ts, u.seq) > (a.ts, a.seq) and" if after else "where"
    return f"""a{percent} as (select u.account, u.epoch, {percent} as percent, min(u.ts) as ts, min(u.seq) as seq from used u
  {later} u.kind = 'commit' and u.basis > 0 and u.used * 100 >= {percent} * u.basis group by all)"""


@query(f"""with {EPOCH_SQL}, {alert_step(80, None)}, {alert_step(90, 'a80')}, {alert_step(100, 'a90')}
select account, epoch, cast(percent as bigint) as percent, seq, account || ':' || epoch || ':' || percent as alert_id
from (select * from a80 union all select * from a90 union all select * from a100)""")
def usage_alerts(spark, folder):
    """Each threshold once per epoch, ascending, one per commit (event ids grow with time here)."""
    return B.usage_alerts(meter_events(spark, folder)).select("account", "epoch", "percent", "seq", "alert_id")


RESERVATION_SQL = """res as (select user_id as account, event_id as id, ts as created_at, case when value < 60 then ts + interval '5 minutes' end as completed_at,
  case when value >= 60 then 'reserved' when event_type = 'error' then 'refunded' else 'committed' end as state,
  case when event_id % 3 = 0 then 'anonymous' else 'paid' end as meter_kind from events where event_type <> 'signup')"""
NOW = "2024-01-30 12:00:00"


def reservations(spark, folder):
    """events as reservations: long ones are still open, errors were refunded."""
    open_ = F.col("value") >= 60
    state = F.when(open_, "reserved").when(F.col("event_type") == "error", "refunded").otherwise("committed")
    return table(spark, folder, "events").filter(F.col("event_type") != "signup").select(
        F.col("user_id").alias("account"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.when(~open_, F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("completed_at"), state.alias("state"),
        F.when(F.col("event_id") % 3 == 0, "anonymous").otherwise("paid").alias("meter_kind"))


@query(f"with {RESERVATION_SQL} select account, count_if(state = 'committed' and completed_at >= timestamp '{NOW}' - interval 7 day)::bigint as usage from res group by account")
def usage_recent(spark, folder):
    """Reservations committed in the last week, by completion time."""
    return B.usage_in_days(reservations(spark, folder), F.lit(NOW).cast("timestamp"), 7)


@query(f"""with {METER_SQL}, cyc as (select c_custkey as account, case when c_custkey % 5 <> 0 then 'k' || c_custkey end as cycle_key,
  case when c_custkey % 2 = 0 then timestamp '2024-01-05' + to_days(cast(c_custkey % 10 as integer)) end as s, case when c_custkey % 3 <> 0 then timestamp '2024-01-20' end as e from customer)
select account, count_if(cycle_key is not null and (s is null or s <= ts) and (e is null or e >= ts))::bigint as cycle_used
from meter left join cyc using (account) where kind = 'commit' group by account""")
def cycle_usage(spark, folder):
    """Commits inside the billing cycle of the account."""
    key = F.col("c_custkey")
    start = F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(days=(key % 10).cast("int"))
    cycles = table(spark, folder, "customer").select(
        key.alias("account"), F.when(key % 5 != 0, F.concat(F.lit("k"), key)).alias("cycle_key"),
        F.when(key % 2 == 0, start).alias("cycle_started_at"), F.when(key % 3 != 0, F.lit("2024-01-20").cast("timestamp")).alias("cycle_ends_at"))
    return B.cycle_usage(meter_events(spark, folder).filter(F.col("kind") == "commit"), cycles)


@query(f"""with {RESERVATION_SQL}, s as (select *, state = 'reserved' and created_at < timestamp '{NOW}' - interval '15 minutes' as stale from res)
select account, count_if(stale)::bigint as stale_all, count_if(stale and meter_kind = 'paid')::bigint as stale_paid,
  count_if(not stale and state in ('reserved', 'committed'))::bigint as used, greatest(0, 60 - count_if(not stale and state in ('reserved', 'committed')))::bigint as remaining
from s group by account""")
def stale_reservations(spark, folder):
    """A4, A3: open reservations past their time, and what is left of a quota after they expire."""
    rows, now = reservations(spark, folder), F.lit(NOW).cast("timestamp")
    status = B.quota_status(B.expire_stale(rows, now), ["account"], 60)
    return B.stale_counts(rows, now).join(status, "account").withColumn("remaining", F.col("remaining").cast("long"))


@query("""with r as (select event_id as seq, user_id as client, strftime(ts, '%Y-%m-%d') as day, ts from events)
select day, client, seq, sha256(day || chr(10) || client) as client_key, row_number() over (partition by day, client order by ts, seq) as slot from r qualify slot <= 2""")
def quota_daily_admission(spark, folder):
    """The first two requests of a client and UTC day (limit 2, so that some are rejected)."""
    requests = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("client"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts")
    return B.simple_admission(requests, 2).select(
        "day", "client", "seq", ids.key_hash(F.concat_ws("\n", "day", F.col("client").cast("string"))).alias("client_key"), "slot")


def quota_events(spark, folder):
    """events as quota steps: every row reserves; it commits after two minutes, or an error refunds after a minute, or it stays open."""
    e = table(spark, folder, "events")
    base = [F.col("user_id").alias("client"), F.col("event_id").alias("reservation_id")]
    reserve = e.select(*base, F.lit("reserve").alias("kind"), "ts")
    commit = e.filter(F.col("event_type").isin("click", "purchase")).select(*base, F.lit("commit").alias("kind"), (F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("ts"))
    refund = e.filter(F.col("event_type") == "error").select(*base, F.lit("refund").alias("kind"), (F.col("ts") + F.expr("INTERVAL 1 MINUTES")).alias("ts"))
    return reserve.unionByName(commit).unionByName(refund)


@query("""with recursive iv as (select strftime(ts, '%Y-%m-%d') as day, user_id as client, event_id as id, ts as s,
    case when event_type in ('click', 'purchase') then null when event_type = 'error' then ts + interval 1 minute else ts + interval 15 minute end as f from events),
n as (select *, row_number() over (partition by day, client order by s, id) as i from iv),
fold as (select day, client, i, id, true as admitted, [coalesce(f, timestamp '2100-01-01')] as live from n where i = 1
  union all
  select n.day, n.client, n.i, n.id, len(list_filter(fold.live, lambda x: x > n.s)) < 2,
    case when len(list_filter(fold.live, lambda x: x > n.s)) < 2 then list_append(list_filter(fold.live, lambda x: x > n.s), coalesce(n.f, timestamp '2100-01-01'))
      else list_filter(fold.live, lambda x: x > n.s) end
  from fold join n on n.day = fold.day and n.client = fold.client and n.i = fold.i + 1)
select day, client, id as reservation_id, admitted from fold""")
def quota_with_refunds(spark, folder):
    """W7 in full: refunds and expiries give the slot back (limit 2)."""
    steps = quota_events(spark, folder)
    first_day = table(spark, folder, "events").select(F.col("event_id").alias("reservation_id"), "ts").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts")
    # A step that falls behind midnight still belongs to the day of its reservation.
    dated = steps.join(first_day, "reservation_id")
    started = dated.withColumn("ts", F.when(F.date_format("ts", "yyyy-MM-dd") == F.col("day"), F.col("ts")).otherwise(
        F.to_timestamp(F.concat("day", F.lit(" 23:59:59.999999")))))
    return B.daily_admission(started.drop("day"), 2)


@query("""select user_id as client, strftime(time_bucket(interval '30 minutes', ts), '%Y-%m-%d %H:%M') as window_start, count(*) as requests,
  least(count(*), 1)::bigint as admitted, greatest(count(*) - 1, 0)::bigint as rejected from events group by all""")
def rate_limit_fixed(spark, folder):
    """One request per client and fixed half hour."""
    limited = B.rate_limit_fixed(table(spark, folder, "events"), 1, 1800, "user_id")
    return limited.select(
        F.col("user_id").alias("client"), F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "requests",
        F.col("admitted").cast("long").alias("admitted"), F.col("rejected").cast("long").alias("rejected"))


@query("""select event_id, user_id as client, count(*) over w as in_window, count(*) over w > 1 as limited from events
window w as (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row)""")
def rate_limit_trailing(spark, folder):
    """Requests of a client in the hour that ends at each request."""
    out = B.rate_limit_trailing(table(spark, folder, "events"), 1, 3600, "user_id")
    return out.select("event_id", F.col("user_id").alias("client"), "in_window", "limited")


@query("""with c as (select user_id as account, event_id as seq, ts, cast(floor(cast(value as decimal(18,2)) * 100) as bigint) as amount_cents from events where event_type = 'purchase')
select account, seq, strftime(ts, '%Y-%m') as period, cast(sum(amount_cents) over (partition by account, strftime(ts, '%Y-%m') order by ts, seq) as bigint) as spent_cents,
  sum(amount_cents) over (partition by account, strftime(ts, '%Y-%m') order by ts, seq) <= 20000 as within_cap from c""")
def monthly_cap(spark, folder):
    """Running spend per account and month against a cap."""
    charges = table(spark, folder, "events").filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), "ts",
        F.floor(F.col("value").cast("decimal(18,2)") * 100).cast("long").alias("amount_cents"))
    return B.monthly_spend(charges, 20_000).select("account", "seq", "period", "spent_cents", "within_cap")


@query("""with recursive e as (select user_id as account, strftime(ts, '%Y-%m') as period, event_id as seq, ts,
    case event_type when 'purchase' then 'reserve' when 'click' then 'commit' else 'release' end as kind, 'a' || (event_id % 2) as ref,
    cast(floor(cast(value as decimal(18,2)) * 100) as bigint) as amount from events where event_type in ('purchase', 'click', 'error')),
n as (select *, row_number() over (partition by account, period order by ts, seq) as i from e),
fold as (select account, period, cast(0 as bigint) as i, cast(null as bigint) as seq, cast(null as varchar) as kind, cast(null as varchar) as outcome,
    cast(null as varchar) as pending, cast(0 as bigint) as amount, cast(0 as bigint) as spent from (select distinct account, period from e)
  union all
  select n.account, n.period, n.i, n.seq, n.kind,
    case when n.kind = 'reserve' then case when f.pending = n.ref then 'idempotent' when f.pending is not null then 'charge_pending' when f.spent + n.amount > 9000 then 'monthly_limit' else 'reserved' end
      when f.pending is null then 'idempotent' when f.pending <> n.ref then 'different_charge_pending' when n.kind = 'commit' then 'committed' else 'released' end,
    case when n.kind = 'reserve' then case when f.pending is not null then f.pending when f.spent + n.amount > 9000 then null else n.ref end
      when f.pending = n.ref then null else f.pending end,
    case when n.kind = 'reserve' and f.pending is null and f.spent + n.amount <= 9000 then n.amount else f.amount end,
    case when n.kind = 'commit' and f.pending = n.ref then f.spent + f.amount else f.spent end
  from fold f join n on n.account = f.account and n.period = f.period and n.i = f.i + 1)
select account, period, seq, kind, outcome from fold where i > 0""")
def funding_attempts(spark, folder):
    """W9 in full: one pending charge at a time and a monthly cap."""
    kind = F.when(F.col("event_type") == "purchase", "reserve").when(F.col("event_type") == "click", "commit").when(F.col("event_type") == "error", "release")
    attempts = table(spark, folder, "events").withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        F.col("user_id").alias("account"), F.date_format("ts", "yyyy-MM").alias("period"), F.col("event_id").alias("seq"), "ts", "kind",
        F.concat(F.lit("a"), F.col("event_id") % 2).alias("attempt_id"), F.floor(F.col("value").cast("decimal(18,2)") * 100).cast("long").alias("amount_cents"))
    return B.funding_attempts(attempts, 9_000)


@query("""with a as (select user_id as account, event_id as seq, ts, event_type = 'error' as failed, case when event_id % 17 = 0 then 'LOST_CARD' else 'PAYMENT_FAILED' end as code
  from events where event_type in ('error', 'purchase')),
i as (select *, sum((not failed)::int) over (partition by account order by ts, seq) as island from a),
s as (select *, case when failed then sum(failed::int) over (partition by account, island order by ts, seq) else 0 end as streak from i)
select account, seq, failed, cast(streak as bigint) as streak,
  case when failed and (code = 'LOST_CARD' or streak >= 3) then 'requires_attention' when failed then 'retry_wait' else 'active' end as status,
  case when failed and not (code = 'LOST_CARD' or streak >= 3) then epoch_us(ts + interval 3 day) end as next_retry_us from s""")
def failure_streaks(spark, folder):
    """Failures in a row, and whether charging stops or is tried again."""
    attempts = table(spark, folder, "events").filter(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") == "error").alias("failed"),
        F.when(F.col("event_id") % 17 == 0, "LOST_CARD").otherwise("PAYMENT_FAILED").alias("error_code"))
    return B.failure_streaks(attempts).select("account", "seq", "failed", "streak", "status", F.unix_micros("next_retry_at").alias("next_retry_us"))


REVERSAL_SQL = f"""{PAYMENT_SQL}, st as (select payment_ref, arg_min(account, (ts, event_id)) filter (kind = 'grant') as account,
  arg_min(credits, (ts, event_id)) filter (kind = 'grant') as granted, bool_or(kind = 'refund') as refund_final,
  arg_max(kind, (ts, event_id)) filter (kind in ('dispute_opened', 'dispute_won')) as last_dispute from pay group by payment_ref),
ac as (select *, not refund_final and coalesce(last_dispute = 'dispute_opened', false) as dispute_active from st)"""


@query(f"""with {REVERSAL_SQL} select payment_ref, account, granted, refund_final, dispute_active,
  cast(case when granted is null or refund_final or dispute_active then 0 else granted end as bigint) as net_credits, granted is null and (refund_final or dispute_active) as pending from ac""")
def reversal_state(spark, folder):
    """What refunds and disputes leave of every payment, whatever order they came in."""
    return B.reversal_state(payment_events(spark, folder)).drop("last_dispute_at")


# One step per notice of a payment, with what it books.
LEDGER_SQL = f"""with recursive {PAYMENT_SQL},
o as (select *, row_number() over (partition by payment_ref order by ts, event_id) as n from pay),
s as (select payment_ref, 0::bigint as n, null::bigint as account, null::bigint as granted, 0::bigint as net, false as refunded, false as active, false as d, false as w, false as r, null::varchar as books
    from (select distinct payment_ref from o)
  union all
  select payment_ref, n, account, granted, net + case books when 'dispute_reversed' then granted when 'dispute' then -granted when 'refund' then -granted else 0 end + case when new then granted else 0 end,
    refunded, active, d or coalesce(books = 'dispute', false), w or coalesce(books = 'dispute_reversed', false), r or coalesce(books = 'refund', false), books
  from (select x.*, case when granted is null then null
      when (kind = 'refund' or new and refunded) and (net > 0 or new) and not r then 'refund'
      when (kind = 'dispute_opened' or new and active) and (net > 0 or new) and not d then 'dispute'
      when kind = 'dispute_won' and not refunded and net <= 0 and not w then 'dispute_reversed' end as books
    from (select s.payment_ref, o.n, coalesce(s.account, case when o.kind = 'grant' then o.account end) as account,
        coalesce(s.granted, case when o.kind = 'grant' then o.credits end) as granted, s.granted is null and o.kind = 'grant' as new, o.kind, s.net,
        s.refunded or o.kind = 'refund' as refunded, case o.kind when 'dispute_opened' then true when 'dispute_won' then false else s.active end as active, s.d, s.w, s.r
      from s join o on o.payment_ref = s.payment_ref and o.n = s.n + 1) x))"""


@query(f"""{LEDGER_SQL} select 'ledger_' || e as id, account as user_id, books as kind, case when books = 'dispute_reversed' then granted else -granted end as credits, payment_ref, e as external_ref
from (select *, case when books = 'dispute_reversed' then 'restore:dispute:' || payment_ref else 'reversal:' || books || ':' || payment_ref end as e from s where books is not null)""")
def reversal_ledger(spark, folder):
    """Ledger rows that take reversed grants back and give them back when a dispute is won."""
    return B.reversal_rows(payment_events(spark, folder))


@query("""with both as_ as (select 1) select 1""".replace("both as_ as (select 1) ", "d as (select event_id, user_id, event_type, ts, 0 as delivery from events union all select event_id, user_id, event_type, ts + interval 1 hour, 1 from events where event_id % 4 = 0) ").replace("select 1", """select event_id, arg_min(user_id, (ts, delivery)) as user_id, min(delivery)::int as delivery from d where event_id not in (select o_orderkey from orders where o_orderkey % 9 = 0) group by event_id"""))
def idempotent_events(spark, folder):
    """Re-delivered events count once, and ids handled before are skipped."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts").withColumn("delivery", F.lit(0))
    again = e.filter(F.col("event_id") % 4 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumn("delivery", F.lit(1))
    handled = table(spark, folder, "orders").filter(F.col("o_orderkey") % 9 == 0).select(F.col("o_orderkey").alias("event_id"))
    fresh = joins.unseen(e.unionByName(again), handled, "event_id")
    return joins.once(fresh, "event_id", ["ts", "delivery"]).select("event_id", "user_id", "delivery")


KEYS_SQL = """keys as (select o_orderkey as id, o_custkey as user_id, epoch_ms(o_orderdate) as created_at, case when o_orderstatus = 'F' then epoch_ms(o_orderdate) + 1 end as revoked_at from orders),
accounts as (select c_custkey as user_id, c_custkey % 2 as welcome_eligible, case when c_custkey % 5 = 0 then 1 end as welcome_granted_at, c_mktsegment as segment from customer)"""


def key_tables(spark, folder):
    """orders as API keys and customers as accounts."""
    keys = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.unix_millis("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.unix_millis("o_orderdate") + 1).alias("revoked_at"))
    accounts = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 2).alias("welcome_eligible"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(1)).alias("welcome_granted_at"), F.col("c_mktsegment").alias("segment"))
    return keys, accounts


@query(f"""with {KEYS_SQL} select id, user_id, segment, welcome_eligible = 1 and welcome_granted_at is null as welcome_pending, sha256(cast(id as varchar)) as key_hash
from keys join accounts using (user_id) where revoked_at is null""")
def key_account_join(spark, folder):
    """Active keys with their account, only the hash of a key shown."""
    keys, accounts = key_tables(spark, folder)
    return B.active_key_accounts(keys, accounts).select("id", "user_id", "segment", "welcome_pending", ids.key_hash(F.col("id").cast("string")).alias("key_hash"))


@query(f"with {KEYS_SQL} select user_id, count(*) as active_keys, count(*) < 2 as may_create from keys where revoked_at is null group by user_id")
def key_limits(spark, folder):
    """A5: active keys per account and whether another is allowed."""
    return B.key_limits(key_tables(spark, folder)[0])


@query(f"""with {KEYS_SQL} select 'ledger_welcome:v1:' || user_id as id, user_id, 'welcome_bonus' as kind, 1000::bigint as credits, 'welcome:v1:' || user_id as external_ref
from accounts where welcome_eligible = 1 and welcome_granted_at is null and user_id not in (select s_suppkey from supplier)""")
def welcome_grants(spark, folder):
    """The one-time grant for accounts that are due one and did not get it yet."""
    seen = table(spark, folder, "supplier").select(ids.welcome_ref(F.col("s_suppkey")).alias("external_ref"))
    return B.welcome_grants(key_tables(spark, folder)[1], seen)


@query("""select o_custkey as user_id, o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as day, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as pos from orders qualify pos <= 5""")
def recent_ledger(spark, folder):
    """The latest five orders of every customer."""
    ledger = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"))
    return B.recent_ledger(ledger, 5).select("user_id", "id", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "pos")


@query("""with s as (select c_custkey as user_id, case when c_custkey % 7 = 0 then 0 else 1 end as enabled, cast(floor(c_acctbal) as bigint) as balance, case when c_custkey % 11 = 0 then 2000 end as next_retry_at,
  case when c_custkey % 5 = 0 then null else 'sub_' || c_custkey end as sub, ['active','on_hold','cancelled'][(c_custkey % 3) + 1] as status from customer)
select user_id, case when enabled <> 1 then 'disabled' when sub is null then 'no_mandate' when status not in ('active','on_hold') then 'mandate_inactive'
  when next_retry_at > 1000 then 'retry_wait' when balance > 3000 then 'above_trigger' else 'eligible' end as reason from s""")
def funding_eligibility(spark, folder):
    """Why an account is or is not charged now."""
    key = F.col("c_custkey")
    c = table(spark, folder, "customer")
    settings = c.select(key.alias("user_id"), F.when(key % 7 == 0, 0).otherwise(1).alias("enabled"), F.lit(3000).alias("trigger_credits"),
                        F.when(key % 11 == 0, F.lit(2000)).alias("next_retry_at"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "on_hold", "cancelled")]), (key % 3 + 1).cast("int"))
    accounts = c.select(key.alias("user_id"), F.when(key % 5 != 0, F.concat(F.lit("sub_"), key)).alias("subscription_ref"), status.alias("subscription_status"))
    balances = c.select(key.alias("user_id"), F.floor("c_acctbal").cast("long").alias("balance"))
    return B.funding_eligibility(settings, accounts, balances, F.lit(1000)).select("user_id", "reason")


@query("""with i as (select o_orderkey as ref, o_custkey as user_id, cast(floor(cast(o_totalprice as decimal(18,2)) * 100) as bigint) as amount_cents from orders),
l as (select l_orderkey as ref, count(*) as n from lineitem group by l_orderkey),
p as (select l.ref, i.user_id + case when l.ref % 10 = 0 then 1 else 0 end as user_id, i.amount_cents + case when l.n > 6 then 1 else 0 end as amount_cents from l left join i using (ref))
select p.ref, i.ref is not null and i.user_id = p.user_id and i.amount_cents = p.amount_cents as matched from p left join i using (ref)""")
def intent_match_check(spark, folder):
    """Payments that agree with their checkout intent in account and amount."""
    intents = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("user_id"), F.floor(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("amount_cents"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    payments = lines.join(intents, "ref", "left").select(
        "ref", (F.col("user_id") + F.when(F.col("ref") % 10 == 0, 1).otherwise(0)).alias("user_id"),
        (F.col("amount_cents") + F.when(F.col("n") > 6, 1).otherwise(0)).alias("amount_cents"))
    return B.match_intents(payments, intents, "ref", ["user_id", "amount_cents"]).select("ref", "matched")


@query("""with e as (select event_id, case when event_id % 3 = 0 then user_id end as given, 'c' || (user_id * 2) as customer_ref, 's' || (user_id % 600) as subscription_ref, 'k' || (event_id % 900) as checkout_ref from events),
a as (select 'c' || c_custkey as customer_ref, 's' || (c_custkey + 30) as subscription_ref, c_custkey as user_id from customer),
i as (select 'k' || (s_suppkey * 2) as checkout_ref, s_suppkey * 1000 as user_id from supplier), z as (select 'k' || s_suppkey as checkout_ref, s_suppkey * 2000 as user_id from supplier)
select event_id, coalesce(given, a.user_id, b.user_id, i.user_id, z.user_id) as user_id from e left join a on a.customer_ref = e.customer_ref left join a b on b.subscription_ref = e.subscription_ref
left join i on i.checkout_ref = e.checkout_ref left join z on z.checkout_ref = e.checkout_ref""")
def account_resolution(spark, folder):
    """The account of a payment event by its most direct reference."""
    e = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id"), F.concat(F.lit("c"), F.col("user_id") * 2).alias("customer_ref"),
        F.concat(F.lit("s"), F.col("user_id") % 600).alias("subscription_ref"), F.concat(F.lit("k"), F.col("event_id") % 900).alias("checkout_ref"))
    accounts = table(spark, folder, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("customer_ref"), F.concat(F.lit("s"), F.col("c_custkey") + 30).alias("subscription_ref"), F.col("c_custkey").alias("user_id"))
    s = table(spark, folder, "supplier")
    checkout = lambda step, k: s.select(F.concat(F.lit("k"), F.col("s_suppkey") * step).alias("checkout_ref"), (F.col("s_suppkey") * k).alias("user_id"))
    return B.resolve_account(e, accounts, checkout(2, 1000), checkout(1, 2000)).select("event_id", "user_id")


STATUS_SQL = """['active','on_hold','plan_changed','cancelled','failed'][(event_id % 5) + 1]"""


@query(f"""with e as (select user_id, ts, {STATUS_SQL} as t, event_id % 2 = 0 as c from events), l as (select user_id, arg_max(t, ts) as t, arg_max(c, ts) as c from e group by user_id)
select user_id, t as subscription_status, case when t = 'active' then 'active' when t = 'on_hold' then 'on_hold' when t = 'plan_changed' and c then 'scheduled_cancel' when t in ('cancelled','failed') then t end as funding_status,
  case when t = 'active' then true when (t = 'plan_changed' and c) or t in ('cancelled','failed') then false end as funding_enabled from l""")
def subscription_status(spark, folder):
    """The last subscription event of an account and its effect."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "on_hold", "plan_changed", "cancelled", "failed")]), (F.col("event_id") % 5 + 1).cast("int"))
    events = table(spark, folder, "events").select(
        "user_id", "ts", F.concat(F.lit("subscription."), status).alias("type"), F.lit(None).cast("string").alias("status"), (F.col("event_id") % 2 == 0).alias("cancel_scheduled"))
    return B.latest_status(events)


@query("""with r as (select event_id, props as key, ts from events where event_type = 'view'),
s as (select props as key, ts as stored_at, case when value > 30 then 7200 else 43200 end as ttl from events where event_type = 'click' and value < 80)
select r.event_id, r.key, epoch_us(s.stored_at) as stored_us, case when r.ts < s.stored_at + to_seconds(s.ttl) then 'HIT' else 'MISS' end as outcome
from r asof left join s on r.key = s.key and r.ts >= s.stored_at""")
def cache_hit_miss(spark, folder):
    """Requests answered by the latest valid result of their key; failed results are not stored."""
    e = table(spark, folder, "events")
    requests = e.filter(F.col("event_type") == "view").select("event_id", F.col("props").alias("key"), "ts")
    ttl = F.when(F.col("value") > 30, 7200).otherwise(43200)
    results = e.filter(F.col("event_type") == "click").select(F.col("props").alias("key"), F.col("ts").alias("stored_at"), ttl.alias("ttl"), (F.col("value") < 80).alias("ok"))
    return cachelog.cache_lookup(requests, results).select("event_id", "key", F.unix_micros("stored_at").alias("stored_us"), "outcome")


@query("""select event_id, case when event_id % 4 = 0 then 300 when event_id % 4 = 1 then 3600 when event_id % 4 = 2 then 3600 else 2592000 end::bigint as ttl,
  epoch_us(ts) + 1000000::bigint * case when event_id % 4 = 0 then 300 when event_id % 4 in (1, 2) then 3600 else 2592000 end as expires_us from events""")
def ttl_assignment(spark, folder):
    """How long each kind of result stays valid."""
    k = F.col("event_id") % 4
    ttl = cachelog.assign_ttl(F.when(k == 0, "yahoo-finance").otherwise("web"), k == 1, F.when(k == 2, "product").otherwise("article"))
    return table(spark, folder, "events").select("event_id", ttl.alias("ttl"), (F.unix_micros("ts") + ttl * 1_000_000).alias("expires_us"))


@query("""with q as (select item_id, lower(trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g'))) as t from benchmark),
v as (select item_id, v, t from q, (values ('plain'), ('spaced'), ('extra')) x(v))
select item_id, v as spelling, sha256('/api/places?q=' || replace(url_encode(t), '%20', '+') || '&format=json&limit=5&language=en&country=DE&type=any#places-1') as key from v""")
def cache_keys(spark, folder):
    """P25: differently written requests share one key."""
    text = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    plain = F.create_map(F.lit("q"), text, F.lit("country"), F.lit("DE"))
    spaced = F.create_map(F.lit("q"), F.concat(F.lit("  "), F.regexp_replace(text, " ", "  ")), F.lit("country"), F.lit(" de"), F.lit("limit"), F.lit("5"))
    extra = F.create_map(F.lit("q"), text, F.lit("country"), F.lit("DE"), F.lit("utm"), F.lit("x"), F.lit("type"), F.lit("any"), F.lit("language"), F.lit("EN"))
    spelled = F.array(*[F.struct(F.lit(n).alias("spelling"), F.lit(e).alias("endpoint"), m.alias("params"))
                        for n, e, m in (("plain", "/api/places", plain), ("spaced", "/api/maps", spaced), ("extra", "/api/places", extra))])
    rows = table(spark, folder, "benchmark").select("item_id", F.explode(spelled).alias("s"))
    return rows.select("item_id", "s.spelling", cachelog.key_digest(cachelog.cache_key(F.col("s.endpoint"), F.col("s.params"))).alias("key"))


RESULT_SQL = """res as (select event_id, 'https://s' || user_id || '.example.com/' || event_id as url,
  case event_type when 'error' then 'source_error' when 'signup' then 'rejected_target' else 'success' end as outcome, cast(floor(value * 100) as bigint) as duration_ms,
  case event_type when 'error' then ['timeout','upstream_error'][(event_id % 2) + 1] when 'signup' then 'unsafe_url' end as error_code,
  case when event_type in ('error', 'signup') then 'status ' || (event_id % 7) end as error_message from events)"""


def results(spark, folder):
    """events as crawl results."""
    failed = F.col("event_type") == "error"
    rejected = F.col("event_type") == "signup"
    code = F.element_at(F.array(F.lit("timeout"), F.lit("upstream_error")), (F.col("event_id") % 2 + 1).cast("int"))
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("https://s"), "user_id", F.lit(".example.com/"), "event_id").alias("url"),
        F.when(failed, "source_error").when(rejected, "rejected_target").otherwise("success").alias("outcome"),
        F.floor(F.col("value") * 100).cast("long").alias("duration_ms"), F.when(failed, code).when(rejected, "unsafe_url").alias("error_code"),
        F.when(failed | rejected, F.concat(F.lit("status "), F.col("event_id") % 7)).alias("error_message"))


@query(f"""with {RESULT_SQL}, v as (select duration_ms, case event_id % 50 when 7 then 'invalid_response' when 8 then 'transport_error' else outcome end as outcome,
  case when event_id % 2 = 0 then 'shop' || event_id % 9 || '.co.uk' else 'site' || event_id % 11 || '.com' end as site from res),
d as (select duration_ms, row_number() over (order by duration_ms) - 1 as i, count(*) over () as n from v),
t as (select count(*) as attempted, count_if(outcome <> 'rejected_target')::bigint as evaluated, count_if(outcome = 'success')::bigint as successes,
  count_if(outcome = 'success') / count_if(outcome <> 'rejected_target') as success_rate, count(distinct site) as distinct_sites, max(duration_ms) as maximum,
  count(*) >= 100 as attempted_ok, count_if(outcome = 'success') / count_if(outcome <> 'rejected_target') >= 0.6 as rate_ok, count_if(outcome = 'invalid_response') = 0 as no_invalid,
  count_if(outcome = 'transport_error') = 0 as no_transport, count_if(outcome = 'rate_limited') = 0 as no_limited from v)
select *, (select max(case when i = cast(floor(n * 0.5) as bigint) then duration_ms end) from d) as p50, (select max(case when i = cast(floor(n * 0.95) as bigint) then duration_ms end) from d) as p95,
  attempted_ok and rate_ok and no_invalid and no_transport and no_limited as passed from t""")
def smoke_report(spark, folder):
    """One crawl-quality report over sites of two and three labels, with answers that fail a gate."""
    n = F.col("event_id")
    site = F.when(n % 2 == 0, F.concat(F.lit("a.shop"), n % 9, F.lit(".co.uk"))).otherwise(F.concat(F.lit("b.site"), n % 11, F.lit(".com")))
    rows = results(spark, folder).withColumn("url", F.concat(F.lit("https://"), site, F.lit("/"), n)).withColumn(
        "outcome", F.when(n % 50 == 7, "invalid_response").when(n % 50 == 8, "transport_error").otherwise(F.col("outcome")))
    return reports.smoke_report(rows, 100)


@query(f"with {RESULT_SQL} select error_code, error_message, count(*) as n from res where error_code is not null group by all")
def error_groups(spark, folder):
    """Failures by code and message."""
    return reports.error_groups(results(spark, folder))


@query(f"""with {RESULT_SQL}, r as (select event_id, outcome, duration_ms from res where outcome = 'source_error' and error_code = 'timeout')
select event_id, case when r.event_id is not null and event_id % 4 = 1 then 'success' else res.outcome end as outcome, case when r.event_id is not null then 5 else res.duration_ms end::bigint as duration_ms,
  r.event_id is not null as retried from res left join r using (event_id)""".replace("r as (select event_id, outcome, duration_ms from res where", "r as (select event_id from res where"))
def retry_merge(spark, folder):
    """Timed-out rows are replaced by their second try."""
    rows = results(spark, folder).select("event_id", "outcome", "duration_ms", "error_code")
    again = rows.filter(F.col("error_code") == "timeout").select(
        "event_id", F.when(F.col("event_id") % 4 == 1, "success").otherwise(F.col("outcome")).alias("outcome"), F.lit(5).cast("long").alias("duration_ms"))
    return joins.replace_retried(rows.drop("error_code"), again, "event_id")


@query(f"""with {RESULT_SQL}, ok as (select url, duration_ms from res where outcome = 'success')
select arg_min(url, (duration_ms, url)) as url, min(duration_ms) as duration_ms from ok""")
def fastest_probe(spark, folder):
    """The quickest success."""
    return reports.fastest_success(results(spark, folder))


@query("""with c as (select case when event_type = 'view' then null else ts end as published_at, event_id, case when event_id % 3 = 0 then (event_id % 20 + 1) || ' hours ago' end as shown from events),
k as (select * from c where published_at >= timestamp '2024-01-30 00:00:00' - interval 7 day)
select event_id, row_number() over (order by published_at desc, event_id) as pos from k qualify pos <= 100""")
def recency_filter(spark, folder):
    """The hundred newest of the last week; undated rows are dropped."""
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp")
    rows = table(spark, folder, "events").select(
        F.when(F.col("event_type") != "view", F.col("ts")).alias("published_at"), "event_id",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id") % 20 + 1, F.lit(" hours ago"))).alias("shown"), F.lit("all").alias("feed"))
    fresh = search.filter_recent(rows, as_of, "7d")
    return top_k(fresh, ["feed"], [F.col("published_at").desc(), F.col("event_id")], 100, "pos").select("event_id", "pos")


@query("""with c as (select event_id, user_id, case when event_type = 'view' then null else greatest(epoch_ms(timestamp '2024-01-20 00:00:00') - epoch_ms(ts), 0)::double end as dated,
  case when event_id % 3 = 0 then (event_id % 20 + 1) * 3600000.0::double end as shown from events)
select user_id, event_id, row_number() over (partition by user_id order by coalesce(dated, shown) asc nulls last, event_id) as pos from c qualify pos <= 5""")
def newest_first(spark, folder):
    """By date, else by displayed age; rows without either come last."""
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    rows = table(spark, folder, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("published_at"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id") % 20 + 1, F.lit(" hours ago"))).alias("shown"))
    order = search.newest_first(F.col("published_at"), F.col("shown"), F.col("event_id"), as_of)
    return top_k(rows, ["user_id"], order, 5, "pos").select("user_id", "event_id", "pos")


@query("""with p as (select d.doc_id, d.source, d.lang, case when l.quality = 1 then d.lang end as a, case when l.toxic = 0 then case when d.doc_id % 5 = 0 then d.lang || ' text' when d.doc_id % 7 = 0 then 'xx' else upper(d.lang) end end as b
  from documents d join labels l using (doc_id))
select source, count(*) as rows, floor(avg(case when a is not null then 1.0 else 0.0 end) * 10000 + 0.5) / 10000 as a_rate, floor(avg(case when b is not null then 1.0 else 0.0 end) * 10000 + 0.5) / 10000 as b_rate,
  count_if(a is not null and b is not null)::bigint as compared, floor(count_if(a is not null and b is not null and (contains(lower(b), lower(a)) or contains(lower(a), lower(b)))) / greatest(count_if(a is not null and b is not null), 1) * 10000 + 0.5) / 10000 as rate
from p group by source having count_if(a is not null and b is not null) > 0""")
def coverage_agreement(spark, folder):
    """Coverage of two readings and how often they agree."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    labels = table(spark, folder, "labels")
    b = F.when(F.col("doc_id") % 5 == 0, F.concat("lang", F.lit(" text"))).when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.upper("lang"))
    pairs = docs.join(labels, "doc_id").select("doc_id", "source", F.when(F.col("quality") == 1, F.col("lang")).alias("a"), F.when(F.col("toxic") == 0, b).alias("b"))
    return reports.coverage(pairs, ["a", "b"], ["source"]).join(reports.agreement(pairs, "a", "b", ["source"]), "source")


@query("""select d.doc_id, l.doc_id is not null and l.quality = 1 as a, d.n_chars >= 400 as b from documents d join labels l using (doc_id) where (l.quality = 1) <> (d.n_chars >= 400)""")
def disagreement_rows(spark, folder):
    """Documents two checks judge differently."""
    pairs = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") >= 400).alias("b")).join(
        table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("a")), "doc_id")
    return reports.disagreements(pairs, "a", "b")


@query("""with d as (select doc_id, lang as v from documents where doc_id % 3 <> 0), l as (select doc_id, cast(quality as varchar) as v from labels)
select coalesce(d.doc_id, l.doc_id) as doc_id, coalesce(d.v, l.v) as v from d full outer join l on d.doc_id = l.doc_id""")
def safe_merge(spark, folder):
    """The first reading wins, the second fills gaps."""
    first = table(spark, folder, "documents").filter(F.col("doc_id") % 3 != 0).select("doc_id", F.col("lang").alias("v"))
    second = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("v"))
    return joins.safe_merge(first, second, ["doc_id"], ["v"])


def summary_sql() -> str:
    from factloom.plans.page_queries import noise_sql

    r4 = "floor({0} * 10000 + 0.5) / 10000"
    return f"""r as (select source, n_chars >= 200 as success, case when doc_id % 3 > 0 then 't' end as title, case when doc_id % 4 = 0 then 'a' end as author,
  case when lang = 'en' then 'd' end as published_at, {noise_sql('text')} as noise, cast(len(regexp_extract_all(text, '[^\\s\\x{{A0}}]+')) as bigint) as word_count, n_chars as duration_ms from documents),
n as (select *, row_number() over (partition by source order by duration_ms) - 1 as i, count(*) over (partition by source) as c,
  row_number() over (partition by source, success order by word_count) - 1 as wi, count(*) over (partition by source, success) as wc from r),
s as (select source, count_if(success)::bigint as successes, {r4.format('count_if(success) / count(*)')} as success_rate,
  {r4.format('count_if(success and title is not null) / greatest(count_if(success), 1)')} as title_rate, {r4.format('count_if(success and author is not null) / greatest(count_if(success), 1)')} as author_rate,
  {r4.format('count_if(success and published_at is not null) / greatest(count_if(success), 1)')} as published_at_rate,
  floor(cast(coalesce(sum(case when success then cast(noise as decimal(18,2)) end), 0) as double) / greatest(count_if(success), 1) * 100 + 0.5) / 100 as noise,
  coalesce(max(case when success and wi = least(wc - 1, cast(floor(wc * 0.5) as bigint)) then word_count end), 0) as median_words,
  max(case when i = least(c - 1, cast(floor(c * 0.5) as bigint)) then duration_ms end) as p50, max(case when i = least(c - 1, cast(floor(c * 0.95) as bigint)) then duration_ms end) as p95 from n group by source)"""


@query(f"""with {summary_sql()}, f as (select *, greatest(0.01, min(case when p50 > 0 then p50 end) over ()) as fastest from s),
z as (select *, floor((success_rate * 60 + greatest(0.0, 15 - noise) + title_rate * 8 + author_rate * 5 + published_at_rate * 7 + fastest / greatest(fastest, case when p50 > 0 then p50 else fastest end) * 5) * 100 + 0.5) / 100 as score from f)
select source, successes, success_rate, title_rate, author_rate, published_at_rate, noise, median_words, p50, p95, score, score = max(score) over () as winner from z""")
def composite_score(spark, folder):
    """Every source judged like an implementation."""
    from factloom.functions import text as T

    docs = table(spark, folder, "documents")
    rows = docs.select(
        "source", (F.col("n_chars") >= 200).alias("success"), F.when(F.col("doc_id") % 3 > 0, "t").alias("title"), F.when(F.col("doc_id") % 4 == 0, "a").alias("author"),
        F.when(F.col("lang") == "en", "d").alias("published_at"), T.noise_per_thousand(F.col("text")).alias("noise"),
        T.blank_separated_words(F.col("text")).alias("word_count"), F.col("n_chars").alias("duration_ms"))
    return reports.composite_score(reports.implementation_summary(rows, "source"))


# Band ends in tenths of the list, and how many of twenty domains each gives.
SAMPLE_TENTHS, SAMPLE_WEIGHTS = (1, 3, 6, 10), (0.4, 0.3, 0.2, 0.1)
SLOTS_SQL = """b as (select o, w, n * a // 10 + 1 as lo, greatest(1, (n * e // 10 - n * a // 10) // w) as st from (select count(*) as n from customer),
  (values (0, 8, 0, 1), (8, 6, 1, 3), (14, 4, 3, 6), (18, 2, 6, 10)) x(o, w, a, e)),
slots as (select o + k as slot, lo + st // 2 + k * st as lo, lo + st // 2 + k * st + st - 1 as hi from b, range(20) r(k) where k < w)"""


@query(f"""with recursive d as (select c_custkey + 1 as rank, case when c_custkey % 13 = 0 then '-bad' else 'shop' || (c_custkey % 97) end || '.com' as domain from customer),
{SLOTS_SQL}, ok as (select * from d where domain not like '-%'),
fold as (select -1 as slot, cast([] as varchar[]) as seen, cast(null as bigint) as rank, cast(null as varchar) as domain
  union all
  select s.slot, case when c.domain is null then f.seen else list_append(f.seen, c.domain) end, c.rank, c.domain from fold f join slots s on s.slot = f.slot + 1
  left join lateral (select min(rank) as rank, arg_min(domain, rank) as domain from ok where ok.rank between s.lo and s.hi and not list_contains(f.seen, ok.domain)) c on true)
select cast(slot as bigint) as slot, rank, domain, domain as site from fold where domain is not null""")
def stratified_sample(spark, folder):
    """Twenty domains of distinct sites over four rank bands of 10, 20, 30 and 40 % of the list."""
    key = F.col("c_custkey")
    name = F.when(key % 13 == 0, F.lit("-bad")).otherwise(F.concat(F.lit("shop"), key % 97))
    domains = table(spark, folder, "customer").select((key + 1).alias("rank"), F.concat(name, F.lit(".com")).alias("domain"))
    n = domains.count()
    ends = [n * t // 10 for t in SAMPLE_TENTHS]
    bands = [(a + 1, b, w) for a, b, w in zip([0, *ends], ends, SAMPLE_WEIGHTS)]
    return reports.stratified_sample(domains, 20, bands)


@query("""select 'stride' as sample, cast(c_custkey as varchar) as target from customer where c_custkey % 50 = 25 union all
select 'first', c_name from (select distinct c_name from customer order by c_name limit 10) union all select 'second', s_name from (select distinct s_name from supplier order by s_name limit 11)""")
def stride_and_mixed_sample(spark, folder):
    """A fixed stride, and half of a sample from each of two corpora."""
    c = table(spark, folder, "customer")
    stride = reports.stride_sample(c, "c_custkey", 50).select(F.lit("stride").alias("sample"), F.col("c_custkey").cast("string").alias("target"))
    mixed = reports.mixed_sample(c.select(F.col("c_name").alias("t")), table(spark, folder, "supplier").select(F.col("s_name").alias("t")), "t", 21)
    return stride.unionByName(mixed.select(F.col("corpus").alias("sample"), F.col("t").alias("target")))


@query("""with t as (select user_id as id, min(ts) as created, max(ts) as seen, max(value) as top, count(*) as n from events where event_type = 'view' group by user_id),
c as (select user_id as id, min(ts) as created, max(ts) as seen, max(value) as top, count(*) as n from events where event_type = 'click' group by user_id)
select coalesce(t.id, c.id) as id, epoch_us(coalesce(t.created, c.created)) as created_us, epoch_us(greatest(t.seen, c.seen)) as seen_us, greatest(t.top, c.top) as top, coalesce(t.n, 0) + coalesce(c.n, 0) as n
from t full outer join c on t.id = c.id""")
def keyed_upsert(spark, folder):
    """A keyed table merged with its changes, one rule per column."""
    def totals(kind):
        rows = table(spark, folder, "events").filter(F.col("event_type") == kind)
        return rows.groupBy(F.col("user_id").alias("id")).agg(
            F.min("ts").alias("created"), F.max("ts").alias("seen"), F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))

    merged = joins.upsert(totals("view"), totals("click"), ["id"], {"created": "first", "seen": "max", "top": "max", "n": "sum"}, "seen")
    return merged.select("id", F.unix_micros("created").alias("created_us"), F.unix_micros("seen").alias("seen_us"), "top", "n")


@query("""select status, case when status between 200 and 299 then null when status in (404, 410) then 'not_found' when status in (401, 403, 451) then 'source_blocked' else 'upstream_error' end as code,
  count(*) as n from (select [200, 301, 401, 403, 404, 410, 418, 429, 451, 500, 503][(event_id % 11) + 1] as status from events) group by all""")
def status_classes(spark, folder):
    """Error class per response status."""
    from factloom.operators.pages import classify_status

    status = F.element_at(F.array(*[F.lit(s) for s in (200, 301, 401, 403, 404, 410, 418, 429, 451, 500, 503)]), (F.col("event_id") % 11 + 1).cast("int"))
    rows = table(spark, folder, "events").select(status.alias("status"))
    return rows.groupBy("status", classify_status(F.col("status"))["code"].alias("code")).agg(F.count(F.lit(1)).alias("n"))
