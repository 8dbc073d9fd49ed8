"""Ledger, balances, alerts, quotas, limits, streaks and payment reversals as batch jobs.

Accounts and clients may be very uneven, so sums are pre-aggregated, running values use chunked scans and
ordered decisions are made on one row per reservation or attempt.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions import ids
from factloom.operators.ordered import fold_in_order, highest_before, keep_first, running, time_chunk, top_k, trailing_count

# Prices, grants, limits and periods.
CENTS_PER_THOUSAND = 49
MIN_PURCHASE_CENTS, MAX_PURCHASE_CENTS = 1_000, 490_000
DAILY_LIMIT = 10
WELCOME_CREDITS = 1_000
MAX_ACTIVE_KEYS = 2
RESERVATION_SECONDS = 15 * 60
ALERT_THRESHOLDS = (80, 90, 100)
RETRY_SECONDS = 3 * 86_400
MAX_FAILURES = 3
HARD_DECLINES = (
    "STOLEN_CARD", "DO_NOT_HONOR", "FRAUDULENT", "PICKUP_CARD", "AUTHENTICATION_FAILURE", "LOST_CARD",
)
DAY = 86_400


def credits_for_amount(cents: Column) -> Column:
    """Whole credits for a valid purchase, else null."""
    return F.when(valid_purchase(cents), F.floor(cents.cast("long") * 1000 / CENTS_PER_THOUSAND).cast("long"))


def valid_purchase(cents: Column) -> Column:
    return F.coalesce(cents.between(MIN_PURCHASE_CENTS, MAX_PURCHASE_CENTS) & (cents == F.floor(cents)), F.lit(False))


def valid_auto_funding(trigger: Column, amount: Column, cap: Column) -> Column:
    most = MAX_PURCHASE_CENTS * 1000 // CENTS_PER_THOUSAND
    return F.coalesce(
        trigger.between(0, most) & valid_purchase(amount) & (cap >= amount) & (cap <= MAX_PURCHASE_CENTS), F.lit(False))


def net_credits(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.groupBy(key).agg(F.coalesce(F.sum("credits"), F.lit(0)).cast("long").alias("net_credits"))


def usage_in_days(reservations: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Committed reservations per account that were completed in the last days."""
    recent = (F.col("state") == "committed") & (F.col("completed_at") >= as_of - F.make_interval(days=F.lit(days)))
    return reservations.groupBy("account").agg(F.count_if(F.coalesce(recent, F.lit(False))).alias("usage"))


def cycle_usage(commits: DataFrame, cycles: DataFrame) -> DataFrame:
    """Commits inside the current billing cycle; open ends are unbounded and accounts without a cycle count none."""
    inside = (
        F.col("cycle_key").isNotNull()
        & (F.col("cycle_started_at").isNull() | (F.col("cycle_started_at") <= F.col("ts")))
        & (F.col("cycle_ends_at").isNull() | (F.col("cycle_ends_at") >= F.col("ts")))
    )
    return commits.join(cycles, "account", "left").groupBy("account").agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("cycle_used"))


def quota_status(reservations: DataFrame, keys: Sequence[str], limit: int = DAILY_LIMIT) -> DataFrame:
    used = F.count_if(F.col("state").isin("reserved", "committed"))
    return reservations.groupBy(*keys).agg(used.alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def is_stale(now: Column) -> Column:
    return (F.col("state") == "reserved") & (F.col("created_at") < now - F.expr(f"INTERVAL {RESERVATION_SECONDS} SECONDS"))


def expire_stale(reservations: DataFrame, now: Column) -> DataFrame:
    """Open reservations past their time become `stale_refunded`; only paid ones return a credit."""
    stale = is_stale(now)
    return reservations.withColumn("credit_returned", F.when(stale & (F.col("meter_kind") == "paid"), 1).otherwise(0).cast("long")).withColumn(
        "completed_at", F.when(stale, now).otherwise(F.col("completed_at"))
    ).withColumn("state", F.when(stale, F.lit("stale_refunded")).otherwise(F.col("state")))


def stale_counts(reservations: DataFrame, now: Column) -> DataFrame:
    stale = is_stale(now)
    return reservations.groupBy("account").agg(
        F.count_if(stale).alias("stale_all"), F.count_if(stale & (F.col("meter_kind") == "paid")).alias("stale_paid"))


def running_balance(events: DataFrame, keys: Sequence[str] = ("account",), chunk_seconds: int = DAY) -> DataFrame:
    """Adds the balance after every event; it may become negative."""
    return running(events, list(keys), [F.col("ts"), F.col("seq")], time_chunk(F.col("ts"), chunk_seconds), sums={"balance": F.col("credits")})


def funding_epochs(events: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """Adds balance, epoch (grants so far), basis (balance at the last grant, not below zero) and used credits."""
    order = [F.col("ts"), F.col("seq")]
    chunk = time_chunk(F.col("ts"), chunk_seconds)
    is_grant = F.col("kind") == "grant"
    based = running(events, ["account"], order, chunk, sums={"balance": F.col("credits"), "epoch": is_grant.cast("long")}, marks={"basis": ("balance", is_grant)})
    return based.withColumn("basis", F.greatest(F.coalesce("basis", F.lit(0)), F.lit(0))).withColumn(
        "used", F.greatest(F.col("basis") - F.col("balance"), F.lit(0)))


def usage_alerts(events: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """Each threshold once per funding epoch, in ascending order and at most one per commit.

    A threshold is told by the first commit that reaches it after the one before was told. Whatever reaches a threshold reaches
    those below, so of all commits of an epoch the first k that reach the k-th threshold decide; tasks keep no more before the shuffle.
    """
    commits = funding_epochs(events, chunk_seconds).filter((F.col("kind") == "commit") & (F.col("basis") > 0))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("percent")) for i, p in enumerate(ALERT_THRESHOLDS)])
    reached = commits.withColumn("_t", F.explode(F.filter(steps, lambda s: F.col("used") * 100 >= s["percent"] * F.col("basis"))))
    first = Window.partitionBy("account", "epoch", "_t").orderBy("ts", "seq")
    few = reached.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= len(ALERT_THRESHOLDS)).select("account", "epoch", "_t.i", F.struct("ts", "seq").alias("at"))
    lists = few.groupBy("account", "epoch").agg(*[F.sort_array(F.collect_list(F.when(F.col("i") == i, F.col("at")))).alias(f"_a{i}") for i in range(len(ALERT_THRESHOLDS))])
    for i in range(len(ALERT_THRESHOLDS)):
        lists = lists.withColumn(f"_p{i}", _after(F.col(f"_a{i}"), F.col(f"_p{i - 1}")) if i else F.get(F.col("_a0"), F.lit(0)))
    told = lists.select("account", "epoch", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"_p{i}").isNotNull(), F.struct(F.lit(p).cast("long").alias("percent"), F.col(f"_p{i}").alias("at"))) for i, p in enumerate(ALERT_THRESHOLDS)]))).alias("s"))
    found = told.select("account", "epoch", "s.percent", "s.at.ts", "s.at.seq")
    return found.withColumn("alert_id", ids.alert_id(F.col("account"), F.col("epoch"), F.col("percent")))


def _after(positions: Column, before: Column) -> Column:
    """The first of the sorted positions behind another one; null without that."""
    return F.when(before.isNotNull(), F.get(F.filter(positions, lambda x: x > before), F.lit(0)))


def reservation_intervals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per reservation: its start and the time its slot becomes free (null when it stays used).

    Repeated deliveries collapse here, before anything is ordered. A reservation that is neither committed
    nor refunded within its time frees the slot when the time is over.
    """
    starts = F.min(F.when(F.col("kind") == "reserve", F.col("ts")))
    position = F.when(F.col("kind").isin("commit", "refund"), F.col("ts"))
    grouped = events.groupBy(*keys, "reservation_id").agg(
        starts.alias("start"), F.min(position).alias("_done_at"),
        F.min_by("kind", position).alias("_done"),
    ).filter(F.col("start").isNotNull())
    expiry = F.col("start") + F.expr(f"INTERVAL {RESERVATION_SECONDS} SECONDS")
    in_time = F.col("_done_at").isNotNull() & (F.col("_done_at") <= expiry)
    free_at = F.when(in_time & (F.col("_done") == "commit"), F.lit(None)).when(in_time, F.col("_done_at")).otherwise(expiry)
    return grouped.select(*keys, "reservation_id", "start", free_at.alias("free_at"))


def admit(live: list, start, free_at, limit: int) -> bool:
    """Whether a slot is free at `start`; `live` holds the times at which taken slots become free (None: never)."""
    live[:] = [f for f in live if f is None or f > start]
    admitted = len(live) < limit
    if admitted:
        live.append(None if pd.isna(free_at) else free_at)
    return admitted


def daily_admission(events: DataFrame, limit: int = DAILY_LIMIT, part_seconds: int = 3600) -> DataFrame:
    """Which reservations of a client and UTC day are admitted when refunds and expiries free slots.

    Where a reservation starts after all earlier ones are free again, a busy period begins: nothing is held over into it but the slots used up
    for good, at most `limit`. So the busy periods that begin in one hour are folded on their own, once for every number of
    slots that may be gone before; the hours of a day are then chained by those numbers, and the one fold that applies decides. A task holds
    one hour of one client, or a busy period that is longer.
    """
    keys, hour = ["day", "client"], F.floor(F.unix_micros("start") / (part_seconds * 1_000_000))
    order = [F.col("start"), F.col("reservation_id")]
    rows = reservation_intervals(events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), keys)
    held = highest_before(rows, keys, order, hour, F.col("free_at"), "_held")
    begins = F.col("_held").isNull() | (F.col("start") >= F.col("_held"))
    parts = running(held, keys, order, hour, lasts={"_part": F.when(begins, hour)}).drop("_held")

    def outcomes(states: list[list], row: tuple) -> list[int]:
        for live in states:
            admit(live, row[at["start"]], row[at["free_at"]], limit)
        return [sum(f is None for f in live) for live in states]

    at = {c: i for i, c in enumerate(parts.columns)}
    order_names = ["start", "reservation_id"]
    tried = fold_in_order(parts, [*keys, "_part"], order_names, lambda: [[None] * k for k in range(limit + 1)], outcomes, "_used", "array<int>")
    maps = tried.groupBy(*keys, "_part").agg(F.max_by("_used", F.struct(*order_names)).alias("_used"))
    # A day has no more parts than hours.
    days = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_part", "_used"))).alias("_parts"))
    chained = F.aggregate("_parts", F.struct(F.lit(0).alias("k"), F.array().cast("array<struct<_part:bigint,_before:int>>").alias("out")), lambda s, p: F.struct(
        F.element_at(p["_used"], s["k"] + 1).alias("k"), F.concat(s["out"], F.array(F.struct(p["_part"].alias("_part"), s["k"].alias("_before")))).alias("out")))
    before = days.select(F.struct(*keys).alias("_key"), F.explode(chained["out"]).alias("_b")).select("_key", "_b._part", "_b._before")
    known = parts.withColumn("_key", F.struct(*keys)).join(before, ["_key", "_part"]).drop("_key").select(*parts.columns, "_before")

    def decide(state: dict, row: tuple) -> bool:
        live = state.setdefault("live", [None] * row[len(at)])
        return admit(live, row[at["start"]], row[at["free_at"]], limit)

    return fold_in_order(known, [*keys, "_part"], order_names, dict, decide, "admitted", "boolean").drop("start", "free_at", "_part", "_before")


def simple_admission(requests: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """The first `limit` requests of a client and UTC day, for logs without refunds."""
    return top_k(requests, ["day", "client"], [F.col("ts"), F.col("seq")], limit, "slot")


def rate_limit_fixed(requests: DataFrame, limit: int, seconds: int = 60, client: str = "client") -> DataFrame:
    """Requests, admitted and rejected per client and fixed window."""
    counted = requests.groupBy(client, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(
        client, F.col("w.start").alias("window_start"), "requests", F.least(F.col("requests"), F.lit(limit)).alias("admitted"),
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


def rate_limit_trailing(requests: DataFrame, limit: int, seconds: int = 60, client: str = "client") -> DataFrame:
    """Adds the requests of the span that ends at each request, and whether they exceed the limit."""
    return trailing_count(requests, [client], "ts", seconds, "in_window").withColumn("limited", F.col("in_window") > limit)


def charge(state: dict, kind: str, ref: str, amount: int, cap: int) -> str:
    """Outcome of one funding step: one pending charge at a time, spend of the month within the cap."""
    pending = state.get("pending")
    if kind == "reserve":
        if pending:
            return "idempotent" if pending[0] == ref else "charge_pending"
        if state.get("spent", 0) + amount > cap:
            return "monthly_limit"
        state["pending"] = (ref, amount)
        return "reserved"
    if not pending:
        return "idempotent"
    if pending[0] != ref:
        return "different_charge_pending"
    state["pending"] = None
    if kind == "commit":
        state["spent"] = state.get("spent", 0) + pending[1]
    return "committed" if kind == "commit" else "released"


def funding_attempts(events: DataFrame, cap_cents: int) -> DataFrame:
    """Outcomes of auto-funding steps (reserve, commit, release) per account and month.

    Columns: account, period, seq, ts, kind, attempt_id, amount_cents.
    """
    rows = events.select("account", "period", "seq", "ts", "kind", "attempt_id", "amount_cents")
    return fold_in_order(
        rows, ["account", "period"], ["ts", "seq"], dict,
        lambda state, row: charge(state, row[4], row[5], row[6], cap_cents), "outcome", "string",
    ).select("account", "period", "seq", "kind", "outcome")


def monthly_spend(charges: DataFrame, cap_cents: int, chunk_seconds: int = DAY) -> DataFrame:
    """Adds running spend per account and month and whether it is still within the cap."""
    rows = charges.withColumn("period", F.date_format("ts", "yyyy-MM"))
    spent = running(rows, ["account", "period"], [F.col("ts"), F.col("seq")], time_chunk(F.col("ts"), chunk_seconds), sums={"spent_cents": F.col("amount_cents")})
    return spent.withColumn("within_cap", F.col("spent_cents") <= cap_cents)


def failure_streaks(attempts: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """Adds the failures in a row up to each attempt and what follows: stop, retry later or go on.

    Columns: account, seq, ts, failed, error_code.
    """
    order, chunk = [F.col("ts"), F.col("seq")], time_chunk(F.col("ts"), chunk_seconds)
    reset = running(attempts, ["account"], order, chunk, sums={"_failures": F.col("failed").cast("long")}, marks={"_base": ("_failures", ~F.col("failed"))})
    streak = F.when(F.col("failed"), F.col("_failures") - F.coalesce("_base", F.lit(0))).otherwise(0)
    hard = F.upper(F.coalesce("error_code", F.lit(""))).isin(*HARD_DECLINES)
    stop = F.col("failed") & (hard | (F.col("streak") >= MAX_FAILURES))
    return reset.withColumn("streak", streak.cast("long")).withColumn(
        "status", F.when(stop, "requires_attention").when(F.col("failed"), "retry_wait").otherwise("active")
    ).withColumn(
        "next_retry_at", F.when(F.col("status") == "retry_wait", F.col("ts") + F.expr(f"INTERVAL {RETRY_SECONDS} SECONDS"))
    ).drop("_failures", "_base")


def reversal_state(events: DataFrame) -> DataFrame:
    """State per payment: its grant, whether a refund is final or a dispute open, and the credits left.

    Columns: payment_ref, event_id, kind (grant, refund, dispute_opened, dispute_won), ts, account, credits. A refund is
    final. Of the disputes before a refund the latest counts, so arrival order does not matter. Without a
    grant the reversal is pending.
    """
    at = F.struct("ts", "event_id")
    when = lambda kind, value: F.when(F.col("kind") == kind, value)
    dispute = F.col("kind").isin("dispute_opened", "dispute_won")
    state = events.groupBy("payment_ref").agg(
        F.min_by(F.struct("account", "credits"), when("grant", at)).alias("_grant"),
        F.max(F.col("kind") == "refund").alias("refund_final"),
        F.max_by("kind", F.when(dispute, at)).alias("_last_dispute"),
        F.max(F.when(dispute, F.col("ts"))).alias("last_dispute_at"),
    )
    active = ~F.col("refund_final") & F.coalesce(F.col("_last_dispute") == "dispute_opened", F.lit(False))
    granted = F.col("_grant.credits")
    reversed_now = F.col("refund_final") | active
    return state.select(
        "payment_ref", F.col("_grant.account").alias("account"), granted.alias("granted"), "refund_final",
        active.alias("dispute_active"), "last_dispute_at",
        F.when(granted.isNull(), F.lit(0)).when(reversed_now, F.lit(0)).otherwise(granted).cast("long").alias("net_credits"),
        (granted.isNull() & reversed_now).alias("pending"),
    )


def reversal_rows(events: DataFrame) -> DataFrame:
    """Ledger rows of every payment's reversals, from its transitions in order; each row can be booked once.

    A dispute that is open when the grant comes, or opens later, takes the grant back; a refund does, too, unless a
    dispute has done so before. A dispute won gives back what the dispute took, unless a refund came in between.
    """
    at = F.struct("ts", "event_id")
    when = lambda kind, value: F.when(F.col("kind") == kind, value)
    known = events.groupBy("payment_ref").agg(
        F.min(when("grant", at)).alias("g"), F.min_by(F.struct("account", "credits"), when("grant", at)).alias("_grant"),
        F.min(when("refund", at)).alias("r")).filter(F.col("g").isNotNull())
    rows = events.filter(F.col("kind").isin("dispute_opened", "dispute_won")).select("payment_ref", "kind", at.alias("at"))
    both = known.join(rows, "payment_ref", "left")
    opened = both.groupBy("payment_ref").agg(
        F.first("_grant").alias("_grant"), F.first("g").alias("g"), F.first("r").alias("r"),
        F.max_by("kind", F.when(F.col("at") < F.col("g"), F.col("at"))).alias("_before"),
        F.min(F.when((F.col("at") > F.col("g")) & (F.col("kind") == "dispute_opened"), F.col("at"))).alias("_after"))
    taken = F.when(F.col("_before") == "dispute_opened", F.col("g")).otherwise(F.col("_after"))
    disputed = opened.withColumn("d", F.when(F.col("r").isNull() | (F.col("r") > taken), taken))
    won = disputed.join(rows.filter(F.col("kind") == "dispute_won"), "payment_ref", "left").groupBy("payment_ref").agg(
        F.first("_grant").alias("_grant"), F.first("r").alias("r"), F.first("d").alias("d"), F.min(F.when(F.col("at") > F.col("d"), F.col("at"))).alias("w"))
    restored = F.col("w").isNotNull() & (F.col("r").isNull() | (F.col("r") > F.col("w")))
    refunded = F.col("r").isNotNull() & (F.col("d").isNull() | restored)
    ref, back = F.col("payment_ref"), F.col("_grant.credits")
    entry = lambda test, kind, credits, external: F.when(test, F.struct(F.lit(kind).alias("kind"), credits.alias("credits"), external.alias("external_ref")))
    entries = F.array_compact(F.array(
        entry(F.col("d").isNotNull(), "dispute", -back, ids.reversal_ref(F.lit("dispute"), ref)),
        entry(restored, "dispute_reversed", back, ids.restore_ref(ref)), entry(refunded, "refund", -back, ids.reversal_ref(F.lit("refund"), ref))))
    return won.select("payment_ref", F.col("_grant.account").alias("user_id"), F.explode(entries).alias("e")).select(
        ids.ledger_id(F.col("e.external_ref")).alias("id"), "user_id", "e.kind", "e.credits", "payment_ref", "e.external_ref")


def resolve_account(events: DataFrame, accounts: DataFrame, intents: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Adds user_id: the given one, else by customer, subscription, checkout or authorization reference."""
    by = lambda table, ref, name: table.filter(F.col(ref).isNotNull()).select(ref, F.col("user_id").alias(name))
    return (
        events.withColumnRenamed("user_id", "_given")
        .join(by(accounts, "customer_ref", "_c"), "customer_ref", "left")
        .join(by(accounts, "subscription_ref", "_s"), "subscription_ref", "left")
        .join(by(intents, "checkout_ref", "_i"), "checkout_ref", "left")
        .join(by(authorizations, "checkout_ref", "_a"), "checkout_ref", "left")
        .withColumn("user_id", F.coalesce("_given", "_c", "_s", "_i", "_a"))
        .drop("_given", "_c", "_s", "_i", "_a")
    )


def match_intents(payments: DataFrame, intents: DataFrame, key: str, fields: Sequence[str] = ("user_id", "amount_cents", "credits")) -> DataFrame:
    """Payments with `matched`: the intent exists and agrees in every field."""
    known = intents.select(key, F.struct(*fields).alias("_intent"))
    agrees = F.col("_intent").isNotNull()
    for f in fields:
        agrees = agrees & F.col(f).eqNullSafe(F.col("_intent")[f])
    return payments.join(known, key, "left").withColumn("matched", agrees).drop("_intent")


def funding_eligibility(settings: DataFrame, accounts: DataFrame, balances: DataFrame, now_ms: Column) -> DataFrame:
    """Reason why an account is not charged now, or `eligible`; the first failing check decides."""
    joined = settings.join(accounts.select("user_id", "subscription_ref", "subscription_status"), "user_id").join(balances, "user_id", "left")
    reason = (
        F.when(F.col("enabled") != 1, "disabled").when(F.col("subscription_ref").isNull(), "no_mandate")
        .when(~F.coalesce(F.col("subscription_status").isin("active", "on_hold"), F.lit(False)), "mandate_inactive")
        .when(F.col("next_retry_at") > now_ms, "retry_wait").when(F.col("balance") > F.col("trigger_credits"), "above_trigger")
        .otherwise("eligible")
    )
    return joined.withColumn("reason", reason)


def active_key_accounts(keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """Active keys with their account, and whether a welcome grant is still due."""
    due = (F.col("welcome_eligible") == 1) & F.col("welcome_granted_at").isNull()
    return keys.filter(F.col("revoked_at").isNull()).join(accounts, "user_id").withColumn("welcome_pending", due)


def key_limits(keys: DataFrame, limit: int = MAX_ACTIVE_KEYS) -> DataFrame:
    active = keys.filter(F.col("revoked_at").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("active_keys"))
    return active.withColumn("may_create", F.col("active_keys") < limit)


def welcome_grants(accounts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Ledger rows of the one-time grant for accounts that are due one."""
    due = accounts.filter((F.col("welcome_eligible") == 1) & F.col("welcome_granted_at").isNull())
    ref = ids.welcome_ref(F.col("user_id"))
    rows = due.select(
        ids.ledger_id(ref).alias("id"), "user_id", F.lit("welcome_bonus").alias("kind"),
        F.lit(WELCOME_CREDITS).cast("long").alias("credits"), ref.alias("external_ref"))
    return rows if seen is None else rows.join(seen.select("external_ref"), "external_ref", "left_anti")


def recent_ledger(ledger: DataFrame, limit: int = 20) -> DataFrame:
    """The latest ledger rows of every account."""
    return top_k(ledger, ["user_id"], [F.col("occurred_at").desc(), F.col("id").desc()], limit, "pos")


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Account status after its subscription events: the last one decides, with its effect on automatic funding.

    Columns: key, ts, type (subscription.*), status, cancel_scheduled.
    """
    last = keep_first(events.withColumn("_neg", -F.unix_micros("ts")), [key], ["_neg"])
    ended = F.col("type").isin("subscription.failed", "subscription.cancelled", "subscription.expired")
    scheduled = (F.col("type") == "subscription.plan_changed") & F.coalesce("cancel_scheduled", F.lit(False))
    status = F.coalesce("status", F.regexp_replace("type", r"^subscription\.", ""))
    return last.select(
        key, status.alias("subscription_status"),
        F.when(F.col("type") == "subscription.active", "active").when(F.col("type") == "subscription.on_hold", "on_hold")
        .when(scheduled, "scheduled_cancel").when(ended, status).alias("funding_status"),
        F.when(F.col("type") == "subscription.active", True).when(scheduled | ended, False).alias("funding_enabled"),
    )
