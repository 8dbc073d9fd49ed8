"""Keyed stateful streams: reservations, alerts, reversals, automatic funding and the result cache.

Each processor keeps a small state per key and applies the events of a micro-batch in order of time. Keys are dealt to buckets, and
the states of a bucket are one value: a micro-batch reads and writes state once per bucket it touches, not several times per key or event. The
size of a micro-batch is set at the source (files per trigger), so no task holds more than that of one bucket.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.billing import ALERT_THRESHOLDS, HARD_DECLINES, MAX_FAILURES, RESERVATION_SECONDS, RETRY_SECONDS, charge

S, L, B, TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()
MINUTE_MS = 60_000
HOUR_US = 3_600_000_000
# How long closed ids are known, and payments without a new notice.
CLOSED_SECONDS, PAYMENT_SECONDS = 2 * 86_400, 400 * 86_400
# A bucket's states are rewritten when one of its keys has an event; a running stream can't change this number.
BUCKETS = 16_384


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """Events of one bucket in this micro-batch, in order."""
    batches = list(rows)
    whole = batches[0] if len(batches) == 1 else pd.concat(batches)
    return whole.sort_values(order, kind="stable")


def _whole(value) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def _key(value):
    """A key as it was before pandas made floats of whole numbers beside nulls."""
    return value if isinstance(value, str) else _whole(value)


class _Bucketed(StatefulProcessor):
    """Keeps one state per key, all states of a bucket in one value. States are lists of plain values.

    `due(state)` tells the event time (milliseconds) from which on a key has something to do without an event; the bucket's one timer is set
    to the first. `ended(state, limit)` does it, for all that was due by then, and returns the state, None to forget the key, and rows.
    """

    key: str
    order = ["ts", "seq"]
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _struct(due=L, states=S))

    def due(self, state) -> int | None:
        return None

    def ended(self, state, limit: Callable[[int], bool]) -> tuple[list | None, list[tuple]]:
        return None, []

    def fold(self, states: dict, events: pd.DataFrame, watermark_ms: int) -> list[tuple]:
        """Applies events to the states and returns rows that begin with their key."""
        raise NotImplementedError

    def _load(self) -> tuple[int | None, dict]:
        due, text = self.kept.get() if self.kept.exists() else (None, "[]")
        return due, {k: state for k, state in json.loads(text)}

    def _store(self, states: dict, timer: int | None) -> None:
        due = min((d for d in map(self.due, states.values()) if d is not None), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if states:
            self.kept.update((due, json.dumps(list(states.items()), separators=(",", ":"))))
        else:
            self.kept.clear()

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, states = self._load()
        out = self.fold(states, _in_order(rows, self.order), timerValues.getCurrentWatermarkInMs())
        self._store(states, timer)
        return self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        # The timer that calls is gone already; what else is due by the watermark is done in the same call.
        limit = lambda due: due <= max(at, now)
        _, states = self._load()
        out: list[tuple] = []
        for k, state in list(states.items()):
            due = self.due(state)
            if due is not None and limit(due):
                left, rows = self.ended(state, limit)
                out += [(k, *row) for row in rows]
                if left is None:
                    del states[k]
                else:
                    states[k] = left
        self._store(states, None)
        return self._frame(out)

    def close(self) -> None:
        pass


class _Folding(_Bucketed):
    """Applies `step(state, event)` to the events of a key; a key is forgotten from `due(state)` on. None: never."""

    fields: list[str]

    def initial(self) -> dict:
        raise NotImplementedError

    def step(self, state: dict, event) -> list[tuple]:
        raise NotImplementedError

    def due(self, state: list) -> int | None:
        return self.forgotten(dict(zip(self.fields, state)))

    def forgotten(self, state: dict) -> int | None:
        return None

    def fold(self, states: dict, events: pd.DataFrame, watermark_ms: int) -> list[tuple]:
        out, touched = [], {}
        for event in events.itertuples(index=False):
            key = _key(getattr(event, self.key))
            if key not in touched:
                touched[key] = dict(zip(self.fields, states[key])) if key in states else self.initial()
            out += [(key, *row) for row in self.step(touched[key], event)]
        states.update((key, [state[n] for n in self.fields]) for key, state in touched.items())
        return out


def _apply(events: DataFrame, processor: _Bucketed, output: T.StructType, delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """delay: with event time and its timers; later events than that are dropped."""
    timed = events.withWatermark("ts", delay) if delay else events
    dealt = timed.withColumn("_bucket", F.pmod(F.xxhash64(processor.key), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, output, "append", "EventTime" if delay else "None")


class Alerts(_Folding):
    """Balance, funding epoch and usage alerts of an account; each threshold once per epoch."""

    key, fields = "account", ["balance", "epoch", "basis", "stage"]
    columns = ["account", "epoch", "percent", "seq"]

    def initial(self) -> dict:
        return {"balance": 0, "epoch": 0, "basis": 0, "stage": 0}

    def step(self, state: dict, event) -> list[tuple]:
        state["balance"] += int(event.credits)
        if event.kind == "grant":
            state.update(basis=max(state["balance"], 0), stage=0, epoch=state["epoch"] + 1)
        if event.kind != "commit" or state["basis"] <= 0:
            return []
        used = max(state["basis"] - state["balance"], 0) * 100
        reached = [t for t in ALERT_THRESHOLDS if t > state["stage"] and used >= t * state["basis"]]
        if not reached:
            return []
        state["stage"] = reached[0]
        return [(state["epoch"], reached[0], int(event.seq))]


def usage_alerts(events: DataFrame, account_type: T.DataType = L) -> DataFrame:
    """Alerts of a stream of account, seq, ts, kind, credits."""
    return _apply(events, Alerts(), _struct(account=account_type, epoch=L, percent=L, seq=L))


class Reversals(_Folding):
    """What refunds and disputes leave of a payment, whatever order its notices come in."""

    key, fields = "payment_ref", ["account", "credits", "grant_at", "refunded", "dispute", "dispute_at", "dispute_id", "version"]
    order = ["ts", "event_id"]
    columns = ["payment_ref", "version", "account", "granted", "refund_final", "dispute_active", "net_credits", "pending"]

    def initial(self) -> dict:
        return {"account": None, "credits": None, "grant_at": None, "refunded": False, "dispute": None, "dispute_at": 0, "dispute_id": 0, "version": 0}

    def step(self, state: dict, event) -> list[tuple]:
        at, number = event.ts.value // 1000, int(event.event_id)
        if event.kind == "grant" and (state["grant_at"] is None or at < state["grant_at"]):
            state.update(account=int(event.account), credits=int(event.credits), grant_at=at)
        elif event.kind == "refund":
            state["refunded"] = True
        elif event.kind.startswith("dispute") and (at, number) >= (state["dispute_at"], state["dispute_id"]):
            # An older dispute notice that comes late changes nothing.
            state.update(dispute=event.kind, dispute_at=at, dispute_id=number)
        state["version"] += 1
        active = not state["refunded"] and state["dispute"] == "dispute_opened"
        gone = state["refunded"] or active
        net = 0 if gone or state["credits"] is None else state["credits"]
        return [(state["version"], state["account"], state["credits"], state["refunded"], active, net, state["credits"] is None and gone)]


def payment_reversals(events: DataFrame) -> DataFrame:
    """States of a stream of payment_ref, event_id, kind, ts, account, credits; the highest version of a reference counts."""
    out = _struct(payment_ref=S, version=L, account=L, granted=L, refund_final=B, dispute_active=B, net_credits=L, pending=B)
    return _apply(events, Reversals(), out)


class ResultCache(_Folding):
    """HIT while the stored result of a key is valid; a MISS stores its result unless it failed."""

    key, fields = "key", ["stored_us", "ttl"]
    columns = ["key", "seq", "outcome"]

    def initial(self) -> dict:
        return {"stored_us": -1, "ttl": 0}

    def step(self, state: dict, event) -> list[tuple]:
        now = event.ts.value // 1000
        if 0 <= state["stored_us"] and now < state["stored_us"] + state["ttl"] * 1_000_000:
            return [(int(event.seq), "HIT")]
        if event.ok:
            state.update(stored_us=now, ttl=int(event.ttl))
        return [(int(event.seq), "MISS")]

    def forgotten(self, state: dict) -> int | None:
        # A key without a stored result is known until the watermark moves on.
        return max(state["stored_us"], 0) // 1000 + state["ttl"] * 1000 + 1


def cached_requests(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """Outcome per request of a stream of key, seq, ts, ok, ttl. A result is forgotten when the watermark passes its end."""
    return _apply(requests, ResultCache(), _struct(key=S, seq=L, outcome=S), delay)


class Funding(_Folding):
    """Automatic funding of an account: charge below the trigger, one pending charge, a cap per month.

    After a failure the next charge waits three days; a hard decline or the third failure in a row stops it.
    """

    key, fields = "account", ["period", "spent", "pending", "pending_cents", "failures", "retry_us", "stopped", "seen_us"]
    columns = ["account", "seq", "outcome", "spent_cents", "failures"]

    def __init__(self, trigger: int, amount_cents: int, cap_cents: int):
        self.trigger, self.amount, self.cap = trigger, amount_cents, cap_cents

    def initial(self) -> dict:
        return {"period": "", "spent": 0, "pending": "", "pending_cents": 0, "failures": 0, "retry_us": 0, "stopped": False, "seen_us": 0}

    def _charge(self, state: dict, kind: str, ref: str) -> str:
        """The same decision as in the batch job, on the part of the state that concerns charges."""
        month = {"spent": state["spent"], "pending": (state["pending"], state["pending_cents"]) if state["pending"] else None}
        answer = charge(month, kind, ref, self.amount, self.cap)
        pending = month["pending"] or ("", 0)
        state.update(spent=month["spent"], pending=pending[0], pending_cents=pending[1])
        return answer

    def step(self, state: dict, event) -> list[tuple]:
        now, period = event.ts.value // 1000, event.ts.strftime("%Y-%m")
        state["seen_us"] = max(state["seen_us"], now)
        if state["period"] != period:
            state.update(period=period, spent=0, pending="", pending_cents=0)
        if event.kind == "usage":
            if state["stopped"]:
                outcome = "requires_attention"
            elif now < state["retry_us"]:
                outcome = "retry_wait"
            elif event.balance > self.trigger:
                outcome = "above_trigger"
            else:
                outcome = self._charge(state, "reserve", f"{key_text(event)}:{event.seq}")
        elif event.kind == "paid":
            outcome = self._charge(state, "commit", state["pending"])
            state.update(failures=0, retry_us=0)
        else:
            outcome = self._charge(state, "release", state["pending"])
            state["failures"] += 1
            state["stopped"] = state["stopped"] or state["failures"] >= MAX_FAILURES or (event.code or "").upper() in HARD_DECLINES
            state["retry_us"] = 0 if state["stopped"] else now + RETRY_SECONDS * 1_000_000
        return [(int(event.seq), outcome, state["spent"], state["failures"])]

    def forgotten(self, state: dict) -> int | None:
        return state["seen_us"] // 1000 + 1


def key_text(event) -> str:
    return str(event.account)


def automatic_funding(events: DataFrame, trigger: int, amount_cents: int, cap_cents: int, account_type: T.DataType = L, memory: int = PAYMENT_SECONDS) -> DataFrame:
    """Decision per event of a stream of account, seq, ts, kind (usage, paid, failed), balance, code.

    An account without an event for `memory` seconds is forgotten, with its failures.
    """
    out = _struct(account=account_type, seq=L, outcome=S, spent_cents=L, failures=L)
    return _apply(events, Funding(trigger, amount_cents, cap_cents), out, f"{memory} seconds")


class Reservations(_Bucketed):
    """Credit of an account under reserve, commit and refund; open reservations expire after 15 minutes.

    Repeated ids change nothing for `memory` seconds after they are closed; then they are forgotten. Expiry is applied with the next event of
    the account, and by an event-time timer when none comes. A state is the balance, the open reservations (created, id) in order, the closed
    ids with their time, and the last of these times.
    """

    key = "account"
    columns = ["account", "seq", "reservation_id", "kind", "outcome", "balance"]

    def __init__(self, memory: int):
        self.memory = memory

    @staticmethod
    def _minute_due(created: int) -> int:
        """Milliseconds at which all reservations of the minute are stale."""
        return (created // 1000 // MINUTE_MS + 1) * MINUTE_MS + RESERVATION_SECONDS * 1000

    def _forget_at(self, closed: int) -> int:
        """Milliseconds of the hour in which a closed id may be forgotten."""
        return ((closed + self.memory * 1_000_000) // HOUR_US + 1) * (HOUR_US // 1000)

    def due(self, state: list) -> int | None:
        _, opened, closed, last = state
        times = ([self._minute_due(opened[0][0])] if opened else []) + ([self._forget_at(last)] if closed else [])
        return min(times, default=None)

    def ended(self, state: list, limit: Callable[[int], bool]) -> tuple[list | None, list[tuple]]:
        stale = 0
        while stale < len(state[1]) and limit(self._minute_due(state[1][stale][0])):
            stale += 1
        out = self._expire(state, stale)
        state[2] = {rid: at for rid, at in state[2].items() if not limit(self._forget_at(at))}
        return state, out

    @staticmethod
    def _close(state: list, rid: str, at: int) -> None:
        state[2][rid], state[3] = at, max(state[3], at)

    def _expire(self, state: list, n: int) -> list[tuple]:
        """The first n open reservations are stale."""
        out = []
        for created, rid in state[1][:n]:
            state[0] += 1
            self._close(state, rid, created + RESERVATION_SECONDS * 1_000_000)
            out.append((None, rid, "expire", "stale_refunded", state[0]))
        del state[1][:n]
        return out

    def _outcome(self, state: list, at_of: dict, event, now: int) -> str:
        """at_of: when the open reservations were made."""
        rid, (_, opened, closed, _) = event.reservation_id, state
        is_open, known = rid in at_of, rid in closed and now <= closed[rid] + self.memory * 1_000_000
        if event.kind in ("grant", "reverse"):
            if is_open or known:
                return "idempotent"
            self._close(state, rid, now)
            state[0] += int(event.credits) if event.kind == "grant" else -int(event.credits)
            return event.kind
        if event.kind == "reserve":
            if is_open or known:
                return "reserved" if is_open else "closed"
            if state[0] < 1:
                return "insufficient_credits"
            insort(opened, [now, rid])
            at_of[rid] = now
            state[0] -= 1
            return "reserved"
        if not is_open:
            return "idempotent" if known else "unknown_reservation"
        del opened[bisect_left(opened, [at_of.pop(rid), rid])]
        self._close(state, rid, now)
        if event.kind != "commit":
            state[0] += 1
        return "committed" if event.kind == "commit" else "refunded"

    def fold(self, states: dict, events: pd.DataFrame, watermark_ms: int) -> list[tuple]:
        out, made = [], {}
        for event in events.itertuples(index=False):
            key, now = _key(event.account), event.ts.value // 1000
            state = states.setdefault(key, [0, [], {}, 0])
            if key not in made:
                state[2] = {rid: at for rid, at in state[2].items() if self._forget_at(at) > watermark_ms}
                made[key] = {rid: created for created, rid in state[1]}
            gone = self._expire(state, bisect_left(state[1], [now - RESERVATION_SECONDS * 1_000_000]))
            for row in gone:
                del made[key][row[1]]
                out.append((key, *row))
            outcome = self._outcome(state, made[key], event, now)
            out.append((key, int(event.seq), event.reservation_id, event.kind, outcome, state[0]))
        return out

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for df in super()._frame(rows):
            yield df.astype({"seq": "Int64"})


def reservations(events: DataFrame, account_type: T.DataType = L, delay: str = "0 seconds", memory: int = CLOSED_SECONDS) -> DataFrame:
    """Outcome per event of a stream of account, seq, ts, kind, reservation_id, credits; expired reservations have no seq.

    Closed ids are known for `memory` seconds, so that the state of an account does not outgrow its recent reservations.
    """
    out = _struct(account=account_type, seq=L, reservation_id=S, kind=S, outcome=S, balance=L)
    return _apply(events, Reservations(memory), out, delay)


class ReversalLog(_Bucketed):
    """Ledger rows of a payment's reversals, booked and taken back as notices come in, in whatever order and however split.

    The ledger follows from a payment's notices in order of time. They are kept, as few as one payment has; after each
    micro-batch the ledger is worked out and what differs from the rows told before is emitted: `retract` for rows that no longer hold,
    `book` for new ones. A payment is forgotten when the watermark passes its last notice. A state is the notices, the last version and
    the rows told.
    """

    key, order = "payment_ref", ["ts", "event_id"]
    columns = ["payment_ref", "version", "op", "kind", "credits", "account"]

    def due(self, state: list) -> int | None:
        return max(n[0] for n in state[0]) // 1000 + 1

    @staticmethod
    def ledger(notices: list[tuple]) -> list[tuple]:
        """(kind, credits, account) of one payment's notices (at, event_id, kind, account, credits).

        The first grant counts. A refund is final. A dispute takes the grant back once, and gives it back once when it is won, unless a refund came
        first; what a dispute holds when the refund comes is not taken twice.
        """
        granted = account = None
        net, refunded, disputed, rows = 0, False, False, []
        for _, _, kind, who, credits in sorted(notices, key=lambda n: n[:2]):
            fresh = kind == "grant" and granted is None
            if fresh:
                granted, account, net = credits, who, credits
            refunded |= kind == "refund"
            disputed = kind == "dispute_opened" if kind.startswith("dispute") else disputed
            if granted is None:
                continue
            done = {r[0] for r in rows}
            if refunded and (fresh or kind == "refund"):
                booked = "refund" if net > 0 and "refund" not in done else None
            elif kind == "dispute_opened" or fresh and disputed:
                booked = "dispute" if net > 0 and "dispute" not in done else None
            else:
                booked = "dispute_reversed" if kind == "dispute_won" and not refunded and net <= 0 and "dispute_reversed" not in done else None
            if booked:
                change = granted if booked == "dispute_reversed" else -granted
                net += change
                rows.append((booked, change, account))
        return rows

    def fold(self, states: dict, events: pd.DataFrame, watermark_ms: int) -> list[tuple]:
        fresh: dict = {}
        for e in events.itertuples(index=False):
            fresh.setdefault(_key(e.payment_ref), []).append([e.ts.value // 1000, int(e.event_id), e.kind, _whole(e.account), _whole(e.credits)])
        out = []
        for key, notices in fresh.items():
            known, version, told = states.get(key, ([], 0, []))
            seen = {n[1] for n in known}
            added = list({n[1]: n for n in notices if n[1] not in seen}.values())
            if not added:
                continue
            before, after = [tuple(r) for r in told], self.ledger(known + added)
            changes = [("retract", *r) for r in before if r not in after] + [("book", *r) for r in after if r not in before]
            out += [(key, version + i + 1, *r) for i, r in enumerate(changes)]
            states[key] = [known + added, version + len(changes), after]
        return out


def reversal_log(events: DataFrame, memory: int = PAYMENT_SECONDS) -> DataFrame:
    """Changes of the reversal ledger for a stream of payment_ref, event_id, kind, ts, account, credits: the highest version of a kind tells whether it is booked.

    A notice may be late by up to `memory` seconds; for as long a payment is known. Repeats of an event_id change nothing.
    """
    out = _struct(payment_ref=S, version=L, op=S, kind=S, credits=L, account=L)
    return _apply(events, ReversalLog(), out, f"{memory} seconds")
