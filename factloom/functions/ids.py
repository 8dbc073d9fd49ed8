"""Hashes, pseudonyms and deterministic identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_hint(c: Column) -> Column:
    """First 13 and last 4 characters of a secret."""
    return F.concat(F.substring(c, 1, 13), F.lit("…"), F.substring(c, -4, 4))


def keyed_hash(message: Column, secret: str) -> Column:
    """HMAC-SHA-256 of a text as hex, from two plain hashes over the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def client_pseudonym(day: Column, client: Column, secret: str) -> Column:
    """Keyed hash of a client address, another one every day."""
    return keyed_hash(F.concat_ws("\n", day, client), secret)


def ledger_id(ref: Column) -> Column:
    return F.concat(F.lit("ledger_"), ref)


def reversal_ref(kind: Column, ref: Column) -> Column:
    return F.concat_ws(":", F.lit("reversal"), kind, ref)


def restore_ref(ref: Column) -> Column:
    return F.concat_ws(":", F.lit("restore"), F.lit("dispute"), ref)


def welcome_ref(user: Column) -> Column:
    return F.concat_ws(":", F.lit("welcome"), F.lit("v1"), user)


def alert_id(user: Column, epoch: Column, percent: Column) -> Column:
    return F.concat_ws(":", user, epoch, percent)
