"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans. Six labelers (structure, checksum, gazetteer, context, boundary, placeholder) each vote for, against or not at
all. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely each
span is personal data; with these likelihoods as soft labels a logistic classifier on shape features is trained. Spans of the base kinds always
stay; spans of the other kinds are added where the classifier finds them likely.

Only counts per vote and shape pattern (finite sets) come to the driver. Null counts as empty text, which has no span. Rows with equal ids
are handled one by one. Without any span all reliabilities stay at their start. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.spans import add_matches, digits, joined, luhn
from factloom.llm.store import narrow, stored

# The base patterns, written so that none backtracks over long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Further kinds, found by one pattern and told apart afterwards.
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,64}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?"

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "local_phone", "spelled_email", "name"]
BASE = 4
LABELERS = ["structure", "checksum", "gazetteer", "context", "boundary", "placeholder"]
LIKELY = 0.5
ROUNDS = 30

# Gazetteers.
TOP_LEVEL = "com org net edu gov info biz io co me de fr es it nl uk us eu ch at be pl se no dk fi pt ru jp cn in br au ca mx".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
IBAN_LANDS = "AT BE CH CZ DE DK EE ES FI FR GB GR HU IE IT LT LU LV NL NO PL PT RO SE SI SK".split()
GIVEN_NAMES = "anna maria john james mary peter paul thomas michael david sarah laura julia marie pierre jean luis carlos juan ana hans klaus".split()
CUES = ["e-?mail|mail|contact|write", r"\bip\b|address|host|server|from", "card|visa|master|amex|credit|karte|carte|tarjeta",
        "phone|call|tel|mobile|fax|ruf|móvil|cell", "ssn|social|security", "iban|account|konto|compte|cuenta|bank",
        "phone|call|tel|mobile|fax|ruf|móvil|cell", "e-?mail|mail|contact|write", "name|contact|from|by|dear|signed"]
AGAINST = r"\b(?:version|ver|v|isbn|issn|order|invoice|item|page|section|chapter|figure|build|serial|article)\.?:?\x20?#?$"


def _by_kind(kind: Column, cases: list[Column]) -> Column:
    out = F.lit(0)
    for k, case in reversed(list(enumerate(cases))):
        out = F.when(kind == k, case).otherwise(out)
    return out


def _for(condition: Column, otherwise: int = -1) -> Column:
    return F.when(condition, 1).otherwise(otherwise)


def votes(span: Column) -> list[Column]:
    """1 for, -1 against, 0 none, by each labeler."""
    kind, value, before, after = span["kind"], span["value"], span["before"], span["after"]
    number = digits(value)
    structure = _by_kind(kind, [
        _for(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$")), _for(value.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$")),
        _for(value.rlike(r"^[0-9]{16,19}$|^(?:[0-9]{4}[\x20-]){3}[0-9]{4,7}$")), _for(F.length(number).between(10, 13)),
        _for(value.rlike("^[0-8]")), _for(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34)), F.lit(1), F.lit(1), F.lit(1)])
    checksum = _by_kind(kind, [F.lit(0), _for(~value.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.")), _for(number.rlike("^[3-6]")),
                               _for(~number.rlike("^0"), -1), _for(~value.rlike(r"^(?:000|666)|-00-|-0000$")), F.lit(0),
                               _for(value.rlike(r"^\(?[2-9]")), F.lit(0), F.lit(0)])
    gazetteer = _by_kind(kind, [
        _for(F.lower(F.substring_index(value, ".", -1)).isin(TOP_LEVEL)), F.lit(0), _for(number.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)")),
        _for(number.rlike(f"^(?:{'|'.join(CALLING)})"), 0), F.lit(0), _for(F.left(value, F.lit(2)).isin(IBAN_LANDS)), F.lit(0),
        _for(F.lower(F.regexp_extract(value, "[A-Za-z]+$", 0)).isin(TOP_LEVEL)),
        _for(F.lower(F.regexp_extract(value, r"^\S+\x20(\S+)", 1)).isin(GIVEN_NAMES), 0)])
    near = F.lower(before)
    context = F.when(_by_kind(kind, [near.rlike(cue).cast("int") for cue in CUES]) == 1, 1).when(near.rlike(AGAINST), -1).otherwise(0)
    boundary = F.when(before.rlike(r"[\p{L}\p{N}_@/=-]$") | after.rlike(r"^[\p{L}\p{N}_@/=]"), -1).otherwise(1)
    placeholder = F.when(number.rlike(r"([0-9])\1{5,}|12345678|98765432") | F.lower(value).rlike(r"example\.|test@|foo|noreply"), -1).otherwise(1)
    return [structure, checksum, gazetteer, context, boundary, placeholder]


# Shape features of the classifier, each from a finite set: kind, length class, share of digits, marks within, cue, edge.
def shape(span: Column) -> list[Column]:
    value = span["value"]
    size, share = F.length(value), F.length(digits(value)) / F.greatest(F.length(value), F.lit(1))
    return [span["kind"], F.least(F.floor(size / 8), F.lit(4)).cast("int"), F.floor(share * 2.999).cast("int"),
            value.rlike(r"[\x20().@-]").cast("int"), F.lower(span["before"]).rlike("|".join(sorted(set(CUES)))).cast("int"),
            (span["before"].rlike(r"[\s(\[:,;]$") | (span["before"] == "")).cast("int")]


SHAPES = [len(KINDS), 5, 3, 2, 2, 2]


def estimate(patterns: list[tuple[tuple[int, ...], int, float]], rounds: int = ROUNDS):
    """EM over (votes, kind, count): chance of each vote given the truth, prior per kind, and the likelihood of each pattern.

    It starts from the share of votes for; every count is smoothed by one.
    """
    given = np.array([v for v, _, _ in patterns], int).reshape(-1, len(LABELERS)) + 1
    kind, count = np.array([k for _, k, _ in patterns], int), np.array([n for *_, n in patterns], float)
    likely = (1 + (given - 1).sum(1) / len(LABELERS)) / 2
    chance, prior = np.full((2, len(LABELERS), 3), 1 / 3), np.full(len(KINDS), 0.5)
    for _ in range(rounds if len(count) else 0):
        for truth, weight in enumerate((count * (1 - likely), count * likely)):
            for j in range(len(LABELERS)):
                own = np.bincount(given[:, j], weight, 3) + 1
                chance[truth, j] = own / own.sum()
        prior = (np.bincount(kind, count * likely, len(KINDS)) + 1) / (np.bincount(kind, count, len(KINDS)) + 2)
        side = [np.log(np.where(truth, prior, 1 - prior)[kind]) + sum(np.log(chance[truth, j, given[:, j]]) for j in range(len(LABELERS))) for truth in (0, 1)]
        likely = 1 / (1 + np.exp(np.clip(side[0] - side[1], -60, 60)))
    return chance, prior, likely


def fit_classifier(shapes: list[tuple[int, ...]], soft: np.ndarray, count: np.ndarray, ridge: float = 1.0, steps: int = 25) -> list[list[float]]:
    """Weights for every value of every shape feature, by Newton steps on soft labels; the intercept is a part of the kind's weights."""
    starts = np.concatenate([[0], np.cumsum(SHAPES)])
    weights = np.zeros(starts[-1])
    if len(shapes):
        x = np.zeros((len(shapes), starts[-1]))
        for j, start in enumerate(starts[:-1]):
            x[np.arange(len(shapes)), start + np.array([s[j] for s in shapes])] = 1
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (count * (p - soft)) + ridge * weights
            weights = weights - np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights)), gradient)
    return [weights[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all proposed spans of every text; spans of further kinds that meet one of a base kind are left out."""
    df = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    df = add_matches(df, "email", "text", 0, EMAIL)
    df = add_matches(df, "ip", "text", 1, IP, lambda v: v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
    number = lambda v: digits(v)
    df = add_matches(df, "card", "text", 2, CARD, lambda v: F.length(number(v)).between(16, 19) & F.when(
        F.length(number(v)).between(16, 19), luhn(number(v))).otherwise(False))
    df = add_matches(df, "phone", "text", 3, PHONE, lambda v: F.length(number(v)).between(8, 15))
    df = add_matches(df, "more", "text", BASE, "|".join((SSN, IBAN, LOCAL_PHONE, SPELLED, NAME)))
    df = df.withColumn("base", F.concat("email", "ip", "card", "phone")).drop("email", "ip", "card", "phone", "text")
    told = F.transform("more", lambda s: s.withField("kind", F.when(s["value"].rlike(f"^(?:{SSN})$"), 4).when(s["value"].rlike(f"^(?:{IBAN})$"), 5).when(
        s["value"].rlike(f"^(?:{LOCAL_PHONE})$"), 6).when(s["value"].rlike(r"[\[(]at[\])]"), 7).otherwise(8)))
    apart = F.filter(told, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.select("doc_id", "base", apart.alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likely: float = LIKELY) -> DataFrame:
    """doc_id, base spans and added spans (kind number, start, end, value, before, after; likelihood of the added ones)."""
    proposed = stored(propose(docs, id_col, text_col), "pii-proposed")
    spans = proposed.select(F.explode(F.concat("base", "more")).alias("s"))
    counted = spans.select(F.array(*votes(F.col("s"))).alias("v"), F.array(*shape(F.col("s"))).alias("f")).groupBy("v", "f").agg(
        F.count(F.lit(1)).alias("n")).collect()
    counted = sorted((tuple(r.v), tuple(r.f), float(r.n)) for r in counted)
    *_, soft = estimate([(v, f[0], n) for v, f, n in counted])
    weights = fit_classifier([f for _, f, _ in counted], soft, np.array([n for *_, n in counted]))

    def classified(span: Column) -> Column:
        total = F.lit(0.0)
        for value, own in zip(shape(span), weights):
            total = total + F.element_at(F.array(*[F.lit(w) for w in own]), value + 1)
        return span.withField("likelihood", 1 / (1 + F.exp(-total)))

    added = F.filter(F.transform("more", classified), lambda s: s["likelihood"] >= likely)
    return proposed.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(added).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    places = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)], F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(places("base"), places("added"))), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
