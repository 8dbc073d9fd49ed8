"""Secret scans with corpus-wide ownership, in DataFrame expressions only.

Patterns propose secrets. Every secret is hashed, and the hashes are counted over the whole corpus: in how many repositories, and of how
many owners, does each occur? One that many owners hold is a copied example; one that few owners hold, random enough for its length, looks live.
Spans of the base kinds always stay; spans of the other kinds are added where they look live. A private key is hashed by its body; a header without one hides nothing. Counting goes by (hash, owner, repository), then by
(hash, owner), then by hash, so that a hash found everywhere is added up before it is shuffled.

Null counts as empty text, which has no span. A null owner or repository counts as one of its own. Equal rows are one repository. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.spans import add_matches, joined, redacted
from factloom.llm.store import narrow, stored

# The base patterns.
LEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = LEAD + r"[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
# Further kinds.
GITHUB = r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+"
CHAT = r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}+"
PAYMENT = r"(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{16,}+"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
HEADER, FOOTER = (rf"-----{word}\x20[A-Z\x20]{{0,30}}PRIVATE\x20KEY-----" for word in ("BEGIN", "END"))
# A whole block up to its END line; without one, the header's fields and base64 lines, of which the last may be short.
LINES = r"""(?:\s++[A-Z][A-Za-z]*+-[A-Za-z-]++:\x20\S++)*+(?:(?:\s|\\[nr]|["'+,;>#*|])*+[A-Za-z0-9+/]{16,}+={0,2})*+(?:(?:[\x20\t]*+[\r\n]++|\\n)[A-Za-z0-9+/]++={0,2}(?=[\x20\t]*+(?:[\r\n\\"']|\z)))?"""
PRIVATE = rf"{HEADER}(?:(?:[^-]++|-(?!----))*+{FOOTER}|{LINES})"
IN_URL = r"://[^\s/:@]*+:[^\s/@]{3,}+@"
RANDOM = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=.-])"

KINDS = ["assign", "access", "hex", "github", "chat", "payment", "jwt", "private_key", "url_password", "random"]
BASE = 3
# A secret that so many owners hold is an example.
SHARED_OWNERS = 3
LIVE_BITS, LIVE_LENGTH = 2.5, 12
# Assigned values and passwords in addresses look live at any length: their bits must reach this share of the most that so few signs can hold,
# LIVE_BITS at most, and they must not stand for a secret.
LIVE_SHARE = 0.6
PLACEHOLDER = (r"^(?i:(?:your|my|the|an?|some|new|old|example|sample|dummy|fake|test|change|replace|insert|enter|put)?[-_.]?(?:me|this|here|it|password|passwd|pass|"
               r"secret|token|api[-_.]?key|key|value)(?:[-_.]?(?:here|goes[-_.]?here))?|example|sample|dummy|placeholder|redacted|removed|hidden|masked|required|optional|"
               r"string|number|integer|boolean|object|null|none|undefined|default)$")
MARK = "[secret]"


def secret_part(span: Column) -> Column:
    """What is secret in a span: the assigned value, the password in an address, the signs of a key between header and footer, else all of it."""
    value = span["value"]
    body = F.regexp_replace(value, rf"{HEADER}|{FOOTER}|\\[nr]|[^A-Za-z0-9+/=]", "")
    return F.when(span["kind"] == 0, F.regexp_replace(value, "^" + LEAD, "")).when(
        span["kind"] == 8, F.regexp_extract(value, "^://[^:]*:(.*)@$", 1)).when(span["kind"] == 7, body).otherwise(value)


def entropy(value: Column) -> Column:
    """Bits per character."""
    size = F.length(value)

    def add(total: Column, sign: Column) -> Column:
        share = (size - F.length(F.replace(value, sign, F.lit("")))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), add)


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", carry: bool = False) -> DataFrame:
    """row (key of the row), doc_id, owner, repo and spans with hash, bits and size of the secret, and whether it only stands for one.

    carry: with the whole row as struct `carried`.
    """
    df = narrow(docs, doc_id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    if carry:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")
        df = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in (("doc_id", id_col), ("text", text_col), ("owner", owner_col), ("repo", repo_col))], whole)
    carried = ["carried"] if carry else []
    df = df.withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("row", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("owner").cast("string"), F.col("text"))))
    df = add_matches(df, "assign", "text", 0, ASSIGN, lambda v: F.length(F.regexp_replace(v, "^" + LEAD, "")) >= 6)
    df = add_matches(df, "access", "text", 1, ACCESS)
    df = add_matches(df, "hex", "text", 2, HEX)
    df = add_matches(df, "more", "text", BASE, "|".join((GITHUB, CHAT, PAYMENT, JWT, PRIVATE, IN_URL, RANDOM)))
    df = df.withColumn("base", F.concat("assign", "access", "hex")).select("row", "doc_id", F.col("owner").cast("string").alias("owner"), F.col("repo").cast("string").alias("repo"), "base", "more", *carried)
    kinds = [(3, "^gh[pousr]_"), (4, "^xox"), (5, "^[rs]k_live_"), (6, r"^eyJ[A-Za-z0-9_-]+\."), (7, "^-----"), (8, "^://")]
    # A key's block stays whole, even where base spans lie in it or reach into it.
    apart = F.filter("more", lambda s: s["value"].startswith("-----") | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def kind_of(value: Column) -> Column:
        out = F.lit(9)
        for k, pattern in reversed(kinds):
            out = F.when(value.rlike(pattern), k).otherwise(out)
        return out

    spans = F.concat("base", F.transform(apart, lambda s: s.withField("kind", kind_of(s["value"]))))
    parted = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), secret_part(s).alias("secret")))
    return df.select("row", "doc_id", "owner", "repo", *carried, F.transform(parted, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["secret"].cast("binary"), 256).alias("hash"),
        entropy(s["secret"]).alias("bits"), F.length(s["secret"]).alias("size"), s["secret"].rlike(PLACEHOLDER).alias("stands_for"))).alias("spans"))


def ownership(proposed: DataFrame) -> DataFrame:
    """hash, repos, owners over the whole corpus."""
    hashes = proposed.select("owner", "repo", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    return hashes.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("hash").agg(
        F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def judge(proposed: DataFrame, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """row and its spans with repos, owners, shared and live. Rows without spans are left out."""
    spans = proposed.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    known = spans.join(ownership(proposed), "hash")
    shared = F.col("owners") >= shared_owners
    given = ~F.col("stands_for") & (F.col("bits") >= F.least(F.lit(LIVE_BITS), LIVE_SHARE * F.log2("size")))
    live = ~shared & F.when(F.col("kind").isin(0, 8), given).when(F.col("kind") == 7, F.col("size") > 0).otherwise(
        (F.col("bits") >= LIVE_BITS) & (F.col("size") >= LIVE_LENGTH))
    return known.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(
        "start", "kind", "end", "hash", "bits", "size", "repos", "owners", shared.alias("shared"), live.alias("live")))).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
         shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """row, doc_id and all judged spans in order of start; further kinds only where they look live."""
    proposed = stored(propose(docs, id_col, text_col, owner_col, repo_col), "secrets-proposed")
    judged = judge(proposed, shared_owners).withColumn("spans", F.filter("spans", lambda s: (s["kind"] < BASE) | s["live"]))
    # Rows without spans, the most of them, need not be dealt out.
    return proposed.filter(F.size("spans") > 0).select("row", "doc_id").join(judged, "row").select("row", "doc_id", "spans").unionByName(
        proposed.filter(F.size("spans") == 0).select("row", "doc_id", F.array().cast(judged.schema["spans"].dataType).alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, all spans as text, and how many are shared or look live."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return found.select(
        "doc_id", *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        count(lambda s: s["shared"]).alias("n_shared"), count(lambda s: s["live"]).alias("n_live"),
        F.sha2(joined(base, KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", size_col: str | None = "n_chars",
           mark: str = MARK) -> DataFrame:
    """All rows and columns, with every secret that looks live replaced by a mark in the text; size_col follows the new text.

    Rows are stored with their spans, so a text without spans, as most are, is in no join.
    """
    proposed = stored(propose(docs, id_col, text_col, owner_col, id_col, carry=True), "secrets-carried")
    judged = judge(proposed).select("row", F.filter("spans", lambda s: s["live"]).alias("live")).filter(F.size("live") > 0)
    held = proposed.filter(F.size("spans") > 0).select("row", "carried").join(judged, "row", "left")
    own = lambda c: F.col("carried").getField(c)
    new = F.when(F.col("live").isNotNull(), redacted(own(text_col), F.col("live"), mark)).otherwise(own(text_col))
    found = held.select("carried", "live", new.alias("new"))
    size = F.when(F.col("live").isNotNull(), F.length("new"))
    redone = found.select(*[
        F.col("new").alias(c) if c == text_col else F.coalesce(size.cast(docs.schema[c].dataType), own(c)).alias(c) if c == size_col else own(c).alias(c) for c in docs.columns])
    return redone.unionByName(proposed.filter(F.size("spans") == 0).select(*[own(c).alias(c) for c in docs.columns]))
