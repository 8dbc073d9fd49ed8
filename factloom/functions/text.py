"""Text normalization, tokens, Markdown helpers and query terms."""

from __future__ import annotations

import html as html_module
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf, udf
from pyspark.sql.types import StringType

from factloom.functions import let

# The characters that count as white space in collapsed text.
SPACE_CLASS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# A run of blanks. Printable ASCII is ruled out first, which is much quicker than trying the whole class on it.
SPACE_RUN = "(?![!-~])" + SPACE_CLASS + "+"
# A run of anything else, with printable ASCII taken as whole runs.
WORD_RUN = "(?:[!-~]++|" + SPACE_CLASS.replace("[", "[^", 1) + ")++"

# Words that carry no ranking weight in a query (English and German).
STOP_WORDS = (
    "a", "an", "and", "are", "for", "from", "how", "in", "is", "of", "on", "or",
    "the", "to", "what", "where", "who", "why", "with",
    "das", "der", "die", "ein", "eine", "ist", "und", "von", "was", "wer", "wie",
    "wo", "zu",
)

# Articles that may introduce a short name.
LEADING_ARTICLES = ("a", "an", "the", "das", "der", "die", "el", "la", "las", "los", "le", "les")

# Boilerplate phrases counted as noise.
NOISE_PATTERN = (
    r"(?i)\b(?:accept all cookies|advertisement|all rights reserved|cookie settings|log in|navigation"
    r"|privacy policy|sign in|subscribe|terms of (?:service|use))\b"
)

WORD_PATTERN = r"[\p{L}\p{N}]+"
MARKDOWN_WORD_PATTERN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*+"
MAX_QUERY_LENGTH = 200


def collapse(c: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column, maximum: int = 4000) -> Column:
    """Collapsed text, null when empty or a printed null, at most `maximum` characters."""
    usable = lambda text: (text != "") & ~F.lower(text).isin("null", "undefined")
    return let(collapse(c), lambda text: F.when(usable(text), F.substring(text, 1, maximum)))


def strip_tags(c: Column) -> Column:
    """Inert text of a markup fragment: tags dropped, the common entities decoded, blanks collapsed."""
    return collapse(decode_common(F.regexp_replace(c, r"<[^>]*>", "")))


# The common entities, the ampersand last.
COMMON_ENTITIES = (("nbsp|#160", " "), ("lt|#60", "<"), ("gt|#62", ">"), ("quot|#34", '"'), ("apos|#0?39", "'"), ("amp|#38", "&"))


def decode_common(c: Column) -> Column:
    """The five markup entities and the fixed blank, decoded."""
    for names, char in COMMON_ENTITIES:
        c = F.regexp_replace(c, f"&(?i:{names});", char)
    return c


@udf(StringType(), useArrow=False)
def decode_entities(value: str) -> str | None:
    """Every named and numeric character reference decoded; long texts travel in small lots."""
    return None if value is None else html_module.unescape(value)


def escape_markdown(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"([\\`*_\[\]<>])", r"\\$1"))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def distinct_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def query_terms(c: Column) -> Column:
    """Distinct meaningful words of a query; all its words when only stop words are left."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    both = F.struct(tokens(c).alias("words"), F.array_except(tokens(c), stops).alias("kept"))
    return let(both, lambda b: F.when(F.size(b["kept"]) > 0, b["kept"]).otherwise(F.array_distinct(b["words"])))


def needed_matches(terms: Column) -> Column:
    """How many distinct terms a document must contain: a strict majority."""
    return F.floor(F.size(terms) / 2).cast("int") + 1


def is_relevant(terms: Column, document_tokens: Column) -> Column:
    return (F.size(terms) > 0) & (F.size(F.array_intersect(terms, document_tokens)) >= needed_matches(terms))


def normalize_query(c: Column) -> Column:
    """struct(query, error_code): collapsed text of 1 to 200 characters."""
    valid = lambda query: F.char_length(query).between(1, MAX_QUERY_LENGTH)
    return let(collapse(F.coalesce(c, F.lit(""))), lambda query: F.struct(
        F.when(valid(query), query).alias("query"),
        F.when(~valid(query), F.lit("invalid_request")).alias("error_code"),
    ))


def discovery_query(query: Column, country_name: Column) -> Column:
    """The query sent to an index: leading stop words dropped, at least one word kept, and the
    country name put in front of a 3 to 5 word name that starts with an article."""
    words = F.split(query, " ")
    head = lambda w: F.regexp_extract(F.lower(w), WORD_PATTERN, 0)
    stops = [F.lit(w) for w in STOP_WORDS]
    # Position of the first word that is no stop word; the last word is always kept.
    meaningful = F.filter(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: (i == F.size(words)) | ~head(F.element_at(words, i)).isin(*stops),
    )
    kept = F.array_join(F.slice(words, meaningful[0], F.size(words)), " ")
    named = head(words[0]).isin(*LEADING_ARTICLES) & F.size(words).between(3, 5)
    return F.when(named & country_name.isNotNull(), F.concat_ws(" ", F.lower(country_name), kept)).otherwise(kept)


def comparison_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


_KEEP = re.compile(r"[\W_]+")


@pandas_udf(StringType())
def creator_key(values: pd.Series) -> pd.Series:
    """Compatibility-normalized creator name without a leading @ (Spark has no Unicode normalizer)."""
    def key(value: str) -> str:
        plain = unicodedata.normalize("NFKC", value).removeprefix("@").lower()
        return _KEEP.sub(" ", plain).strip()

    return values.map(key, na_action="ignore")


def word_count(c: Column) -> Column:
    """Markdown words: letters and digits, joined by apostrophes or hyphens."""
    return F.regexp_count(c, F.lit(MARKDOWN_WORD_PATTERN)).cast("long")


def blank_separated_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_RUN)).cast("long")


def noise_per_thousand(c: Column) -> Column:
    """Boilerplate phrases per 1000 words, two digits."""
    hits = F.regexp_count(c, F.lit(NOISE_PATTERN))
    words = F.greatest(blank_separated_words(c), F.lit(1))
    return F.floor(hits.cast("double") / words * 1000 * 100 + 0.5) / 100


def title_from_markdown(c: Column) -> Column:
    """Text of the first level-one heading."""
    return blank_to_null(F.trim(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1)))


def first_line(c: Column, maximum: int = 120) -> Column:
    """First non-blank line, cut to a title."""
    lines = F.filter(F.split(c, "\n"), lambda line: F.trim(line) != "")
    return F.substring(F.trim(F.get(lines, F.lit(0))), 1, maximum)


def hashtags(c: Column, maximum: int = 50) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, maximum)


def keep_first_distinct(values: Column, maximum: int) -> Column:
    """Non-empty distinct values in input order, at most `maximum`."""
    present = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.slice(F.array_distinct(present), 1, maximum)


def distinct_ignore_case(values: Column) -> Column:
    """Non-empty values whose lower-cased form appears for the first time."""
    present = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    first = lambda all_values: F.filter(
        all_values, lambda v, i: F.array_position(F.transform(all_values, F.lower), F.lower(v)) == i + 1)
    return let(present, first)


def present(values: list[Column]) -> Column:
    """The non-empty ones of several strings."""
    return F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ""))


def join_present(separator: str, *values: Column) -> Column:
    return F.array_join(present(list(values)), separator)


def as_value(c: Column) -> Column:
    """The trimmed text, null when it is blank."""
    return F.nullif(F.trim(c), F.lit(""))
