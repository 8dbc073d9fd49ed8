from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import numbers as N
from factloom.functions import text as T


def test_collapse_includes_wide_blanks(values):
    assert values(T.collapse, ["  a  b \n c﻿"]) == ["a b c"]


def test_query_terms_fall_back_to_stop_words(values):
    assert values(T.query_terms, ["What is the LLMbase", "what is the", "größe Größe 2"]) == [["llmbase"], ["what", "is", "the"], ["größe", "2"]]


def test_query_length(values):
    out = values(T.normalize_query, ["  two   words ", " ", "x" * 201])
    assert [(o.query, o.error_code) for o in out] == [("two words", None), (None, "invalid_request"), (None, "invalid_request")]


def test_discovery_query(values):
    out = values(lambda c: T.discovery_query(c, F.lit("Germany")), ["what is rust", "the big bridge", "the of"])
    assert out == ["rust", "germany big bridge", "of"]


def test_relevance_is_a_majority_of_whole_words(values):
    test = lambda c: T.is_relevant(T.query_terms(F.lit("alpha beta gamma")), T.tokens(c))
    assert values(test, ["alpha beta", "alpha betas", "gamma, ALPHA"]) == [True, False, True]


def test_escape_words_noise(values):
    assert values(T.escape_markdown, [" a*b_[c] <d> `e` \\ "]) == ["a\\*b\\_\\[c\\] \\<d\\> \\`e\\` \\\\"]
    assert values(T.word_count, ["don't well-known it’s 3", ""]) == [4, 0]
    assert values(T.noise_per_thousand, ["sign in and subscribe now please ok", "plain"]) == [285.71, 0.0]


def test_entities_and_titles(values):
    assert values(T.decode_entities, ["a &amp; b &#x1F600; &eacute;"]) == ["a & b \U0001F600 é"]
    assert values(T.title_from_markdown, ["x\n# Title \ny", "none"]) == ["Title", None]
    assert values(T.hashtags, ["#a b #é_1 #a"]) == [["a", "é_1"]]


def test_creator_key(values):
    assert values(T.creator_key, ["@Ｆoo--Bar", "foo bar"]) == ["foo bar", "foo bar"]


def test_rounding_half_toward_plus_infinity(values):
    assert values(lambda c: N.round_half_up(c, 0), [-2.5, 2.5, 2.4], "double") == [-2.0, 3.0, 2.0]
    assert values(N.market_value, [-1.0, 1.123456789, float("nan")], "double") == [None, 1.12345679, None]


def test_money(values):
    eur, jpy = F.lit("EUR"), F.lit("JPY")
    assert values(lambda c: N.minor_units(c, eur), ["19.99", "19.995", "x", "-1"]) == [1999, 2000, None, None]
    assert values(lambda c: N.minor_units(c, jpy), ["1999.5"]) == [2000]
    assert values(lambda c: N.minor_units_truncated(c, F.lit(2)), ["19.9", "19.999", "19", "a"]) == [1990, 1999, 1900, None]
    assert [float(v) if v is not None else None for v in values(N.decimal_amount, ["1.299,50 €", "1,299", "$ 12.5", "12'300.00", "free"])] == [1299.5, 1299.0, 12.5, 12300.0, None]
    marks = values(lambda c: N.currency_from_text(F.lit(None).cast("string"), c), ["5 €", "A$ 3", "$ 3", "5"])
    assert marks == ["EUR", "AUD", "USD", None]


def test_durations_views_boxes(values, spark):
    assert values(N.duration_seconds, ["1:02:03", "2:03", "1:99", "7", "a:b"]) == [3723, 123, None, None, None]
    assert values(N.exact_view_count, ["1,234 views", "No views", "1.2K views", "12 Aufrufe"]) == [1234, 0, None, 12]
    row = spark.range(1).select(N.bounding_box(F.lit(None).cast("array<double>"), F.array(*[F.lit(v) for v in (1.0, 9.0, 3.0, 5.0)])).alias("b")).first()
    assert row.b == [1.0, 5.0, 3.0, 9.0]


def test_dates(values):
    shown = values(lambda c: D.iso(D.parse_date(c)), ["2024-02-03T04:05:06+01:00", "Sat, 03 Feb 2024 04:05:06 GMT", "Feb 3, 2024", "2024-02-03 04:05:06", "soon"])
    assert shown == ["2024-02-03T03:05:06.000Z", "2024-02-03T04:05:06.000Z", "2024-02-03T00:00:00.000Z", "2024-02-03T04:05:06.000Z", None]
    ages = values(D.displayed_age_ms, ["3 weeks ago", "today", "yesterday", "just now", "2 months ago", "later"])
    assert ages == [1814400000.0, 43200000.0, 86400000.0, 0.0, 5184000000.0, None]


def test_keyed_hash_equals_hmac(values):
    import hashlib
    import hmac

    from factloom.functions import ids

    for secret in ("k", "s" * 64, "long" * 40):
        want = [hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest() for m in ("", "a\nb", "ü")]
        assert values(lambda c: ids.keyed_hash(c, secret), ["", "a\nb", "ü"]) == want
