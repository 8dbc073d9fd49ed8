"""Price history, snapshots, movers, currency conversion and series scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions import text as T
from factloom.functions.numbers import market_round
from factloom.operators.ordered import as_of, keep_first, last_n, top_k

# Interval of every timeframe, and how far a timeframe reaches back.
TIMEFRAME_INTERVALS = {
    "1d": "5m", "5d": "15m", "1mo": "1d", "3mo": "1d", "6mo": "1d", "1y": "1d", "5y": "1wk", "max": "1mo",
}
TIMEFRAME_SPANS = {
    "1d": "1 DAY", "5d": "5 DAY", "1mo": "1 MONTH", "3mo": "3 MONTH", "6mo": "6 MONTH", "1y": "1 YEAR", "5y": "5 YEAR",
}
HISTORY_LIMIT = 512
EVENT_LIMIT = 128
# Titles of the mover lists.
LIST_TITLES = {"gainers": "Daily stock gainers", "losers": "Daily stock losers", "active": "Most active stocks"}


def interval_start(ts: Column, interval: str) -> Column:
    """Start of the bar that holds a timestamp."""
    if interval in ("5m", "15m"):
        span = 300 if interval == "5m" else 900
        return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / span) * span)
    return F.date_trunc({"1d": "day", "1wk": "week", "1mo": "month"}[interval], ts)


def resample(ticks: DataFrame, interval: str, order: Sequence[str], key: str = "symbol") -> DataFrame:
    """Open, high, low, close and volume per symbol and bar. Pre-aggregates on the map side."""
    position = F.struct(*[F.col(c) for c in order])
    return ticks.groupBy(key, interval_start(F.col("ts"), interval).alias("bar")).agg(
        F.min_by("price", position).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", position).alias("close"), F.sum("volume").cast("long").alias("volume"),
    )


def price_history(ticks: DataFrame, timeframe: str, as_of_ts: Column, order: Sequence[str], limit: int = HISTORY_LIMIT) -> DataFrame:
    """Bars of a timeframe that ends at `as_of_ts`, the latest `limit` per symbol."""
    rows = ticks.filter(F.col("ts") <= as_of_ts)
    if timeframe in TIMEFRAME_SPANS:
        rows = rows.filter(F.col("ts") > as_of_ts - F.expr(f"INTERVAL {TIMEFRAME_SPANS[timeframe]}"))
    return last_n(resample(rows, TIMEFRAME_INTERVALS[timeframe], order), ["symbol"], "bar", limit)


def market_events(dividends: DataFrame, splits: DataFrame, limit: int = EVENT_LIMIT) -> DataFrame:
    """Dividends and splits in one table, the latest `limit` per symbol; `pos` counts them from the oldest."""
    both = dividends.withColumn("type", F.lit("dividend")).unionByName(
        splits.withColumn("type", F.lit("split")), allowMissingColumns=True)
    kept = top_k(both, ["symbol"], [F.col("ts").desc(), F.col("type").desc()], limit, "_recent").drop("_recent")
    oldest_first = Window.partitionBy("symbol").orderBy("ts", "type")
    return kept.withColumn("pos", F.row_number().over(oldest_first).cast("long"))  # at most `limit` rows per symbol


def snapshot(bars: DataFrame, meta: DataFrame | None = None, key: str = "symbol", ts: str = "bar") -> DataFrame:
    """Last price, previous close and change per symbol, with the range and volume of the last bar and of 52 weeks.

    The price is the reported one when `meta` (symbol, market_price, previous_close) has it, else the last
    close; the previous close is the second last close, else the reported one.
    """
    closed = bars.filter(F.col("close").isNotNull())
    two = top_k(closed, [key], [F.col(ts).desc()], 2)
    latest = two.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(ts))).alias("ts"),
        F.max(F.when(F.col("rank") == 1, F.col("close"))).alias("last_close"),
        F.max(F.when(F.col("rank") == 2, F.col("close"))).alias("second_close"),
        F.max(F.when(F.col("rank") == 1, F.col("high"))).alias("day_high"),
        F.max(F.when(F.col("rank") == 1, F.col("low"))).alias("day_low"),
        F.max(F.when(F.col("rank") == 1, F.col("volume"))).alias("volume"),
    )
    reported, previous = F.lit(None).cast("double"), F.lit(None).cast("double")
    if meta is not None:
        latest = latest.join(meta.select(key, "market_price", "previous_close"), key, "left")
        reported, previous = F.col("market_price"), F.col("previous_close")
    latest = latest.select(
        key, "ts", F.coalesce(reported, "last_close").alias("price"), F.coalesce("second_close", previous).alias("previous"),
        "day_high", "day_low", "volume",
    )
    year = closed.join(latest.select(key, F.col("ts").alias("_last")), key).filter(
        F.col(ts) > F.col("_last") - F.expr("INTERVAL 364 DAYS")
    ).groupBy(key).agg(F.max("high").alias("year_high"), F.min("low").alias("year_low"))
    change = market_round(F.col("price") - F.col("previous"))
    percent = F.when(F.col("previous") != 0, market_round(change / F.col("previous") * 100, 6))
    return latest.join(year, key).select(
        key, "ts", "price", F.col("previous").alias("previous_close"), change.alias("change"), percent.alias("change_percent"),
        "day_high", "day_low", "year_high", "year_low", "volume",
    )


def movers(quotes: DataFrame, which: str, limit: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """The best `limit` quotes of a list: gainers, losers or active. Each task keeps `limit` rows before the shuffle."""
    order = {
        "gainers": [F.col("change_percent").desc()], "losers": [F.col("change_percent").asc()], "active": [F.col("volume").desc()],
    }[which]
    known = quotes.filter(F.col("volume" if which == "active" else "change_percent").isNotNull())
    if group:
        return top_k(known, group, [*order, F.col("symbol")], limit, "pos")
    best = known.orderBy(*order, "symbol").limit(limit)
    whole = Window.partitionBy(F.lit(0)).orderBy(*order, "symbol")
    return best.withColumn("pos", F.row_number().over(whole).cast("long"))  # at most `limit` rows


def fx_series(rates: DataFrame, source: str, quote: str) -> DataFrame:
    """(ts, close) of a currency pair: the direct series, else the inverted opposite one.

    `rates` has pair, ts, close; only positive rates count.
    """
    usable = rates.filter(F.col("close") > 0)
    direct = usable.filter(F.col("pair") == source + quote).select(F.lit(0).alias("_way"), "ts", "close")
    inverse = usable.filter(F.col("pair") == quote + source).select(
        F.lit(1).alias("_way"), "ts", market_round(F.lit(1.0) / F.col("close")).alias("close"))
    both = direct.unionByName(inverse)
    chosen = both.agg(F.min("_way").alias("_chosen"))
    return both.join(F.broadcast(chosen), F.col("_way") == F.col("_chosen")).select("ts", "close")  # one row


def listing_series(rates: DataFrame, quote: str) -> DataFrame:
    """(currency, ts, close): what one unit of each currency is worth in `quote`, from the direct pair, else from the inverted opposite one.

    `rates` has pair, ts, close; only positive rates count.
    """
    usable = rates.filter((F.col("close") > 0) & (F.length("pair") == 6))
    base, other = F.substring("pair", 1, 3), F.substring("pair", 4, 3)
    way = F.when(other == quote, 0).when(base == quote, 1)
    rows = usable.withColumn("_way", way).filter("_way is not null").select(
        F.when(F.col("_way") == 0, base).otherwise(other).alias("currency"), "ts", "_way",
        F.when(F.col("_way") == 0, F.col("close")).otherwise(market_round(F.lit(1.0) / F.col("close"))).alias("close"))
    chosen = rows.groupBy("currency").agg(F.min("_way").alias("_way"))
    return rows.join(chosen, ["currency", "_way"]).drop("_way")


def convert_listed(points: DataFrame, rates: DataFrame, quote: str, columns: Sequence[str], ts: str = "ts", unit: str = "currency", chunk_seconds: int = 86_400) -> DataFrame:
    """Money columns of points in many listing currencies, in one quote currency: adds `rate` and `error_code`.

    A point already in the quote currency stays as it is, at rate 1. A listing unit that is no currency code (GBp counts pence) and a currency
    without a rate cannot be converted: `upstream_error`, and no money. Else the rate is the last one at or before the point, or the earliest.
    Only the distinct (currency, time) pairs are put in order with the rates, a day of one currency to a group.
    """
    listing = F.col(unit)
    strict = F.coalesce(listing.rlike("^[A-Z]{3}$"), F.lit(False))
    asked = points.filter(strict & (listing != quote)).select(listing.alias("_unit"), F.col(ts).alias("_at")).distinct()
    series = listing_series(rates, quote).select(F.col("currency").alias("_unit"), F.col("ts").alias("_fx_ts"), F.col("close").alias("_rate"))
    known = as_of(asked, series, ["_unit"], "_at", "_fx_ts", ["_rate"], chunk_seconds).select("_unit", "_at", "_rate")
    earliest = series.groupBy("_unit").agg(F.min_by("_rate", "_fx_ts").alias("_first"))
    rated = known.join(earliest, "_unit", "left").select("_unit", "_at", F.coalesce("_rate", "_first").alias("_rate"))
    joined = points.join(rated, (listing == F.col("_unit")) & (F.col(ts) == F.col("_at")), "left")
    rate = F.when(strict & (listing == quote), F.lit(1.0)).otherwise(F.col("_rate"))
    out = joined.withColumn("rate", rate)
    money = lambda c: F.when(listing == quote, F.col(c)).otherwise(market_round(F.col(c) * F.col("rate"))).alias(c)
    return out.select(*[money(c) if c in columns else F.col(c) for c in points.columns], "rate", F.when(F.col("rate").isNull(), F.lit("upstream_error")).alias("error_code"))


def convert_currency(
    points: DataFrame, fx: DataFrame, columns: Sequence[str], ts: str = "ts", spot: Column | None = None,
    chunk_seconds: int = 86_400,
) -> DataFrame:
    """Money columns times the rate valid at each point; volume and percentages stay as they are.

    The rate is the last one at or before the point, else the earliest, else `spot`. It depends on the time alone, so only
    the distinct times, a day to a group, are put in order with the rates; the points then join their time.
    """
    pair = F.lit(0).alias("_pair")
    right = fx.select(pair, F.col("ts").alias("_fx_ts"), F.col("close").alias("_rate"))
    times = points.select(pair, F.col(ts).alias("_at")).distinct()
    known = as_of(times, right, ["_pair"], "_at", "_fx_ts", ["_rate"], chunk_seconds).select("_pair", "_at", "_rate")
    rated = points.join(known, F.col(ts).eqNullSafe(F.col("_at")))
    earliest = fx.groupBy(pair).agg(F.min_by("close", "ts").alias("_earliest"))  # one row
    last_resort = spot if spot is not None else F.lit(None).cast("double")
    out = rated.join(F.broadcast(earliest), "_pair", "left").withColumn("rate", F.coalesce("_rate", "_earliest", last_resort))
    money = lambda c: market_round(F.col(c) * F.col("rate")).alias(c)
    return out.select(*[money(c) if c in columns else F.col(c) for c in points.columns], "rate")


def minmax_scale(points: DataFrame, key: str, value: str, padding: float = 0.08) -> DataFrame:
    """Adds `scaled` in 0..1 of the padded range per key; a flat series is padded by 1 % or 1."""
    ends = points.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.greatest(F.abs(F.col("_lo")) * 0.01, F.lit(1.0))
    pad = F.when(F.col("_lo") == F.col("_hi"), flat).otherwise((F.col("_hi") - F.col("_lo")) * padding)
    low, high = F.col("_lo") - pad, F.col("_hi") + pad
    return points.join(ends, key).withColumn("scaled", (F.col(value) - low) / (high - low)).drop("_lo", "_hi")


def compact_number(c: Column) -> Column:
    """Thousands separated, at most six decimals, no trailing zeros."""
    whole = F.regexp_replace(F.format_number(c, 6), r"\.?0+$", "")
    return whole


def history_table(bars: DataFrame, key: str = "symbol", ts: str = "bar", limit: int = HISTORY_LIMIT) -> DataFrame:
    """Markdown price table per symbol over its latest `limit` bars."""
    cell = lambda n: F.coalesce(compact_number(F.col(n)), F.lit("—"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.date_format(ts, "yyyy-MM-dd"), cell("open"), cell("high"), cell("low"),
                                            cell("close"), cell("volume")), F.lit(" |"))
    rows = last_n(bars, [key], ts, limit).withColumn("_row", F.struct(F.col(ts).alias("t"), row.alias("r")))
    head = "| Date | Open | High | Low | Close | Volume |\n| --- | ---: | ---: | ---: | ---: | ---: |"
    body = F.transform(F.array_sort(F.collect_list("_row")), lambda x: x["r"])
    return rows.groupBy(key).agg(F.concat(F.lit(head + "\n"), F.array_join(body, "\n")).alias("markdown"))


def cheapest_offers(offers: DataFrame, key: str, price: str, order: Sequence[str]) -> DataFrame:
    """The cheapest priced offer per key, ties by position."""
    return keep_first(offers.filter(F.col(price).isNotNull()), [key], [price, *order])


def any_in_stock(state: Column, position: Column) -> Column:
    """Aggregate: InStock when any offer is, else the first state."""
    return F.when(F.bool_or(F.lower(state) == "instock"), F.lit("InStock")).otherwise(F.min_by(state, position))


def search_symbols(queries: DataFrame, listings: DataFrame, instrument: str = "EQUITY", limit: int = 10) -> DataFrame:
    """Listings that match a query by name or symbol: right type, valid and unique symbol, best ten."""
    from factloom.operators.search import rank_results, relevance_join

    valid = listings.filter((F.upper("quote_type") == instrument) & F.upper("symbol").rlike(r"^[A-Z0-9.^=-]{1,32}$"))
    unique = keep_first(valid.withColumn("symbol", F.upper("symbol")), ["symbol"], ["position"])
    corpus = unique.withColumn("doc_id", F.col("position"))
    matched = relevance_join(queries, corpus, F.concat_ws(" ", "symbol", "name"))
    return rank_results(matched, limit)


def normalize_symbol(c: Column) -> Column:
    symbol = F.upper(F.trim(c))
    return F.when(symbol.rlike(r"^[A-Z0-9.^=-]{1,32}$"), symbol)


def with_localized_names(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join of a lookup table, broadcast only when its size is within the limit."""
    return df.join(dimension, key, "left")


def mover_markdown(title: Column, items: Column) -> Column:
    """Numbered list of quotes: array<struct<pos, name, symbol, url, details>>."""
    e = T.escape_markdown
    lines = F.transform(F.array_sort(items), lambda i: F.concat(
        i["pos"].cast("string"), F.lit(". ["), e(i["name"]), F.lit(" ("), e(i["symbol"]), F.lit(")]("), i["url"], F.lit(")"),
        F.when(i["details"] != "", F.concat(F.lit(" — "), e(i["details"]))).otherwise(F.lit(""))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), title)), lines), "\n\n")
