"""Jobs over trades, rates, parts and places, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.operators import market as M
from factloom.operators import places
from factloom.operators.joins import enrich
from factloom.operators.ordered import previous, time_chunk
from factloom.plans.tables import TICK_ORDER, fx_rates, register_into, table, ticks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register_into(QUERIES, ORACLES)

TICKS_SQL = """ticks as (select l_partkey as symbol, l_shipdate as ts, l_extendedprice / l_quantity as price, cast(l_quantity as bigint) as volume,
  (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice / l_quantity, cast(l_quantity as bigint)) as o from lineitem)"""


def bars_sql(unit: str, where: str = "true") -> str:
    return f"""{TICKS_SQL}, bars as (select symbol, date_trunc('{unit}', ts) as bar, arg_min(price, o) as open, max(price) as high, min(price) as low,
  arg_max(price, o) as close, cast(sum(volume) as bigint) as volume from ticks where {where} group by all)"""


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


BAR_COLUMNS = "symbol, strftime(bar, '%Y-%m-%d') as bar, open, high, low, close, volume"


@query(f"with {bars_sql('month')} select {BAR_COLUMNS} from bars")
def ohlc_resample_month(spark, folder):
    """Monthly bars."""
    return M.resample(ticks(spark, folder), "1mo", TICK_ORDER).withColumn("bar", day("bar"))


@query(f"with {bars_sql('week')} select {BAR_COLUMNS} from bars")
def ohlc_resample_week(spark, folder):
    """Weekly bars."""
    return M.resample(ticks(spark, folder), "1wk", TICK_ORDER).withColumn("bar", day("bar"))


@query(f"""with {TICKS_SQL}, bars as (select symbol, time_bucket(interval '15 minutes', ts) as bar, arg_min(price, o) as open, max(price) as high,
  min(price) as low, arg_max(price, o) as close, cast(sum(volume) as bigint) as volume from ticks group by all)
select symbol, strftime(bar, '%Y-%m-%d %H:%M') as bar, open, high, low, close, volume from bars""")
def ohlc_resample_quarter_hour(spark, folder):
    """Bars of 15 minutes."""
    return M.resample(ticks(spark, folder), "15m", TICK_ORDER).withColumn("bar", F.date_format("bar", "yyyy-MM-dd HH:mm"))


HISTORY_END = "2001-08-01"


@query(f"""with {bars_sql('week', f"ts <= timestamp '{HISTORY_END}' and ts > timestamp '{HISTORY_END}' - interval 5 year")}
select {BAR_COLUMNS} from (select *, row_number() over (partition by symbol order by bar desc) as r from bars) where r <= 20""")
def price_history_last_n(spark, folder):
    """Five years of weekly bars, the latest 20 per symbol."""
    end = F.lit(HISTORY_END).cast("timestamp")
    return M.price_history(ticks(spark, folder), "5y", end, TICK_ORDER, 20).withColumn("bar", day("bar"))


ROUND8 = "floor(({0} + 2.220446049250313e-16) * 100000000.0 + 0.5) / 100000000.0"
ROUND6 = "floor(({0} + 2.220446049250313e-16) * 1000000.0 + 0.5) / 1000000.0"
CHANGE_SQL = ROUND8.format("(price - previous_close)")
SNAPSHOT_SQL = f"""{bars_sql('day')},
ranked as (select *, row_number() over (partition by symbol order by bar desc) as r, max(bar) over (partition by symbol) as last from bars),
snap as (select symbol, max(bar) as ts, max(case when r = 1 then close end) as price, max(case when r = 2 then close end) as previous_close,
  max(case when r = 1 then high end) as day_high, max(case when r = 1 then low end) as day_low,
  max(case when bar > last - interval 364 day then high end) as year_high, min(case when bar > last - interval 364 day then low end) as year_low,
  max(case when r = 1 then volume end) as volume from ranked group by symbol),
quotes as (select symbol, strftime(ts, '%Y-%m-%d') as ts, price, previous_close, {CHANGE_SQL} as change,
  {ROUND6.format(f"({CHANGE_SQL}) / previous_close * 100")} as change_percent, day_high, day_low, year_high, year_low, volume from snap)"""


def daily_quotes(spark, folder):
    return M.snapshot(M.resample(ticks(spark, folder), "1d", TICK_ORDER)).withColumn("ts", day("ts"))


@query(f"with {SNAPSHOT_SQL} select * from quotes")
def market_snapshot(spark, folder):
    """Last price, change and ranges per symbol."""
    return daily_quotes(spark, folder)


def movers_sql(order: str, known: str) -> str:
    return f"""with {SNAPSHOT_SQL} select row_number() over (order by {order}, symbol) as pos, symbol, p_name as name, price, change_percent, volume
  from quotes join part on symbol = p_partkey where {known} is not null qualify pos <= 10"""


def mover_rows(spark, folder, which):
    best = M.movers(daily_quotes(spark, folder), which)
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"))
    return enrich(best, names, ["symbol"]).select("pos", "symbol", "name", "price", "change_percent", "volume")


@query(movers_sql("change_percent desc", "change_percent"))
def movers_gainers(spark, folder):
    """Largest daily gains."""
    return mover_rows(spark, folder, "gainers")


@query(movers_sql("change_percent", "change_percent"))
def movers_losers(spark, folder):
    """Largest daily losses."""
    return mover_rows(spark, folder, "losers")


@query(movers_sql("volume desc", "volume"))
def movers_active(spark, folder):
    """Largest daily volume."""
    return mover_rows(spark, folder, "active")


@query(f"""with {SNAPSHOT_SQL}, joined as (select p_brand as brand, symbol, change_percent from quotes join part on symbol = p_partkey where change_percent is not null)
select brand, symbol, change_percent, row_number() over (partition by brand order by change_percent desc, symbol) as pos from joined qualify pos <= 3""")
def movers_by_brand(spark, folder):
    """Three largest gains per brand."""
    brands = table(spark, folder, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("brand"))
    quotes = daily_quotes(spark, folder).join(brands, "symbol")
    return M.movers(quotes, "gainers", 3, ["brand"]).select("brand", "symbol", "change_percent", "pos")


FX_SQL = """fx as (select date_trunc('day', o_orderdate) as ts, floor(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) / 100000 * 100000000.0 + 0.5) / 100000000.0 as close
  from orders group by all)"""


@query(f"""with {bars_sql('day')}, {FX_SQL},
rated as (select b.*, coalesce(f.close, (select arg_min(close, ts) from fx)) as rate from bars b asof left join fx f on b.bar >= f.ts)
select symbol, strftime(bar, '%Y-%m-%d') as bar, {ROUND8.format('open * rate')} as open, {ROUND8.format('high * rate')} as high,
  {ROUND8.format('low * rate')} as low, {ROUND8.format('close * rate')} as close, volume, rate from rated""")
def fx_asof_convert(spark, folder):
    """Daily bars at the last known rate."""
    bars = M.resample(ticks(spark, folder), "1d", TICK_ORDER)
    return M.convert_currency(bars, fx_rates(spark, folder), ["open", "high", "low", "close"], "bar").withColumn("bar", day("bar"))


# Five listing units: the quote currency itself, one with a direct pair, one with the opposite pair, one without any, and a subunit.
@query(f"""with {bars_sql('day')}, {FX_SQL},
series as (select 'USD' as unit, ts, close from fx where close > 0 union all select 'JPY', ts, {ROUND8.format('1.0 / close')} from fx where close > 0),
b as (select *, ['EUR', 'USD', 'JPY', 'CHF', 'GBp'][(symbol % 5) + 1] as unit from bars),
rated as (select b.*, case when b.unit = 'EUR' then 1.0 else coalesce(f.close, (select arg_min(close, ts) from series s where s.unit = b.unit)) end as rate from b asof left join series f on b.unit = f.unit and b.bar >= f.ts)
select symbol, strftime(bar, '%Y-%m-%d') as bar, unit as currency, case when unit = 'EUR' then open else {ROUND8.format('open * rate')} end as open,
  case when unit = 'EUR' then close else {ROUND8.format('close * rate')} end as close, volume, rate, case when rate is null then 'upstream_error' end as error_code from rated""")
def fx_listed_convert(spark, folder):
    """Bars in five listing units converted to one currency; no-op, inverted pair, missing pair and subunit included."""
    units = F.array(*[F.lit(u) for u in ("EUR", "USD", "JPY", "CHF", "GBp")])
    bars = M.resample(ticks(spark, folder), "1d", TICK_ORDER).select("symbol", "bar", F.element_at(units, (F.col("symbol") % 5 + 1).cast("int")).alias("currency"), "open", "close", "volume")
    daily = fx_rates(spark, folder)
    rates = daily.withColumn("pair", F.explode(F.array(F.lit("USDEUR"), F.lit("EURJPY"), F.lit("EURUSD"), F.lit("USDGBP"))))
    return M.convert_listed(bars, rates, "EUR", ["open", "close"], "bar").withColumn("bar", day("bar"))


@query(f"""with {FX_SQL} select strftime(ts, '%Y-%m-%d') as ts, {ROUND8.format('1.0 / close')} as close from fx where close > 0""")
def fx_inverse_series(spark, folder):
    """M3: only the opposite pair is quoted, so its positive rates are inverted."""
    rates = fx_rates(spark, folder).withColumn("pair", F.lit("EURUSD"))
    return M.fx_series(rates, "USD", "EUR").withColumn("ts", day("ts"))


@query("""select p_partkey, cur as currency, cast(floor(cast(p_retailprice as decimal(18,4)) * case when cur in ('JPY','KRW') then 1 else 100 end + 0.5) as bigint) as units,
  case when cur in ('JPY','KRW') then cast(cast(floor(cast(p_retailprice as decimal(18,4)) + 0.5) as bigint) as varchar)
    else cast(cast(floor(cast(p_retailprice as decimal(18,4)) * 100 + 0.5) as decimal(18,0)) / 100 as decimal(18,2))::varchar end || ' ' || cur as display
  from (select *, ['EUR','USD','JPY','KRW'][(p_partkey % 4) + 1] as cur from part)""")
def minor_unit_prices(spark, folder):
    """Part prices in integer minor units of their currency."""
    currency = F.element_at(F.array(*[F.lit(c) for c in ("EUR", "USD", "JPY", "KRW")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    priced = table(spark, folder, "part").withColumn("currency", currency).withColumn(
        "units", N.minor_units(F.col("p_retailprice").cast("decimal(18,4)"), F.col("currency")))
    return priced.select(
        "p_partkey", "currency", "units", N.price_display(F.col("units"), N.currency_digits(F.col("currency")), F.col("currency")).alias("display"))


@query("""with o as (select l_partkey, l_suppkey, l_extendedprice / l_quantity as price, l_returnflag, l_orderkey, l_linenumber from lineitem)
select l_partkey, p_name as name, min(price) as price, arg_min(l_suppkey, (price, l_orderkey, l_linenumber, l_suppkey)) as seller,
  case when bool_or(l_returnflag = 'N') then 'InStock' else arg_min(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, price)) end as availability, count(*) as offers
  from o join part on l_partkey = p_partkey group by l_partkey, p_name""")
def cheapest_offer(spark, folder):
    """Cheapest offer per part, and whether any is in stock."""
    offers = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_returnflag", "l_orderkey", "l_linenumber")
    state = F.when(F.col("l_returnflag") == "N", "InStock").otherwise(F.col("l_returnflag"))
    summed = offers.groupBy("l_partkey").agg(
        F.min("price").alias("price"), F.min_by("l_suppkey", F.struct("price", "l_orderkey", "l_linenumber", "l_suppkey")).alias("seller"),
        M.any_in_stock(state, F.struct("l_orderkey", "l_linenumber", "l_suppkey", "price")).alias("availability"), F.count(F.lit(1)).alias("offers"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return summed.join(parts, "l_partkey")


@query("""with asked as (select item_id as query_id, ['red widget','hot gear','small bolt','blue ring spring'][(item_id % 4) + 1] as q from benchmark),
terms as (select query_id, string_split(q, ' ') as terms from asked),
listed as (select 'P' || p_partkey as symbol, p_partkey as position, string_split('p' || p_partkey || ' ' || p_name, ' ') as words from part where p_size % 2 = 0)
select query_id, symbol, cast(len(list_intersect(terms, words)) as bigint) as matched, row_number() over (partition by query_id order by len(list_intersect(terms, words)) desc, position) as pos
from terms, listed where len(list_intersect(terms, words)) >= len(terms) // 2 + 1 qualify pos <= 10""")
def symbol_search(spark, folder):
    """M6, P20: parts as listings, searched by name; odd sizes are another instrument."""
    wanted = F.array(*[F.lit(q) for q in ("red widget", "hot gear", "small bolt", "blue ring spring")])
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.element_at(wanted, (F.col("item_id") % 4 + 1).cast("int")).alias("query"))
    kind = F.when(F.col("p_size") % 2 == 0, "EQUITY").otherwise("CRYPTOCURRENCY")
    listings = table(spark, folder, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.col("p_partkey").alias("position"), kind.alias("quote_type"))
    return M.search_symbols(asked, listings).select("query_id", "symbol", "matched", "pos")


@query(f"""with {bars_sql('month')}, e as (select symbol, min(close) as lo, max(close) as hi from bars group by symbol),
p as (select symbol, lo - case when lo = hi then greatest(abs(lo) * 0.01, 1.0) else (hi - lo) * 0.08 end as lo, hi + case when lo = hi then greatest(abs(lo) * 0.01, 1.0) else (hi - lo) * 0.08 end as hi from e)
select symbol, strftime(bar, '%Y-%m-%d') as bar, floor((close - lo) / (hi - lo) * 100000000.0 + 0.5) / 100000000.0 as scaled from bars join p using (symbol)""")
def series_minmax_scale(spark, folder):
    """Monthly closes on a padded scale."""
    bars = M.resample(ticks(spark, folder), "1mo", TICK_ORDER).select("symbol", "bar", "close")
    scaled = M.minmax_scale(bars, "symbol", "close")
    return scaled.select("symbol", day("bar").alias("bar"), N.round_half_up(F.col("scaled"), 8).alias("scaled"))


@query(f"""with {bars_sql('week')} select symbol, strftime(bar, '%Y-%m-%d') as bar, close, lag(close) over (partition by symbol order by bar) as previous from bars""")
def previous_close(spark, folder):
    """Each weekly close with the one before."""
    bars = M.resample(ticks(spark, folder), "1wk", TICK_ORDER).select("symbol", "bar", "close")
    out = previous(bars, ["symbol"], [F.col("bar")], time_chunk(F.col("bar"), 365 * 86_400), {"previous": F.col("close")})
    return out.withColumn("bar", day("bar"))


@query("""with c as (select c_custkey, c_nationkey, (c_custkey * 37 % 1800) / 10.0 - 90 as lat, (c_custkey * 91 % 3600) / 10.0 - 180 as lon from customer),
n as (select n_nationkey, n_nationkey * 3.0::double - 36 as at_lat, n_nationkey * 7.0::double - 80 as at_lon from nation),
d as (select c_nationkey, c_custkey, floor(((lat - at_lat) * (lat - at_lat) + ((lon - at_lon) * cos(at_lat * 3.141592653589793::double / 180)) * ((lon - at_lon) * cos(at_lat * 3.141592653589793::double / 180))) * 1000 + 0.5) / 1000 as distance from c join n on c_nationkey = n_nationkey)
select c_nationkey as nation, c_custkey as place, distance, row_number() over (partition by c_nationkey order by distance, c_custkey) as pos from d qualify pos <= 10""")
def nearest_points(spark, folder):
    """Customers as places, the ten nearest to the point of their own country."""
    key = F.col("c_custkey")
    items = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), key.alias("position"), ((key * 37 % 1800) / 10.0 - 90).alias("lat"), ((key * 91 % 3600) / 10.0 - 180).alias("lon"))
    points = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") * 3.0 - 36).alias("at_lat"), (F.col("n_nationkey") * 7.0 - 80).alias("at_lon"))
    at = places.nearest(items, points, "nation", 10)
    return at.select("nation", F.col("position").alias("place"), N.round_half_up(F.col("distance"), 3).alias("distance"), "pos")


NUMBER_SQL = r"regexp_replace(format('{{:,.6f}}', cast({} as double)), '\.?0+$', '')"
CELLS_SQL = " || ' | ' || ".join(NUMBER_SQL.format(c) for c in ("open", "high", "low", "close", "volume"))


@query(f"""with {bars_sql('month')}, r as (select *, row_number() over (partition by symbol order by bar desc) as n from bars),
f as (select symbol, bar, '| ' || strftime(bar, '%Y-%m-%d') || ' | ' || {CELLS_SQL} || ' |' as line from r where n <= 6)
select symbol, '| Date | Open | High | Low | Close | Volume |' || chr(10) || '| --- | ---: | ---: | ---: | ---: | ---: |' || chr(10) || string_agg(line, chr(10) order by bar) as markdown from f group by symbol""")
def price_table_markdown(spark, folder):
    """The last six months of a symbol as a Markdown table, all price columns."""
    return M.history_table(M.resample(ticks(spark, folder), "1mo", TICK_ORDER), limit=6)


@query(f"""with {TICKS_SQL}, d as (select symbol, ts, 'dividend' as type, price as amount, volume as ratio from ticks where volume % 2 = 0
   union all select symbol, ts, 'split', null, volume from ticks where volume % 2 = 1),
g as (select symbol, ts, type, min(amount) as amount, min(ratio) as ratio from d group by all),
k as (select *, row_number() over (partition by symbol order by ts desc, type desc) as r from g)
select symbol, strftime(ts, '%Y-%m-%d') as ts, type, amount, row_number() over (partition by symbol order by ts, type) as pos from k where r <= 10""")
def market_event_list(spark, folder):
    """Even trades as dividends and odd ones as splits, the latest ten in order."""
    t = ticks(spark, folder)
    dividends = t.filter(F.col("volume") % 2 == 0).groupBy("symbol", "ts").agg(F.min("price").alias("amount"))
    splits = t.filter(F.col("volume") % 2 == 1).select("symbol", "ts").distinct()
    return M.market_events(dividends, splits, 10).select("symbol", day("ts").alias("ts"), "type", "amount", "pos")
