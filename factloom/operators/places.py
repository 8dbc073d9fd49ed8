"""Place rows ranked by distance, addresses and map links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import text as T
from factloom.functions.numbers import planar_distance
from factloom.operators.ordered import top_k

# German names of searched categories.
GERMAN_CATEGORIES = (
    ("bakery", "Bäcker"), ("bakeries", "Bäcker"), ("baker", "Bäcker"), ("pharmacy", "Apotheke"), ("pharmacies", "Apotheke"),
    ("drugstore", "Drogerie"), ("grocery store", "Supermarkt"), ("supermarket", "Supermarkt"), ("coffee shop", "Café"),
    ("gas station", "Tankstelle"), ("petrol station", "Tankstelle"), ("hospital", "Krankenhaus"),
)


def localized_category(query: Column, country: Column) -> Column:
    word = query
    for english, german in GERMAN_CATEGORIES:
        word = F.when((country == "DE") & (F.lower(query) == english), F.lit(german)).otherwise(word)
    return word


def nearest(items: DataFrame, queries: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Items of a query ordered by distance to its point, the first `limit`; items meet their own query only.

    `queries` has key, at_lat, at_lon; `items` has key, lat, lon, position.
    """
    pairs = items.join(queries.select(key, "at_lat", "at_lon"), key)
    measured = pairs.withColumn("distance", planar_distance(F.col("lat"), F.col("lon"), F.col("at_lat"), F.col("at_lon")))
    return top_k(measured, [key], [F.col("distance"), F.col("position")], limit, "pos").drop("at_lat", "at_lon")


def address(props: Column, title: Column) -> Column:
    """Street line, city line, county, state and country without repeats and without the title."""
    text = lambda name: T.blank_to_null(T.collapse(props[name]))
    city = F.coalesce(text("city"), text("locality"), text("district"))
    state = F.when(F.lower(text("state")) == F.lower(city), F.lit(None)).otherwise(text("state"))
    parts = F.array(
        T.join_present(" ", text("street"), text("housenumber")), T.join_present(" ", text("postcode"), city),
        text("county"), state, text("country"))
    kept = F.filter(T.distinct_ignore_case(parts), lambda p: F.lower(p) != F.lower(title))
    return T.blank_to_null(F.array_join(kept, ", "))


def map_url(osm_type: Column, osm_id: Column, lat: Column, lon: Column) -> Column:
    """Link of the mapped object, else of the point."""
    kind = F.when(F.upper(osm_type) == "N", "node").when(F.upper(osm_type) == "W", "way").when(F.upper(osm_type) == "R", "relation")
    at = [lat.cast("string"), lon.cast("string")]
    return F.when(
        kind.isNotNull() & (osm_id > 0), F.concat(F.lit("https://www.openstreetmap.org/"), kind, F.lit("/"), osm_id.cast("string"))
    ).otherwise(F.concat(F.lit("https://www.openstreetmap.org/?mlat="), at[0], F.lit("&mlon="), at[1], F.lit("#map=16/"), at[0], F.lit("/"), at[1]))
