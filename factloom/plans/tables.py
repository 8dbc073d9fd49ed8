"""The input tables, and the same tables re-read as ticks, meter events, payments and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TICK_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "price", "volume"]


def register_into(queries: dict, oracles: dict):
    """Decorator that names a job after its function and keeps the SQL that checks it."""
    def query(sql: str | None = None):
        def register(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracles[fn.__name__] = sql
            return fn

        return register

    return query


# Tables whose rows are long texts; working on a row costs more than dealing it out.
TEXT_TABLES = ("pages", "documents", "conversations")


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, dealt out to all cores if their files hold fewer splits than that.

    A file of one row group is one split however Spark is set up. Tables of as many splits as cores are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; timestamps without a zone are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in TEXT_TABLES:
        df = dealt(df)
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as trades: symbol, ts, unit price, volume."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("symbol"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("long").alias("volume"),
        "l_orderkey", "l_linenumber", "l_suppkey",
    )


def fx_rates(spark: SparkSession, folder: str) -> DataFrame:
    """orders as a daily rate series: ts, close (rounded to 8 digits)."""
    daily = table(spark, folder, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 100000).alias("close")
    )
    return daily.select("ts", (F.floor(F.col("close") * 1e8 + 0.5) / 1e8).alias("close"))


def meter_events(spark: SparkSession, folder: str) -> DataFrame:
    """events as metering: purchases grant whole credits, clicks commit one credit, errors refund a click's credit."""
    kind = (
        F.when(F.col("event_type") == "purchase", "grant").when(F.col("event_type") == "click", "commit")
        .when(F.col("event_type") == "error", "refund")
    )
    return table(spark, folder, "events").withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), "ts", "kind",
        F.when(F.col("kind") == "grant", F.greatest(F.floor("value"), F.lit(1)))
        .when(F.col("kind") == "commit", -1).otherwise(1).cast("long").alias("credits"),
    )


def payment_events(spark: SparkSession, folder: str) -> DataFrame:
    """events as payment notices, six ids to a payment."""
    kind = (
        F.when(F.col("event_type") == "purchase", "grant").when(F.col("event_type") == "error", "refund")
        .when(F.col("event_type") == "signup", "dispute_opened").when(F.col("event_type") == "view", "dispute_won")
    )
    return table(spark, folder, "events").withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        F.col("event_id").alias("event_id"), F.concat(F.lit("pay_"), F.expr("event_id div 6")).alias("payment_ref"),
        F.col("user_id").alias("account"), "kind", "ts",
        F.when(F.col("kind") == "grant", F.greatest(F.floor("value"), F.lit(1))).cast("long").alias("credits"),
    )
