"""Typed scans; bad rows become error rows, never failed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factloom import schema as S
from factloom.functions import urls as U
from factloom.operators.ordered import keep_first
from factloom.operators.pages import MAX_SOURCE_BYTES, size_gate

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
])


def read_pages(spark: SparkSession, path: str, max_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """Pages with `error_code`; bodies over the size limit are kept as error rows without their text."""
    pages = spark.read.parquet(path)
    code = size_gate(F.col("html"), max_bytes)
    return pages.withColumn("error_code", code).withColumn("html", F.when(F.col("error_code").isNull(), F.col("html")))


def read_json_payloads(df: DataFrame, schema: T.StructType | str, body: str = "body") -> DataFrame:
    """Adds `data` parsed by the schema and `error_code` for malformed or wrongly shaped payloads."""
    as_type = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    whole = T.StructType([*as_type.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("data", F.from_json(body, whole, options))
    broken = F.col("data").isNull() | F.col("data._corrupt").isNotNull() | F.try_parse_json(F.col(body)).isNull()
    return parsed.withColumn("error_code", F.when(broken, F.lit("upstream_error")))


def read_url_list(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """Web addresses of a text file, one per site, the first `count` or all; blank and comment lines are skipped."""
    # File, split and place within the split: the order of the lines however files are cut into splits.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select(F.trim("value").alias("url"), place.alias("line"))
    usable = lines.filter((F.col("url") != "") & ~F.col("url").startswith("#") & U.is_http(F.col("url")))
    sites = keep_first(usable.withColumn("site", U.site_key(U.host(F.col("url")))), ["site"], ["line"])
    return (sites.orderBy("line").limit(count) if count is not None else sites).select("url", "site")


def read_ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    """(rank, domain) rows of a ranked list whose domain is valid."""
    rows = spark.read.schema("rank BIGINT, domain STRING").csv(path)
    return rows.withColumn("domain", F.trim("domain")).filter(F.col("rank").isNotNull() & U.valid_domain(F.col("domain")))


def read_billing(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every billing table of a folder with its fixed schema."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in S.BILLING_TABLES.items()}


def read_events_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, `files` per micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)
