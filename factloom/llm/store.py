"""Tables in the cluster's shared folder, and the columns operators keep apart from the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.session import work_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; all others stay outside."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
