"""Entity and report sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from factloom.operators.quality import public_view
from factloom.sources.versions import VersionedTable


def write_entities(entities: DataFrame, path: str, format: str = "json", partitions: Sequence[str] = ()) -> None:
    """Public entities as JSON lines, or only their Markdown as text."""
    if format == "markdown":
        entities.select("content").write.mode("overwrite").text(path, lineSep="\n\n---\n\n")
        return
    public_view(entities).write.mode("overwrite").partitionBy(*partitions).json(path)


def write_report(report: DataFrame, path: str, stamp: str, markdown: DataFrame | None = None) -> None:
    """A stamped report and the same as `latest`, as JSON and optionally Markdown text."""
    for name in (f"stamp={stamp}", "latest"):
        report.write.mode("overwrite").json(f"{path}/{name}/json")
        if markdown is not None:
            markdown.select("content").write.mode("overwrite").text(f"{path}/{name}/markdown")


def once_per_batch(path: str, key: str, memory: str, failed: str | None = None) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` sink that takes every id once, however late a repeat comes.

    A repeat is dropped if an earlier row of its id was taken and, where `failed` names a flag, did not fail. The ids taken are a versioned table
    below `memory`; a batch reads only the buckets of its own ids. It writes its own folder before the ids, so a replay is harmless.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        flag = F.col(failed) if failed else F.lit(False)
        ids = batch.select(key, flag.cast("boolean").alias("_failed"))
        taken = VersionedTable(batch.sparkSession, memory, ids.schema, [key], {"_failed": "min"}, "_failed")
        if batch_id <= taken.manifest()[2]:
            return
        rest = [c for c in batch.columns if c != key]
        rank = F.col(failed).cast("int") if failed else F.lit(0)
        fresh = batch.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(key, "_row.*").select(*batch.columns)
        fresh = fresh.join(taken.touching(batch).filter("not _failed").select(key), key, "left_anti")
        folder = f"{path}/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        taken.upsert(written.select(key, flag.cast("boolean").alias("_failed")), batch_id)

    return write
