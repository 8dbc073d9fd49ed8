"""A keyed table in versions: an upsert rewrites the buckets it touches, and a manifest says which folder each bucket is read from.

Layout below the table's folder: `data/v=N/bucket=B` holds a bucket as version N wrote it, `manifest/v=N` one row per bucket with the version to
read it from, and the number of the micro-batch that made the version. A version counts once its manifest is committed, so a lost writer leaves
nothing behind that is read, readers of an older version are not disturbed, and a micro-batch that comes again is not applied twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factloom.operators.joins import upsert

BUCKETS = 64
MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("batch", T.LongType())])


class VersionedTable:
    """`merge` names the rule per column as in `upsert`; `order` decides what is older."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], merge: dict[str, str], order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.merge, self.order, self.buckets = spark, path.rstrip("/"), list(keys), merge, order, buckets
        self.schema = T.StructType([f for f in schema.fields if f.name in self.keys or f.name in merge])

    def _versions(self) -> list[int]:
        """Committed versions: manifest folders whose write was finished."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return []
        found = [s.getPath() for s in files.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self) -> tuple[int, dict[int, int], int]:
        """Latest version (0: none), version to read per bucket, last micro-batch. One row per bucket reaches the driver."""
        versions = self._versions()
        if not versions:
            return 0, {}, -1
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={versions[-1]}").collect()
        return versions[-1], {r.bucket: r["at"] for r in rows if r.bucket >= 0}, max(r.batch for r in rows)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, at: dict[int, int]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(at.items())])

    def read(self) -> DataFrame:
        """The latest version."""
        return self._read(self.manifest()[1])

    def touching(self, rows: DataFrame) -> DataFrame:
        """Of the latest version, the buckets that hold the keys of `rows`."""
        touched = {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # at most one row per bucket
        return self._read({b: v for b, v in self.manifest()[1].items() if b in touched})

    def upsert(self, changes: DataFrame, batch: int | None = None) -> dict[int, int]:
        """Merge changes; returns the buckets written with their version. Only those buckets are read. A batch that was applied before changes nothing."""
        version, at, last = self.manifest()
        if batch is not None and batch <= last:
            return {}
        marked = changes.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        touched = {r[0] for r in marked.select(self._bucket().alias("b")).distinct().collect()}  # at most one row per bucket
        new = version + 1
        if touched:
            merged = upsert(self._read({b: v for b, v in at.items() if b in touched}), marked, self.keys, self.merge, self.order)
            merged.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={new}")
        written = dict.fromkeys(sorted(touched), new)
        number = last if batch is None else batch
        # Bucket -1 carries the batch of a table without buckets.
        rows = [(b, v, number) for b, v in sorted((at | written).items())] + [(-1, new, number)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={new}")
        return written

    def sink(self, changes=lambda batch: batch):
        """`foreachBatch` sink that applies every micro-batch once."""
        return lambda batch, batch_id: self.upsert(changes(batch), batch_id) and None
