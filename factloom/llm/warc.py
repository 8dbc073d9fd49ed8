"""WARC archives, index first.

Writing: every task writes one archive of gzip members, one per record, and returns offset, length, URL and digest of what it
wrote. Only that index, stored as Parquet, says which archives count; a file left by a lost task is in no index. Reading: the
wanted index rows are sorted by archive and offset and dealt out in ranges; a task joins neighbouring byte ranges, reads each
joined range once, and cuts it into records.

Payloads are UTF-8; null counts as empty. Of records with equal payloads of at least min_bytes, the one with the largest id holds
the payload and the others revisit it; smaller ones are all whole. Null URLs leave the header out. Rows with equal ids each get a
record. An empty table gives an index without rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm.store import narrow
from factloom.session import work_dir

MIN_BYTES = 1000
# Ranges with at most so many bytes between them are read together, up to so many bytes at once.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
SALTS = 16
# Archive bytes for one reading task.
TASK_BYTES = 64 << 20
RECORD_ID = "<urn:factloom:page:%d>"
INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, refers_to (null for a response).

    Records below the limit are alike to none and in no join. Of one digest there may be very many: its holder is dealt out to salts.
    """
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload))
    holders = rows.select("page_id", digest.alias("digest")).filter("digest is not null").groupBy("digest").agg(
        F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = holders.select("digest", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = rows.withColumn("digest", digest)
    alone = keyed.filter("digest is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    return keyed.filter("digest is not null").withColumn("salt", salt).join(dealt, ["digest", "salt"], "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("holder"), F.col("holder")).cast("long").alias("refers_to")).unionByName(alone)


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without its payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {RECORD_ID % page_id}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {RECORD_ID % refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda name: int(fields[name].rstrip(">").rpartition(":")[2]) if name in fields else None
    size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    whole = fields["warc-type"] == "response"
    if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": number("warc-refers-to"), "payload": payload if whole else None}


def _writer(folder: str, date: str):
    def write(batches):
        from pyarrow import fs

        out, store, offset = None, None, 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                payload = (row["html"] or "").encode()
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"], payload, row["refers_to"], date)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                index.append((row["page_id"], name, offset, len(member), row["url"], hashlib.sha1(payload).hexdigest(),
                              "response" if row["refers_to"] is None else "revisit", row["refers_to"]))
                offset += len(member)
            columns = list(zip(*index)) or [()] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, INDEX_TYPES)], INDEX_NAMES)
        if out is not None:
            out.close()

    return write


INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
INDEX_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in INDEX.split(", ")]


def write_archives(decided: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write page_id, url, html, refers_to as archives below folder; returns the stored index."""
    spark = decided.sparkSession
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = decided.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"))
    rows.mapInArrow(_writer(uri, date), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as joined reads: first and last + 1 range, first and last + 1 byte."""
    first = 0
    for k in range(1, len(ranges) + 1):
        a, end = ranges[first][0], sum(ranges[k - 1])
        if k == len(ranges) or ranges[k][0] - end > gap or sum(ranges[k]) - a > most:
            yield first, k, a, end
            first = k


def _reader(folder: str):
    def read(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows, at = batch.to_pylist(), 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to]["archive"] == rows[at]["archive"]:
                    to += 1
                with store.open_input_file(f"{path}/{rows[at]['archive']}") as source:
                    own = [(r["offset"], r["length"]) for r in rows[at:to]]
                    for i, j, a, b in coalesced(own):
                        source.seek(a)
                        data = source.read(b - a)
                        found = [parse(zlib.decompress(data[o - a: o - a + n], 31)) for o, n in own[i:j]]
                        yield pa.record_batch([pa.array([x[n] for x in found], t) for n, t in zip(RECORD_NAMES, RECORD_TYPES)], RECORD_NAMES)
                at = to

    return read


RECORD_NAMES = [c.split()[0] for c in RECORDS.split(", ")]
RECORD_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows, each byte range read once and in order."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    spark, wanted = index.sparkSession, index.select("archive", "offset", "length").dropDuplicates()
    total = wanted.agg(F.sum("length")).first()[0] or 0
    # The index is narrow: by its own size, Spark would leave all reads to one task.
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    wanted = wanted.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return wanted.mapInArrow(_reader(uri), RECORDS)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages as archives in the shared folder and read every record back through the index."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_records(write_archives(decide(pages, **columns), folder), folder)
