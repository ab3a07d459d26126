"""Web archives with repeats stored once, as revisit records.

1. Every task writes the pages it reads to one archive, a gzip member per record, and gives a header row
   for each: digest and size of the payload, and where the record lies. Payloads never leave the archive.
2. Header rows are shuffled by payload digest. Of equal payloads the one with the largest page id stays a
   response, the others become revisits of it.
3. The rows go to the archive they came from, whose task copies the responses, under fresh headers, to a
   new archive and writes revisits without payload. ``read_archives`` joins revisits to their responses.

Files are named anew by every task run; a stored manifest names those of the runs that succeeded.

Cases: null html is an empty payload. Payloads below ``least`` bytes are all responses. Null page ids count as
smaller than all others; of equal ids the record that lies first counts as larger. Null urls become
``about:blank``. Extra columns are not archived. No pages give no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.llm.common import arrow, materialize, texts
from outings.llm.files import opened

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6f1d6a52-5f0e-4c8e-9a53-0d1e4a0c7b11")
HEAD = "page_id long, url string, digest string, payload_bytes long, path string, place long, size long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, fields: dict[str, str | None], http: bytes, payload: bytes) -> bytes:
    """A record as a gzip member."""
    lines = {
        "WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": EPOCH, **fields,
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None) + "\r\n"
    out = zlib.compressobj(6, wbits=31)
    return out.compress(text.encode() + http + payload + b"\r\n\r\n") + out.flush()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def members(file) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member of an open file."""
    held, place = b"", 0
    while True:
        if not held and not (held := file.read(1 << 20)):
            return
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            parts.append(unpack.decompress(held))
            used += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
            if not unpack.eof and not (held := file.read(1 << 20)):
                raise ValueError("archive ends inside a record")
        yield place, b"".join(parts)
        place += used


def url_field(url: str | None) -> str:
    return " ".join(url.split()) if url and url.strip() else "about:blank"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """An archive per task, a response record per page; a header row per record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, place = f"{folder}/raw-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out = []
            for page, address, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                file = file or opened(path, "wb")
                payload = data or b""
                digest = payload_digest(payload)
                name = f"<urn:uuid:{uuid.uuid5(SPACE, f'{path}/{place}')}>"
                body = record(RESPONSE, name, {
                    "WARC-Target-URI": url_field(address), "WARC-Payload-Digest": f"sha1:{digest}",
                    "X-Page-Id": None if page is None else str(page)}, http_head(len(payload)), payload)
                file.write(body)
                out.append({"page_id": page, "url": address, "digest": digest, "payload_bytes": len(payload),
                            "path": path, "place": place, "size": len(body)})
                place += len(body)
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
                ("path", pa.string()), ("place", pa.int64()), ("size", pa.int64())]))
        if file:
            file.close()

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return materialize(rows.mapInArrow(run, HEAD), "warc-headers")


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Header rows with the place of the response each revisits; null for those that are responses."""
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("page_id"), F.col("path").alias("path"), (-F.col("place")).alias("place"))
    large = headers.where(F.col("payload_bytes") >= least)
    first = large.groupBy("digest").agg(F.max(order).alias("of"), F.count("*").alias("copies")).where("copies > 1").select(
        "digest", F.col("of.path").alias("of_path"), (-F.col("of.place")).alias("of_place"))
    # both sides stored: a digest that many pages share is split at run time
    first = materialize(first, "warc-responses")
    joined = headers.join(first, (headers.digest == first.digest) & (headers.payload_bytes >= least), "left").drop(first.digest)
    own = (F.col("of_path") == F.col("path")) & (F.col("of_place") == F.col("place"))
    return joined.withColumn("of_place", F.when(~own, F.col("of_place"))).withColumn("of_path", F.when(F.col("of_place").isNotNull(), F.col("of_path")))


def rewrite(decided: DataFrame, folder: str) -> DataFrame:
    """New archives in which repeats are revisits; a row per archive."""
    parts = int(decided.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, old, target, done = None, None, None, []

        def close() -> None:
            if target:
                source.close()
                target.close()

        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != old:
                    close()
                    old = row["path"]
                    source, path = opened(old, "rb"), f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
                    target = opened(path, "wb")
                    done.append({"path": path})
                name = f"<urn:uuid:{uuid.uuid5(SPACE, f'{old}/{row["place"]}/new')}>"
                fields = {"WARC-Target-URI": url_field(row["url"]), "WARC-Payload-Digest": f"sha1:{row['digest']}",
                          "X-Page-Id": None if row["page_id"] is None else str(row["page_id"])}
                if row["of_path"] is None:
                    source.seek(row["place"])
                    _, _, payload = parse(zlib.decompress(source.read(row["size"]), 31))
                    target.write(record(RESPONSE, name, fields, http_head(len(payload)), payload))
                else:
                    of = f"<urn:uuid:{uuid.uuid5(SPACE, f'{row["of_path"]}/{row["of_place"]}/new')}>"
                    target.write(record(REVISIT, name, {**fields, "WARC-Refers-To": of, "WARC-Profile": PROFILE}, http_head(row["payload_bytes"]), b""))
        close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string())]))

    rows = decided.select("path", "place", "size", "page_id", "url", "digest", "payload_bytes", "of_path", "of_place")
    return materialize(rows.repartition(parts, "path").sortWithinPartitions("path", "place").mapInArrow(run, "path string"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives: record_id, page_id, url, record_type, payload, digest and size of the
    full payload, and for revisits the record and page they refer to, taken from the response."""
    spark = archives.sparkSession
    kind = ("record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, "
            "payload_digest string, refers_to_record string")

    schema = arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, size = [], 0
                with opened(path, "rb") as file:
                    for _, data in members(file):
                        fields, _, payload = parse(data)
                        full = fields["WARC-Type"] == RESPONSE
                        page = fields.get("X-Page-Id")
                        out.append({
                            "record_id": fields["WARC-Record-ID"], "page_id": None if page is None else int(page),
                            "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload": payload if full else None,
                            "payload_bytes": len(payload) if full else None, "payload_digest": payload_digest(payload) if full else None,
                            "refers_to_record": fields.get("WARC-Refers-To")})
                        size += len(payload)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(parts).mapInArrow(run, kind)


def resolved(records: DataFrame) -> DataFrame:
    """Records without payload, revisits joined to the responses they refer to."""
    heads = materialize(records.drop("payload"), "warc-read")
    revisits, responses = heads.where(F.col("record_type") == REVISIT), heads.where(F.col("record_type") == RESPONSE)
    of = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"),
                          F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    found = revisits.drop("payload_bytes", "payload_digest").join(of, "refers_to_record", "left").withColumnsRenamed(
        {"b": "payload_bytes", "d": "payload_digest"})
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def deduplicate(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives under ``folder``, and those without repeats; the new archives' paths."""
    return rewrite(resolve(write_archives(pages, folder), least), folder)
