"""WARC archives, index first.

Tasks write gzip-per-record archives into the shared folder and return one index row per record
(path, offset, length, URL, digest). The index is a written table; a file of a lost or repeated task
attempt is in no index row and so is never read. Readers select index rows, sort them by path and
offset, coalesce neighbouring records into byte ranges and fetch each range with one read.

Defined cases: null html is an empty payload; a null url has no WARC-Target-URI,
and line ends in a url are written %0D and %0A; a null page_id never
is the first of its copies, so it revisits the smallest known id (or stays a response, if none);
page_id names a record, so rows that repeat the smallest page_id of their payload are that one record,
each a response (a revisit would refer to itself); extra columns are ignored; an empty table gives no
archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, partitions, stored

INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
ID = "urn:page:"


def planned(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Each page with its payload's digest, and the smallest page_id of its copies if it revisits it.

    Copies are counted with a map-side combined aggregate, and only digests that repeat are joined
    back, so a hot payload is a skewed equi-join whose partitions AQE can split.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    firsts = rows.where(F.octet_length("body") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # short payloads revisit nothing: a key of their own keeps the many empty ones apart
    key = F.when(F.octet_length("body") >= min_bytes, F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    firsts = firsts.where("n > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("copy_of"), "first_id")
    rows = rows.withColumn("copy_of", key).join(firsts, "copy_of", "left").drop("copy_of")
    return rows.withColumn("refers_to", F.expr("CASE WHEN NOT page_id <=> first_id THEN first_id END")).drop("first_id")


def record(page_id, url, body: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header with the original length, but no payload."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>".encode(), f"WARC-Date: {date}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    head.append(f"WARC-Payload-Digest: sha256:{digest}".encode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block += body if refers_to is None else b""
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of one record; raises if a response's payload doesn't have the digest it states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    kv = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(kv["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = kv["WARC-Payload-Digest"].removeprefix("sha256:"), kv["WARC-Type"]
    if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"damaged record {kv['WARC-Record-ID']}")
    number = lambda s: int(s[1:-1].removeprefix(ID)) if s and s[1:-1] != ID else None
    return {"page_id": number(kv["WARC-Record-ID"]), "url": kv.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(kv.get("WARC-Refers-To")), "payload": body if kind == "response" else None}


def write_archives(pages: DataFrame, out: str, min_bytes: int = 100, max_file: int = 256 << 20, level: int = 1, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under out, then the index table, which is returned."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        stream, at, name = None, 0, ""
        for frame in frames:
            rows = []
            for page_id, url, body, digest, refers_to in zip(frame.page_id.astype(object), frame.url, frame.body, frame.digest, frame.refers_to.astype(object), strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                if stream is None or at >= max_file:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, bytes(body), digest, refers_to, date)) + z.flush()
                stream.write(data)
                rows.append((f"{out}/{name}", at, len(data), page_id, url, digest, "response" if refers_to is None else "revisit"))
                at += len(data)
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")], dtype=object)
            yield frame
        if stream is not None:
            stream.close()

    index = planned(pages, min_bytes).select("page_id", "url", "body", "digest", "refers_to").mapInPandas(task, INDEX)
    return stored(index, f"{out}/index.parquet")


def byte_ranges(index: DataFrame, max_gap: int = 64 << 10, max_range: int = 1 << 20) -> DataFrame:
    """(path, start, stop, members): selected records whose gap is at most max_gap share a range; a range is cut at multiples of max_range."""
    w = Window.partitionBy("path").orderBy("offset")
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w) > max_gap
    rows = index.select("path", "offset", "length", far.cast("int").alias("far"))
    rows = rows.select("path", "offset", "length", F.coalesce(F.sum("far").over(w), F.lit(0)).alias("island"), F.floor(F.col("offset") / max_range).alias("cut"))
    return rows.groupBy("path", "island", "cut").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))


def read_archives(index: DataFrame, payloads: bool = False, **limits: int) -> DataFrame:
    """The records of the index rows given, each parsed from its bytes and checked against its digest."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, stop, members in zip(frame.path, frame.start, frame.stop, frame.members, strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    data = memoryview(f.read_at(int(stop - start), int(start)))
                rows = [parsed(zlib.decompress(data[m["offset"] - start : m["offset"] - start + m["length"]], 31)) for m in members]
                out = pd.DataFrame(rows, dtype=object)
                yield out if payloads else out.drop(columns="payload")

    ranges = byte_ranges(index, **limits).select("path", "start", "stop", "members").repartition(partitions(index.sparkSession), "path", "start")
    return ranges.mapInPandas(task, RECORD + (", payload binary" if payloads else ""))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, read back from the archives by the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archives(pages, new_dir(spark, "warc"))
    return read_archives(index)


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, url, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest, body FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM coalesce(first_id, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM coalesce(first_id, page_id) THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
