"""WARC archives, index first: every record's offset, length, URL and digest is written to an index, and records are
read back by sorted byte ranges in which neighbours are joined.

Each task writes one archive of gzip members, a member a record. Only archives named in the committed index are read, so
files of lost or repeated attempts do no harm. Of records with equal payloads, that with the smallest page_id is a
response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import attempt_name, open_store, small_batches, tasks, written
from voltlake.session import scratch

DATE = "2024-01-01T00:00:00Z"
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(page_id))}>"


def header_text(value: str) -> str:
    """A header value on one line; the index keeps the URL as given."""
    return " ".join(value.split())


def record(page_id, url, payload: bytes | None, size: int, sha1: str, refers_to) -> bytes:
    """One record; without payload it is a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if payload is None else head + payload
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", header_text(url)))
    if payload is None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    fields += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields, HTTP fields and payload of one record; raises when the block's digest does not fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), size and refers_to; rows are matched by SHA-1 and length of the payload.

    A row is a response if its page_id is the smallest of its payload; a null id comes after all others. Rows that repeat
    the smallest id with the same payload are responses too.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    first = (
        pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("size")).filter(F.col("size") >= least_bytes)
        .groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    # a written table, so that the join reads plain shuffles, of which that of a frequent payload can be split
    first = written(first, "payloads")
    held = rows.join(first, ["sha", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return held.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "sha", F.col("size").cast("long").alias("size"),
                       F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write one archive a task below ``folder`` and return the index, itself a written table."""
    small_batches(pages.sparkSession)

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = attempt_name("archive", ".warc.gz")
        at, out = 0, None
        for rows in batches:
            index = []
            for page, url, html, sha, size, ref in zip(rows.page_id, rows.url, rows.html, rows.sha, rows["size"], rows.refers_to, strict=True):
                page = None if pd.isna(page) else int(page)
                sha1 = base64.b32encode(bytes.fromhex(sha)).decode()
                again = html is None
                member = gzip.compress(record(page, url, None if again else html.encode(), int(size), sha1, int(ref) if again else None), level, mtime=0)
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                index.append((page, url, name, at, len(member), sha1, "revisit" if again else "response"))
                at += len(member)
            frame = pd.DataFrame(index, columns=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return written(roles(pages, least_bytes).mapInPandas(write, INDEX), "warc-index")


def ranges(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for every stretch of ``range_bytes`` of an archive, with the offsets and lengths of its records in order."""
    return index.groupBy("file", F.expr(f"offset div {range_bytes}").alias("stretch")).agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "url"))).alias("records"))


def read_records(index: DataFrame, folder: str, gap_bytes: int = GAP_BYTES, payloads: bool = True) -> DataFrame:
    """The records an index selects. Neighbours at most ``gap_bytes`` apart are read at once; digests are checked."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        store, base = open_store(folder)
        for rows in batches:
            for name, records in zip(rows.file, rows.records, strict=True):
                out = []
                with store.open_input_file(f"{base}/{name}") as f:
                    for run in coalesce([(int(r["offset"]), int(r["length"]), r["url"]) for r in records], gap_bytes):
                        start = run[0][0]
                        f.seek(start)
                        data = f.read(run[-1][0] + run[-1][1] - start)
                        for offset, length, url in run:
                            got = parse(gzip.GzipFile(fileobj=io.BytesIO(data[offset - start: offset - start + length])).read())
                            out.append(result(got, url, payloads))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    spark = index.sparkSession
    return ranges(index).repartition(tasks(spark), "file", "stretch").mapInPandas(read, RECORD)


def coalesce(records: list, gap: int) -> list[list]:
    runs: list[list] = []
    for r in records:
        if runs and r[0] - (runs[-1][-1][0] + runs[-1][-1][1]) <= gap:
            runs[-1].append(r)
        else:
            runs.append([r])
    return runs


def result(got: dict, url, payloads: bool) -> tuple:
    fields = got["fields"]
    kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(got["payload"]) != sha1:
        raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
    page, ref = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return (None if page is None else int(page), url, int(got["http"]["Content-Length"]), sha1, kind,
            None if ref is None else int(ref), got["payload"] if payloads and kind == "response" else None)


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page, then read all records back; a null html is an empty payload, other columns are ignored."""
    folder = scratch(pages.sparkSession, "warc")
    index = write_archives(pages.select("page_id", "url", "html"), folder, least_bytes)
    return read_records(index, folder, payloads=False)
