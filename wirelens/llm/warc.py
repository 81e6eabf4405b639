"""WARC archives with revisit resolution.

Headers (id, url, payload digest) are shuffled by digest and combined there; the digests that occur more than
once name the page that keeps the payload. Pages are then joined with these originals: digests with a large
share of all repeats are few by arithmetic and broadcast, the others are joined by digest. Revisits drop their
payload before that join.

A WARC record ends in two line ends. Archives are therefore written by Spark's text sink with that separator,
one gzip file per task, and committed like any other table. The text source gives the same pieces back in file
order (gzip files are not split), from which the records are read by their lengths, whatever their payloads hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.workspace import materialize

from .common import slices, text_of

CRLF = "\r\n"
GAP = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    least_bytes: int = 100  # shorter payloads are never revisits
    hot_digests: int = 10_000  # digests that may be broadcast: those with 1 / hot_digests of all repeats
    records_per_file: int = 100_000
    date: str | None = None  # WARC-Date of the fresh headers (None: the time of the run)


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = text_of(html_col)
    return pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"),
    )


def originals(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (digest, n, first (id, url)) of the payloads that occur more than once."""
    known = F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    return (
        rows.where(F.col("size") >= settings.least_bytes).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(known).alias("first")).where("n > 1 AND first IS NOT NULL")
    )


def resolved(pages: DataFrame, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """One row per page: id, url, size, digest, record_type, first (the original's id and url, null for
    responses) and the payload (empty for revisits).

    Of equal payloads of `least_bytes` or more, the page with the smallest id is the response and the others
    revisit it; rows that repeat that id with that payload are responses too, as they are the same page. Pages
    without an id revisit a page with one and are never revisited themselves. Null payloads are empty. An empty
    table gives no rows; other columns are ignored.
    """
    rows = _rows(pages, id_col, url_col, html_col)
    repeated = materialize(originals(rows, settings), "repeated")
    repeats = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    least = max(2, repeats // settings.hot_digests)
    hot = repeated.where(F.col("n") > least).select("digest", F.col("first").alias("hot"))
    cold = repeated.where(F.col("n") <= least).select(F.col("digest").alias("key"), F.col("first").alias("cold"))

    def revisits(first: str) -> Column:
        return F.col(first).isNotNull() & ~F.col("id").eqNullSafe(F.col(f"{first}.id"))

    marked = rows.join(F.broadcast(hot), "digest", "left")
    marked = marked.withColumn("payload", F.when(~revisits("hot"), F.col("payload")).otherwise(""))
    # rows that need no lookup get keys of their own, so that they do not gather under one null key
    apart = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    key = F.when((F.col("size") >= settings.least_bytes) & F.col("hot").isNull(), F.col("digest")).otherwise(apart)
    joined = marked.withColumn("key", key).join(cold, "key", "left")
    joined = joined.withColumn("first", F.coalesce("hot", "cold"))
    again = revisits("first")
    return joined.select(
        "id", "url", "size", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("first"), F.when(again, "").otherwise(F.col("payload")).alias("payload"),
    )


def _uri(url: Column) -> Column:
    """A URL that cannot end its header line."""
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def _record_id(page: Column, digest: Column) -> Column:
    """A UUID that follows from page and payload, so that a task that runs again writes the same record."""
    name = F.sha2(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest), 256)
    parts = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("8"), F.substring(name, 13, 3)),
             F.concat(F.lit("8"), F.substring(name, 16, 3)), F.substring(name, 19, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """Column `value`: the records of `resolved` with fresh headers, without the two line ends behind each."""
    date = F.lit(settings.date) if settings.date else F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.col("size").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html;charset=utf-8{CRLF}Content-Length: "), size, F.lit(GAP))
    length = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("size")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Page-ID: "), F.url_encode(F.col("id").cast("string"))),
        F.when(F.col("first").isNotNull(), F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first.id"), F.when(F.col("first").isNotNull(), F.col("digest")))),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), _uri(F.col("first.url"))),
        F.concat(F.lit("X-Refers-To-Page-ID: "), F.url_encode(F.col("first.id").cast("string"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    lines[8] = F.when(F.col("first").isNotNull(), lines[8])
    made = resolved(pages, settings, id_col, url_col, html_col)
    # concat_ws leaves out the lines that are null
    return made.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(GAP), http, F.col("payload")).alias("value"))


def write(pages: DataFrame, path: str, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> None:
    """Write deduplicated archives into a folder of any file system that Spark writes to."""
    (records(pages, settings, id_col, url_col, html_col).write.option("lineSep", GAP).option("compression", "gzip")
     .option("maxRecordsPerFile", settings.records_per_file).text(path))


class Reader:
    """Records from the bytes of one archive, fed piece by piece."""

    def __init__(self, path: str = ""):
        self.path, self.held, self.head, self.need = path, bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        while True:
            if self.head is None:
                blank = 0
                while blank < len(self.held) and self.held[blank] in b"\r\n":
                    blank += 1
                del self.held[:blank]
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                first, *rest = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"no record where one should begin: {self.path}")
                fields = (line.partition(":") for line in rest)
                self.head = {name.strip().lower(): value.strip() for name, _, value in fields}
                self.need = int(self.head["content-length"])
                del self.held[:end + 4]
            if len(self.held) < self.need:
                return
            body = bytes(self.held[:self.need])
            del self.held[:self.need]
            head, self.head = self.head, None
            yield head, body

    def close(self) -> None:
        if self.head is not None or self.held.strip(b"\r\n"):
            raise ValueError(f"the last record is cut short: {self.path}")


def _parsed(head: dict[str, str], body: bytes, keep: bool) -> tuple:
    """(record type, id, uri, page, payload bytes, digest, refers to, page referred to, intact, payload)."""
    kind, length, payload = head.get("warc-type"), None, body
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = body.partition(b"\r\n\r\n")
        for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name.strip().lower() == "content-length":
                length = int(value)
    stated = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":
        return (kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("x-page-id"), length, stated,
                head.get("warc-refers-to"), head.get("x-refers-to-page-id"), None, None)
    digest = hashlib.sha256(payload).hexdigest()
    return (kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("x-page-id"), len(payload), digest,
            None, None, stated in (None, digest) and length in (None, len(payload)), payload if keep else None)


_SCHEMA = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("page", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("refers", pa.string()),
    ("intact", pa.bool_()), ("payload", pa.binary()),
])


def read(spark: SparkSession, path: str, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives in a folder, in no order: page_id, uri, record_type, record_id,
    payload_bytes, payload_digest, refers_to (page id), refers_to_id, intact, payload.

    Size and digest of a response are taken from the payload that was read, and `intact` says whether they are
    what the headers state; those of a revisit (of the full payload) are read from its headers, its payload and
    `intact` are null. An archive that ends inside a record is an error. A task holds one record and one batch.
    """
    source = spark.read.option("lineSep", GAP).text(path)
    pieces = source.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in slices(batches, 1, 4 << 20):
            found, size = [], 0
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != reader.path:
                    reader.close()
                    reader = Reader(name)
                for head, body in reader.feed(piece.as_py() + b"\r\n\r\n"):
                    found.append(_parsed(head, body, with_payload))
                    size += len(body)
                    if size > 8 << 20:
                        yield _batch(found)
                        found, size = [], 0
            if found:
                yield _batch(found)
        reader.close()

    kinds = ("record_type string, record_id string, uri string, page string, payload_bytes long, payload_digest string, "
             "refers_to_id string, refers string, intact boolean, payload binary")
    back = pieces.mapInArrow(run, kinds)
    return back.select(
        F.url_decode("page").cast(id_type).alias("page_id"), "uri", "record_type", "record_id", "payload_bytes",
        "payload_digest", F.url_decode("refers").cast(id_type).alias("refers_to"), "refers_to_id", "intact", "payload")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
