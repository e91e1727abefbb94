"""WARC archives: records written from pages, read back and assembled into one nested row per capture.

Records are built by SQL functions and written by Spark's text writer: the blank lines that end a record are the
line separator of the file. Reading splits at the same separator and a small parser in each task joins the parts of
a record again by its Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticktote.llm.common import shared_table

GAP = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = ("record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
          "stated_digest string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload string")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, five bytes to eight digits."""
    hexed = F.sha1(F.encode(payload, "UTF-8"))
    digits = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), *[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, rid: Column, uri: Column, date: str, block: Column, content: str, extra: list[Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri, *extra)
    return F.concat(head, F.lit(f"\r\nContent-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block)


def revisit_plan(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Per row of pages: page, digest, refers_page (null for a response).

    Of equal payloads of at least min_bytes bytes that of the largest id is the response; smaller ones are all responses.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    light = pages.select(F.col(id_col).alias("page"), base32_sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    keep = light.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page").alias("keep"))
    other = ~F.col("page").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull()
    return light.join(keep, ["digest", "n"], "left").select("page", "digest", F.when(other, F.col("keep")).alias("refers_page"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", *, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """A request, a response or revisit, and a metadata record for each row of pages, as gzip text files below path.

    Null bodies are empty, null urls become urn:page:<id>. Rows that repeat an id and a body are captures of their
    own; a revisit refers to the first of them. Rows without an id are captures too, under the id "null".
    """
    plan = revisit_plan(pages, id_col, body_col, min_bytes).distinct()
    body = F.coalesce(F.col(body_col), F.lit(""))
    page = F.col(id_col)
    rows = pages.select(page.alias("page"), F.coalesce(F.regexp_replace(F.col(url_col), r"\s", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")))).alias("uri"), body.alias("body"))
    # one key for the join and the window, so that bodies are dealt out once
    named = F.when(F.col("page").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("page").cast("string"))).alias("key")
    rows = rows.select(named, "*", base32_sha1(F.col("body")).alias("sha"))
    plan = plan.select(named, F.col("digest").alias("sha"), "refers_page")
    rows = rows.join(plan, ["key", "sha"], "left")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "sha").orderBy("uri")))
    rid = _urn("response", F.col("page"), F.col("sha"), F.col("nth"))
    first = _urn("response", F.col("refers_page"), F.col("sha"), F.lit(1))
    revisit = F.col("refers_page").isNotNull()
    refers = F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), first, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise("")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(GAP))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha"))
    with_it = F.concat(F.lit("\r\nWARC-Concurrent-To: "), rid)
    host = F.regexp_extract("uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    ask = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(GAP))
    info = F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("null")), F.lit("\r\n"))
    uri = F.col("uri")
    records = F.array(
        _record("request", _urn("request", rid), uri, date, ask, "application/http; msgtype=request", [with_it]),
        _record(F.when(revisit, "revisit").otherwise("response"), rid, uri, date, F.concat(head, F.when(revisit, "").otherwise(F.col("body"))), "application/http; msgtype=response", [digest, refers]),
        _record("metadata", _urn("metadata", rid), uri, date, info, "application/warc-fields", [with_it]))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", GAP).option("compression", "gzip").text(path)


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if colon:
            out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def _records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a stream that was split at blank lines."""
    gap, held = GAP.encode(), None
    while True:
        part = held if held is not None else next(parts, None)
        held = None
        if part is None:
            return
        head = part.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            continue
        fields = _fields(head)
        need = int(fields.get("content-length", 0)) + len(gap)
        got, size = [], 0
        while size < need:
            nxt = next(parts, None)
            if nxt is None:
                break
            got += [nxt, gap]
            size += len(nxt) + len(gap)
        block = b"".join(got)
        held = block[need:].removesuffix(gap) if size > need else None  # a block that ends in line breaks moves the cut
        yield fields, block[: need - len(gap)]


def _parse(with_payload: bool):
    schema = pa.schema([
        ("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
        ("stated_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.string())])

    def row(h: dict[str, str], block: bytes) -> dict:
        kind, is_http = h.get("warc-type", ""), h.get("content-type", "").startswith("application/http")
        body = block.partition(GAP.encode())[2] if is_http else block
        own = kind == "response"
        return {
            "record_type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"),
            "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "stated_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": len(body) if own else None, "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode() if own else None,
            "fields": list(_fields(block).items()) if kind == "metadata" else None, "payload": body.decode("utf-8", "replace") if own and with_payload else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for h, block in _records(v or b"" for b in batches for v in b.column(0).cast(pa.binary()).to_pylist()):
            rows.append(row(h, block))
            size += len(block)
            if len(rows) >= 2000 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives below path. Digest and length are computed from the payload that was read."""
    return spark.read.option("lineSep", GAP).text(path).mapInArrow(_parse(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the nested response (or revisit), request and metadata records.

    Requests and metadata meet their response through concurrent-to. Without a response their row has a null one.
    Of several requests or metadata records of a capture, all stay, in lists ordered by record id.
    """
    answers = F.col("record_type").isin("response", "revisit")
    own = F.struct(*records.columns)
    keyed = records.withColumn("capture_id", F.when(answers, F.col("record_id")).otherwise(F.col("concurrent_to")))
    rest = [c for c in records.columns if c != "payload" and c != "fields"]
    asked = F.sort_array(F.collect_list(F.when(F.col("record_type") == "request", F.struct("record_id", *[c for c in rest if c != "record_id"]))))
    meta = F.collect_list(F.when(F.col("record_type") == "metadata", F.struct("record_id", "fields")))
    return keyed.groupBy("capture_id").agg(F.first(F.when(answers, own), ignorenulls=True).alias("response"), asked.alias("requests"), meta.alias("metadata"))


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with the payload_bytes and payload_digest of the full payload: a revisit takes those of its response."""
    own = captures.select("*", F.col("metadata")[0]["fields"]["page-id"].alias("page"), F.col("response.record_type").alias("record_type"))
    full = own.where("record_type = 'response'").select(
        F.col("capture_id").alias("ref_id"), F.col("page").alias("refers_page"), F.col("response.payload_bytes").alias("ref_bytes"), F.col("response.payload_digest").alias("ref_digest"))
    got = own.join(full, F.col("response.refers_to") == F.col("ref_id"), "left")
    return got.select(
        *own.columns, "refers_page", F.coalesce("response.payload_bytes", "ref_bytes").alias("payload_bytes"), F.coalesce("response.payload_digest", "ref_digest").alias("payload_digest"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Light captures of the archives below path, without payload text."""
    return resolve(shared_table(assemble(read_records(spark, path)), "captures"))
