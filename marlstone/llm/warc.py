"""WARC archives: writing captures, reading records, assembling transactions (operator 5)."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import _fs_path, materialize, scratch_root, sized, texts_of

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 1000) -> DataFrame:
    """``(page_id, url, payload, digest, n_bytes, refers_to, repeated)``: of equal payloads the one with the largest page_id is the response.

    Payloads under ``least_bytes`` are never revisits.  Equality is that of SHA-1 and length.  A null
    payload is empty, a null url too.  Every row is a capture of its own: rows that tie in the largest page_id are all responses, and rows with a null page_id
    revisit the response if a page_id is known.  ``repeated`` marks rows that share page_id and payload with others.

    Counting combines on the map side and moves digests, not payloads.  What it finds is broadcast if it is measured to be small;
    beyond that rows meet by digest, and adaptive execution splits a payload of very many copies.
    """
    t = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), t.alias("payload")).select("*", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    counted, _ = materialize(rows.groupBy("digest", "n_bytes", "page_id").agg(F.count("*").alias("n")), "warc-digests")
    heads = counted.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("head"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    heads, _ = materialize(heads, "warc-heads")
    again, _ = materialize(counted.filter("n > 1").select(F.col("digest").alias("d"), F.col("n_bytes").alias("b"), F.col("page_id").alias("p"), F.lit(True).alias("r")), "warc-repeated")
    of = sized(again)
    met = rows.join(sized(heads), ["digest", "n_bytes"], "left").join(of, (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("b")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    return met.select("page_id", "url", "payload", "digest", "n_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"), F.coalesce("r", F.lit(False)).alias("repeated"))


def record_id(page: int | None, kind: str, digest: str, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{page}:{kind}:{digest}{copy}')}>"


def _record(kind: str, fields: list[tuple[str, str]], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Date", _DATE), ("Content-Length", str(len(block.encode())))])
    return f"WARC/1.1\r\n{head}\r\n{block}"


def write_archives(captures: DataFrame, path: str, file_bytes: int = 32 << 20) -> None:
    """Write each row of ``mark_revisits`` as a request, a response or revisit, and a metadata record.

    Spark's own writer stores the archives, so ``path`` may be in any store that Spark reaches.
    An archive holds about ``file_bytes``; a larger capture has one of its own.
    Names of pages are escaped, so no header line can be forged.  Records of repeated rows have ids of their own, by
    task and number: all records of a capture come from one task, so they agree whatever is run again.
    """

    def run(batches):
        end = "\r\n\r\n"
        held, size, number, task = [], 0, 0, TaskContext.get().partitionId()
        for b in batches:
            for page, url, payload, digest, n, refers, repeated in zip(*(texts_of(c) if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns), strict=True):
                number += 1
                copy = f":{task}.{number}" if repeated else ""
                main = record_id(page, "response", digest, copy)
                target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) or "about:blank"
                common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
                if refers is None:
                    primary = _record("response", [("WARC-Record-ID", main), *common, ("Content-Type", "application/http;msgtype=response")], http + payload)
                else:
                    primary = _record("revisit", [("WARC-Record-ID", main), *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers, "response", digest)), ("Content-Type", "application/http;msgtype=response")], http)
                request = _record("request", [("WARC-Record-ID", record_id(page, "request", digest, copy)), ("WARC-Concurrent-To", main), ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=request")], f"GET {target} HTTP/1.1\r\n\r\n")
                metadata = _record("metadata", [("WARC-Record-ID", record_id(page, "metadata", digest, copy)), ("WARC-Concurrent-To", main), ("WARC-Target-URI", target), ("Content-Type", "application/warc-fields")], f"page-id: {'' if page is None else page}\r\npayload-bytes: {n}\r\n")
                text = end.join((request, primary, metadata))
                if held and size + len(text) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(held)])], names=["value"])
                    held, size = [], 0
                held.append(text)
                size += len(text)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)])], names=["value"])

    archives = captures.select("page_id", "url", "payload", "digest", "n_bytes", "refers_to", "repeated").mapInArrow(run, "value string")
    archives.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def parse_records(data: bytes):
    """``(headers, block)`` of each record; blocks are cut by Content-Length, whatever they contain."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(headers["content-length"])
        if start + n > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, data[start : start + n]
        at = start + n
        while data.startswith(b"\r\n", at):
            at += 2


_RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, stated_digest string, page_id long, stated_bytes long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record.  Length and SHA-1 are computed from what was read; ``payload`` keeps the bytes too."""
    import gzip

    def run(batches):
        for b in batches:
            for data in b.column(0):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows = []
                for h, block in parse_records(raw):
                    kind = h["warc-type"]
                    body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    fields = dict(x.partition(": ")[::2] for x in block.decode().split("\r\n")) if kind == "metadata" else {}
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, int(fields["page-id"]) if fields.get("page-id") else None, int(fields["payload-bytes"]) if "payload-bytes" in fields else None, None if body is None else len(body), None if body is None else hashlib.sha1(body).hexdigest(), body if payload else None))
                if not rows:  # an archive without records
                    continue
                kinds = [pa.string()] * 6 + [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``(capture_id, response, request, metadata)``.

    Requests and metadata meet the response or revisit that they are concurrent to.  All records of a
    capture share one key, so they meet in a single exchange.  A missing part is null; records
    concurrent to none that is there give a capture without a response.
    """
    part = F.struct(*[c for c in records.columns])
    key = F.coalesce(F.when(F.col("type").isin("response", "revisit"), F.col("record_id")), F.col("concurrent_to"), F.col("record_id"))
    pick = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.col("part")), ignorenulls=True)
    return records.select(key.alias("capture_id"), "type", part.alias("part")).groupBy("capture_id").agg(pick("response", "revisit").alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata"))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back, assemble: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    One row per row of ``pages``, repeated rows too; a null page_id stays null, a null payload is empty, a very long page is one record
    in an archive of its own, an empty table gives an empty result, and other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(mark_revisits(pages, **options), path)
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)
    captures, _ = materialize(assemble(read_archives(spark, path, payload=False)), "captures")
    flat = captures.filter("response is not null").select(
        "capture_id",
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.stated_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.stated_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", F.concat("response.stated_digest", F.lit(":"), F.col("metadata.stated_bytes"))).alias("same"),
    )
    first = flat.filter("record_type = 'response'")
    # identical-payload revisits: the response that has the digest they state; one row per payload that is revisited at all
    again = flat.filter("record_type = 'revisit'")
    asked = again.select("same").distinct()
    named = first.select(F.concat("payload_digest", F.lit(":"), F.col("payload_bytes")).alias("same"), "page_id").join(asked, "same", "left_semi").groupBy("same").agg(F.max("page_id").alias("refers_to"))
    again = again.join(named, "same", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(again.select(names))
