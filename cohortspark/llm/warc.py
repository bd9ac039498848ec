"""Web archives: writing pages as request, response and metadata records, reading them, assembling captures.

Archives are written by Spark's text writer, whose line separator is the two line ends that close a record, compressed by
gzip per file; so any store that Spark writes to will do and a lost task leaves no half file. A task reads whole files, one
record at a time. Records of one capture name each other as concurrent; the capture's response (or revisit, or resource) is the
hub to which requests and metadata are traced, and one nested row per hub comes out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import broadcast_measured, no_null, split_join, stored
from cohortspark.llm.registry import query, read
from cohortspark.session import durable, scratch_path

LEAST_BYTES = 100
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HUBS = ("response", "revisit", "resource", "conversion")
HOPS = 2
CHUNK = 1 << 20
TOGETHER = 8 << 20


def _urn(kind: str, *of: Column) -> Column:
    """A record's id, the same at every run."""
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), *[c.alias(f"c{i}") for i, c in enumerate(of)])))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, block: Column, **fields: Column | str) -> Column:
    """Header and block; a field whose value is null is left out."""
    lines = [F.concat(F.lit(n.replace("_", "-") + ": "), v if isinstance(v, Column) else F.lit(v)) for n, v in fields.items()]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), *lines,
                                F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit("\r\n\r\n"), block)


def _first_copies(pages: DataFrame, least: int) -> DataFrame:
    """``digest, first_id, first_url`` of payloads of ``least`` bytes or more that several pages have: the smallest page_id's
    (null last), of those the smallest url's."""
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    return pages.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f")).where("n > 1") \
        .select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"), F.lit(True).alias("shared"))


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> None:
    """Writes three records per row of ``pages`` (page_id, url, html; null html is empty) under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that of the smallest page_id (null last, then the smaller url) is a
    response, the others are revisits of it; smaller payloads are responses. Rows that repeat page_id, url and html
    have the same record ids, so readers take them for copies of one capture. Files hold about ``file_bytes`` before
    compression, more where longer pages stand together. No rows write no records.
    """
    html = no_null(F.col("html").cast("string"))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7f]+", "%20").alias("url"),
                        F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"), html.alias("html"))
    total = base.agg(F.count(F.lit(1)), F.sum("size")).first()
    per_file = max(3, 3 * file_bytes // max((total[1] or 0) // max(total[0], 1), 1))
    shared = broadcast_measured(_first_copies(base.drop("html"), least))
    rows = split_join(base, shared, "digest") if total[0] else base.join(shared, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    again = F.coalesce(F.col("shared"), F.lit(False)) & ~same
    url, digest = F.col("url"), F.concat(F.lit("sha256:"), F.col("digest"))
    hub = _urn("capture", F.col("page_id"), url, F.col("digest"))
    target, when = {"WARC_Target_URI": url}, {"WARC_Date": date}
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    response = _record("response", F.concat(head, F.col("html")), WARC_Record_ID=hub, **when, **target, WARC_Payload_Digest=digest,
                       Content_Type="application/http; msgtype=response")
    revisit = _record("revisit", head, WARC_Record_ID=hub, **when, **target, WARC_Profile=PROFILE, WARC_Payload_Digest=digest,
                      WARC_Refers_To=_urn("capture", F.col("first_id"), F.col("first_url"), F.col("digest")), WARC_Refers_To_Target_URI=F.col("first_url"),
                      WARC_Refers_To_Date=date, Content_Type="application/http; msgtype=response")
    path_of, host = F.regexp_extract(no_null(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.regexp_extract(no_null(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path_of.startswith("/"), path_of).otherwise(F.concat(F.lit("/"), path_of)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _record("request", asked, WARC_Record_ID=_urn("request", F.col("page_id"), url, F.col("digest")), **when, **target, WARC_Concurrent_To=hub,
                      Content_Type="application/http; msgtype=request")
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", about, WARC_Record_ID=_urn("metadata", F.col("page_id"), url, F.col("digest")), **when, **target, WARC_Concurrent_To=hub,
                       Content_Type="application/warc-fields")
    records = rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


FIELDS = [("path", "string", pa.string()), ("offset", "long", pa.int64()), ("record_id", "string", pa.string()), ("type", "string", pa.string()),
          ("date", "string", pa.string()), ("target_uri", "string", pa.string()), ("concurrent_to", "array<string>", pa.list_(pa.string())),
          ("refers_to", "string", pa.string()), ("content_type", "string", pa.string()), ("declared_digest", "string", pa.string()),
          ("http_head", "string", pa.string()), ("http_length", "long", pa.int64()), ("fields", "map<string,string>", pa.map_(pa.string(), pa.string())),
          ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("problem", "string", pa.string()), ("payload", "binary", pa.large_binary())]


def _lines(source, closed: bool = True) -> list[tuple[str, str]] | None:
    """Name and value of the header lines up to an empty one; None if ``closed`` ones end without it."""
    out = []
    while line := source.readline():
        if not line.strip():
            return out
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return None if closed else out


class _Block:
    """The next ``length`` bytes of a source."""

    def __init__(self, source, length: int):
        self.source, self.left = source, length

    def take(self, data: bytes) -> bytes:
        self.left -= len(data)
        return data

    def readline(self) -> bytes:
        return self.take(self.source.readline(self.left)) if self.left else b""

    def pieces(self) -> Iterator[bytes]:
        while self.left:
            piece = self.take(self.source.read(min(self.left, CHUNK)))
            if not piece:
                raise EOFError("the block ends early")
            yield piece


def parse(content: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of an archive, plain or gzip, in order. What cannot be read is one row with its ``problem``, the last of the file."""
    source = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    offset = 0
    try:
        while True:
            offset = source.tell()
            line = source.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            held = _lines(source)
            named = dict(reversed(held or []))
            if held is None or not named.get("content-length", "").isdigit():
                raise ValueError("the header has no length")
            block = _Block(source, int(named["content-length"]))
            row = {"offset": offset, "record_id": named.get("warc-record-id"), "type": named.get("warc-type"), "date": named.get("warc-date"),
                   "target_uri": named.get("warc-target-uri"), "concurrent_to": [v for n, v in held if n == "warc-concurrent-to"], "refers_to": named.get("warc-refers-to"),
                   "content_type": named.get("content-type"), "declared_digest": named.get("warc-payload-digest"), "http_head": None, "http_length": None, "fields": None}
            if (row["content_type"] or "").startswith("application/http"):
                row["http_head"] = block.readline().decode("utf-8", "replace").strip()
                length = dict(_lines(block, False)).get("content-length", "")
                row["http_length"] = int(length) if length.isdigit() and len(length) < 19 else None
            elif row["content_type"] == "application/warc-fields":
                row["fields"] = dict(reversed(_lines(block, False)))
            digest, size, kept = hashlib.sha256(), 0, []
            for piece in block.pieces():
                digest.update(piece)
                size += len(piece)
                if payloads:
                    kept.append(piece)
            yield {**row, "payload_bytes": size, "payload_sha256": digest.hexdigest(), "problem": None, "payload": b"".join(kept) if payloads else None}
    except (ValueError, OSError, EOFError) as e:
        yield {"offset": offset, "problem": str(e)}


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``, whatever the files' names. Without ``payloads`` that column is null.

    ``payload_bytes`` and ``payload_sha256`` are of the bytes found (after the HTTP header, if any). An empty folder gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for r in parse(content.as_py(), payloads):
                    rows.append({"path": name, **r})
                    size += 1000 + len(r.get("payload") or b"")
                    if size >= TOGETHER:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v := r.get(n), dict) else v for r in rows], t) for n, _, t in FIELDS], [n for n, _, _ in FIELDS])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))
    return files.select("path", "content").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in FIELDS))


def with_hubs(records: DataFrame, hops: int = HOPS) -> DataFrame:
    """Adds ``hub``: the id of the response, revisit, resource or conversion to which a record's concurrent-to links lead.

    Links count in both directions and lead over up to ``hops`` other records (metadata of a request of a response). Of several
    links the smallest id counts. A record that leads nowhere has the id it reached, which no hub has.
    """
    is_hub = F.col("type").isin(*HUBS)
    keyed = records.withColumn("hub", F.when(is_hub, F.col("record_id")).otherwise(F.coalesce(F.array_min("concurrent_to"), F.col("record_id"))))
    links = records.where(F.size("concurrent_to") > 0).select("record_id", F.explode("concurrent_to").alias("to"), is_hub.alias("from_hub"))
    # From any record but a hub towards what it names, or towards a hub that names it.
    steps = links.where("from_hub").select(F.col("to").alias("hub"), F.col("record_id").alias("next"), F.lit(0).alias("after")).unionByName(
        links.where("NOT from_hub").select(F.col("record_id").alias("hub"), F.col("to").alias("next"), F.lit(1).alias("after"))).groupBy("hub").agg(
        F.min_by("next", F.struct("after", "next")).alias("next"))
    slim = keyed.where("hub IS NOT NULL").groupBy("hub").agg(F.max(is_hub & (F.col("record_id") == F.col("hub"))).alias("found"))
    moved = None
    for _ in range(hops):
        lost = (slim if moved is None else moved.select(F.col("next").alias("hub")).join(slim.where("found"), "hub", "left_anti").distinct().withColumn("found", F.lit(False)))
        step = durable(lost.where("NOT found").select("hub").join(steps, "hub").where("next != hub"))
        if not step.limit(1).count():
            break
        if moved is None:
            moved = step
        else:
            onward = step.select(F.col("hub").alias("next"), F.col("next").alias("after"))
            moved = durable(moved.join(onward, "next", "left").select("hub", F.coalesce("after", "next").alias("next")))
    if moved is None:
        return keyed
    return split_join(keyed, moved, "hub").withColumn("hub", F.coalesce("next", "hub")).drop("next")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, copies, target_uri, date, response, request, metadata, n_requests, n_metadata``.

    ``response`` is the hub (a revisit or resource too), the others the first record of their kind that leads to it, by record id;
    each is a struct of the record's columns, null where there is none. ``copies`` counts the records with the hub's id, so
    archives read twice change nothing else. Records of no capture and those beyond the first are in ``unassembled``.
    """
    columns = [c for c in records.columns if c != "hub"]
    hubs = with_hubs(records).where("hub IS NOT NULL").withColumn("r", F.struct(*columns)).withColumn("at", F.struct("record_id", "path", "offset"))
    is_hub, kind = F.col("type").isin(*HUBS), lambda k: F.col("type") == k
    first = lambda on: F.min_by("r", F.when(on, F.col("at")))
    out = hubs.groupBy("hub").agg(F.count(F.when(is_hub, 1)).alias("copies"), first(is_hub).alias("response"), first(kind("request")).alias("request"),
                                  first(kind("metadata")).alias("metadata"), F.count(F.when(kind("request"), 1)).alias("n_requests"), F.count(F.when(kind("metadata"), 1)).alias("n_metadata"))
    return out.where("copies > 0").select(F.col("hub").alias("capture_id"), "copies", "response.target_uri", "response.date", "response", "request", "metadata", "n_requests", "n_metadata")


def unassembled(records: DataFrame, captures: DataFrame) -> DataFrame:
    """The records that no row of ``captures`` holds: of other kinds, without a hub, beyond the first of their kind, with a problem."""
    held = captures.select(F.explode(F.array("capture_id", "request.record_id", "metadata.record_id")).alias("record_id")).where("record_id IS NOT NULL")
    return records.join(held, "record_id", "left_anti")


def resolve(captures: DataFrame) -> DataFrame:
    """Adds ``original``: for a revisit the nested ``metadata`` fields, bytes and digest of the capture it refers to.

    Null for other captures and where the archives lack the original. ``captures`` should be stored.
    """
    originals = captures.where(F.col("response.type") == "response").select(F.col("capture_id").alias("refers_to"), F.struct(
        "target_uri", F.col("metadata.fields").alias("fields"), "response.payload_bytes", "response.payload_sha256").alias("original"))
    revisits = captures.where(F.col("response.type") == "revisit").withColumn("refers_to", F.col("response.refers_to"))
    others = captures.where(~F.col("response.type").eqNullSafe("revisit")).withColumn("refers_to", F.lit(None).cast("string")).withColumn(
        "original", F.lit(None).cast(originals.schema["original"].dataType))
    return split_join(revisits, originals, "refers_to").unionByName(others).drop("refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d
"""


@query("op11_warc", WARC_SQL)
def op11_warc(spark, folder):
    """Writes all pages to archives, reads these back, assembles captures and resolves revisits."""
    path = scratch_path(spark, "warc")
    write(read(spark, folder, "pages"), path)
    records = stored(read_records(spark, path, payloads=False).drop("payload"), "warc-records")
    captures = stored(assemble(records), "warc-captures")
    found = resolve(captures).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    page = lambda fields: F.col(fields)["page-id"].cast("bigint")
    revisit = F.col("response.type") == "revisit"
    return found.select(
        page("metadata.fields").alias("page_id"), F.when(revisit, F.coalesce("original.payload_bytes", "response.http_length")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce(F.col("original.payload_sha256"), F.substring("response.declared_digest", 8, 64))).otherwise(F.col("response.payload_sha256")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), page("original.fields").alias("refers_to"))
