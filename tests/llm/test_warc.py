import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from cohortspark.llm.common import split_join
from cohortspark.llm.warc import assemble, parse, read_records, resolve, unassembled, write

BIG = "<p>" + "payload\r\n\r\nWARC/1.1\r\n" * 20
PAGES = [(1, "http://a.org/x?y=1#f", "<p>é𝄞</p>"), (2, "https://b.org", None), (3, "http://c.org/ a\r\nb", ""), (9, "http://d.org/1", BIG), (4, "http://d.org/2", BIG),
         (5, None, BIG), (6, "u", "x" * 99), (7, "u", "x" * 99), (8, "u", "x" * 100), (10, "u", "x" * 100), (11, "long", "word \r\n\r\n" * 100_000), (None, "n", "y" * 200), (12, "m", "y" * 200),
         (13, "tie/b", "z" * 300), (13, "tie/a", "z" * 300), (4, "http://d.org/2", BIG)]


def plain(pages):
    best = {}
    for i, u, h in pages:
        if len((h or "").encode()) >= 100:
            k = (i is None, i or 0, u is None, u or "")
            best[h] = min(best.get(h, (k, i, u)), (k, i, u), key=lambda x: x[0])
    out = []
    for i, u, h in pages:
        raw = (h or "").encode()
        again = h in best and best[h][1:] != (i, u)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", best[h][1] if again else None))
    return sorted(out, key=str)


def through(spark, pages, path, **more):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("digest", "size", "value", "shared", "first_id"):
        df = df.withColumn(c, F.lit("x"))
    write(df, path, **more)
    return read_records(spark, path)


@pytest.mark.parametrize("size", [1000, 64 << 20])
def test_pages_come_back(spark, tmp_path, size):
    records = through(spark, PAGES, str(tmp_path / "w"), file_bytes=size).cache()
    assert records.count() == 3 * len(PAGES) and records.where("problem IS NOT NULL").count() == 0
    captures = assemble(records).cache()
    assert captures.count() == len(PAGES) - 1 and unassembled(records, captures).count() == 0
    got, by_page = [], {}
    for r in resolve(captures).collect():
        page = r["metadata"]["fields"].get("page-id")
        revisit, o = r["response"]["type"] == "revisit", r["original"]
        assert (o is not None) == revisit and r["n_requests"] == r["n_metadata"] == r["copies"]
        of = o if revisit else r["response"]
        row = (int(page) if page else None, of["payload_bytes"], of["payload_sha256"], r["response"]["type"], int(o["fields"]["page-id"]) if revisit else None)
        got += [row] * r["copies"]
        by_page[row[0]] = r
        assert r["response"]["declared_digest"] == "sha256:" + row[2] and r["response"]["http_length"] == row[1]
    assert sorted(got, key=str) == plain(PAGES)
    assert bytes(by_page[11]["response"]["payload"]).decode() == PAGES[10][2] and bytes(by_page[4]["response"]["payload"]).decode() == BIG
    assert by_page[1]["request"]["http_head"] == "GET /x?y=1 HTTP/1.1" and by_page[2]["request"]["http_head"] == "GET / HTTP/1.1"
    assert by_page[3]["target_uri"] == "http://c.org/%20a%20b" and by_page[5]["target_uri"] is None


def test_no_pages(spark, tmp_path):
    records = through(spark, [], str(tmp_path / "w"))
    assert records.collect() == [] and resolve(assemble(records)).collect() == []


def record(kind, name, *links, block=b"", typed="text/plain"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"WARC-Concurrent-To: {x}" for x in links], f"Content-Type: {typed}", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_links_of_foreign_archives(spark, tmp_path):
    made = [record("warcinfo", "i"), record("response", "p1", "q1"), record("request", "q1"),               # the response names the request
            record("response", "p2"), record("request", "q2", "p2"), record("metadata", "m2", "q2"),          # metadata of the request
            record("resource", "p3"), record("metadata", "m3b", "p3"), record("metadata", "m3a", "p3"),       # two of a kind
            record("request", "q4", "gone"), record("metadata", "m5", "m6"), record("metadata", "m6", "m5"),  # no capture
            record("revisit", "p7", "m7", "q7"), record("metadata", "m7"), record("request", "q7", "m7")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made[:8]))
    (tmp_path / "w" / "two.warc").write_bytes(b"".join(made[8:]))
    (tmp_path / "w" / "again.warc").write_bytes(made[3] + made[4])
    (tmp_path / "w" / "cut.warc").write_bytes(record("response", "p8") + record("response", "p9", block=b"12345")[:-7])
    records = read_records(spark, str(tmp_path / "w"))
    captures = assemble(records)
    got = {r["capture_id"]: (r["response"]["type"], r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"], r["copies"], r["n_metadata"]) for r in captures.collect()}
    assert got == {"p1": ("response", "q1", None, 1, 0), "p2": ("response", "q2", "m2", 2, 1), "p3": ("resource", None, "m3a", 1, 2),
                   "p7": ("revisit", "q7", "m7", 1, 1), "p8": ("response", None, None, 1, 0)}
    left = unassembled(records, captures).collect()
    assert sorted(r["record_id"] for r in left if r["record_id"]) == ["i", "m3b", "m5", "m6", "q4"] and [r["problem"] is not None for r in left if not r["record_id"]] == [True]
    assert [r["original"] for r in resolve(captures).where("response.type = 'revisit'").collect()] == [None]


def test_parse_reads_odd_headers():
    text = b"\r\nWARC/1.1\r\nwarc-type:  response\r\nWARC-Record-ID: <a>\r\nX-Long: one\r\n  two\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert [(r["type"], r["record_id"], r["payload"]) for r in parse(text)] == [("response", "<a>", b"ok")]
    assert [r["problem"] is None for r in parse(b"no archive")] == [False] and list(parse(b"")) == []
    assert [r["problem"] is None for r in parse(gzip.compress(text)[:-9])][-1] is False


def test_split_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 3 else str(i), i) for i in range(300)], "k string, i long")
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("6", 3), ("never", 4)], "k string, v long")
    key = lambda r: r["i"]
    for share in (1, 2, 1000):
        assert sorted(split_join(left, right, "k", share).collect(), key=key) == sorted(left.join(right, "k", "left").collect(), key=key)
