import datetime as dt

from cohortspark.llm.urls import evaluate

DAY = lambda n: dt.date(2024, 1, n)


def test_intervals_and_places(spark):
    entries = spark.createDataFrame([
        ("domain:bad.org", DAY(5), True, "spam"), ("domain:bad.org", DAY(10), False, None), ("domain:bad.org", DAY(15), True, "malware"),
        ("host:a.bad.org", DAY(7), True, "adult"), ("host:a.bad.org", DAY(7), False, None), ("url:http://ok.org/x?y", DAY(1), True, "spam"),
        (None, DAY(1), True, "spam"), ("host:ok.org", None, True, "spam"), ("domain:late.org", DAY(9), None, "spam")], "key string, day date, listed boolean, category string")
    cases = [
        (1, "http://bad.org/", 4, None), (2, "http://bad.org/", 5, ("domain:bad.org", "spam")), (3, "https://u:p@X.Bad.org:80/p", 9, ("domain:bad.org", "spam")),
        (4, "http://bad.org", 10, None), (5, "http://bad.org", 31, ("domain:bad.org", "malware")), (6, "http://a.bad.org/", 8, ("host:a.bad.org", "adult")),
        (7, "http://b.a.bad.org/", 8, ("domain:bad.org", "spam")), (8, "http://ok.org/x?y#frag", 2, ("url:http://ok.org/x?y", "spam")), (9, "http://ok.org/x", 2, None),
        (10, "http://notbad.org/", 6, None), (11, None, 6, None), (12, "", 6, None), (13, "http://bad.org/", None, None), (14, "http://late.org/", 20, None),
        (2, "http://bad.org/", 5, ("domain:bad.org", "spam")), (15, "http://" + "a." * 500 + "bad.org./", 6, ("domain:bad.org", "spam")), (None, "http://bad.org/", 6, ("domain:bad.org", "spam"))]
    rows = [(i, u, DAY(d) if d else None, "x", "x") for i, u, d, _ in cases]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched date, matched string, key string")
    got = sorted(((r["page_id"] or 0, r["url"] or "", (r["matched"], r["category"]) if r["blocked"] else None, r["key"]) for r in evaluate(caps, entries).collect()), key=str)
    assert got == sorted(((i or 0, u or "", w, "x") for i, u, _, w in cases), key=str)
    assert evaluate(caps.limit(0), entries).collect() == []
    assert not any(r["blocked"] for r in evaluate(caps, entries.limit(0)).collect())
