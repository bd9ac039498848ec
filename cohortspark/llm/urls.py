"""URL filters by a temporal list join.

A dated list says of hosts, domains (with all hosts below) and single URLs from which day they are listed and from which
day no longer. Its entries become validity intervals per key; every capture is evaluated against the interval in force on
the day it was fetched, for its URL, its host and every domain above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import null_safe, unwrapped
from cohortspark.llm.registry import query, read


def host(url: Column) -> Column:
    """Lower-cased host of an absolute URL, without user, port and a last dot; empty when there is none."""
    return F.rtrim(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), F.lit("."))


def list_keys(url: Column) -> Column:
    """Keys a list may hold for a URL, closest first: ``url:`` without fragment, ``host:``, then each ``domain:`` above."""
    h = host(url)
    labels = F.split(h, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(h != "", F.concat(F.array(F.concat(F.lit("url:"), F.regexp_replace(url, "#.*", "")), F.concat(F.lit("host:"), h)), above)).otherwise(
        F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, start, stop, category`` from entries (key, day, listed, category): days in [start, stop) on which a key is
    listed; an open end is null. Of a key's entries of one day a listing wins, then the greatest category.

    A key has at most one row per day before the window, so no task's share follows the number of entries.
    """
    daily = entries.where("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "day").agg(
        F.max(F.struct(F.coalesce(F.col("listed"), F.lit(False)).alias("listed"), "category")).alias("e"))
    after = Window.partitionBy("key").orderBy("day")
    spans = daily.select("key", F.col("day").alias("start"), F.lead("day").over(after).alias("stop"), "e.listed", "e.category")
    return spans.where("listed").drop("listed")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` with ``blocked`` (boolean), ``matched`` (closest listed key) and ``category`` in place of columns so named.

    Each key and day is looked up once: the last interval begun by then, if not over. URLs without a host and rows without
    a day are not blocked. Rows that repeat stay; empty tables give no rows or no blocked ones.
    """
    rows = captures.select(F.struct("*").alias("row"), F.col(url).alias("url"), F.col(day).cast("date").alias("day"))
    asked = rows.select("url", "day").distinct().where("url IS NOT NULL AND day IS NOT NULL")
    asked = asked.select("url", "day", F.posexplode(list_keys(F.col("url"))).alias("place", "key"))
    known = intervals(entries)
    marks = asked.select("key", "day").distinct().withColumn("span", F.lit(None).cast("struct<start:date,stop:date,category:string>")).withColumn("probe", F.lit(1))
    begun = known.select("key", F.col("start").alias("day"), F.struct("start", "stop", "category").alias("span"), F.lit(0).alias("probe"))
    asof = Window.partitionBy("key").orderBy("day", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = marks.unionByName(begun).withColumn("last", F.last("span", ignorenulls=True).over(asof)).where("probe = 1")
    listed = held.where(F.col("last").isNotNull() & (F.col("last.stop").isNull() | (F.col("day") < F.col("last.stop"))))
    listed = listed.select(F.col("key").alias("lkey"), F.col("day").alias("lday"), F.col("last.category").alias("category"))
    hit = asked.join(listed, (F.col("key") == F.col("lkey")) & (F.col("day") == F.col("lday"))).groupBy("url", "day").agg(
        F.min(F.struct("place", F.col("key").alias("matched"), "category")).alias("hit"))
    joined = null_safe(rows, hit, ["url", "day"], "left")
    return unwrapped(joined, captures.columns, blocked=F.col("hit").isNotNull(), matched=F.col("hit.matched"), category=F.col("hit.category"))


def _digit(seed: str, value: Column, mod: int) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), value)), 1, 8), 16, 10).cast("bigint") % mod).cast("int")


def demo_captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetching within a year, from a hash of their id (the table has none)."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _digit("fetch:", F.col("page_id").cast("string"), 365)).alias("fetched"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list from the pages' own hosts: of every host in three listed on one day, half of them taken off later; of
    domains one level up every tenth; of URLs every twentieth."""
    keys = pages.select(F.explode(list_keys(F.col("url"))).alias("key")).distinct()
    every = F.when(F.col("key").startswith("host:"), 3).when(F.col("key").startswith("url:"), 20).otherwise(10)
    picked = keys.where((F.col("key").rlike("^(host|url):") | F.col("key").rlike(r"^domain:[^.]+\.[^.]+\.")) & (_digit("pick:", F.col("key"), 60) % every == 0))
    at = F.date_add(F.lit("2024-01-01").cast("date"), _digit("on:", F.col("key"), 300))
    on = picked.select("key", at.alias("day"), F.lit(True).alias("listed"), F.element_at(F.array(F.lit("spam"), F.lit("adult"), F.lit("malware")), _digit("kind:", F.col("key"), 3) + 1).alias("category"))
    off = picked.where(_digit("off:", F.col("key"), 2) == 0).select("key", F.date_add(at, _digit("len:", F.col("key"), 90) + 1).alias("day"), F.lit(False).alias("listed"), F.lit(None).cast("string").alias("category"))
    return on.unionByName(off)


def _digit_sql(seed: str, value: str, mod: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('{seed}' || {value}), 1, 8) AS BIGINT) % {mod} AS INTEGER)"


URLS_SQL = rf"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + {_digit_sql("fetch:", "page_id", 365)} AS fetched,
    rtrim(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')), '.') AS h FROM pages),
l AS (SELECT *, string_split(h, '.') AS ls FROM p WHERE h <> ''),
k AS (SELECT page_id, url, fetched, unnest(list_concat(['url:' || regexp_replace(url, '#.*', ''), 'host:' || h],
    list_transform(range(1, len(ls) + 1), lambda i: 'domain:' || array_to_string(ls[i:], '.')))) AS key,
    unnest(range(0, len(ls) + 2)) AS place FROM l),
d AS (SELECT DISTINCT key FROM k),
s AS (SELECT key, DATE '2024-01-01' + {_digit_sql("on:", "key", 300)} AS day FROM d
    WHERE (regexp_matches(key, '^(host|url):') OR regexp_matches(key, '^domain:[^.]+\.[^.]+\.'))
    AND {_digit_sql("pick:", "key", 60)} % (CASE WHEN starts_with(key, 'host:') THEN 3 WHEN starts_with(key, 'url:') THEN 20 ELSE 10 END) = 0),
i AS (SELECT key, day AS start, CASE WHEN {_digit_sql("off:", "key", 2)} = 0 THEN day + {_digit_sql("len:", "key", 90)} + 1 END AS stop,
    ['spam', 'adult', 'malware'][{_digit_sql("kind:", "key", 3)} + 1] AS category FROM s),
m AS (SELECT k.page_id, arg_min(k.key, place) AS matched, arg_min(category, place) AS category
    FROM k JOIN i ON k.key = i.key AND k.fetched >= i.start AND (i.stop IS NULL OR k.fetched < i.stop) GROUP BY k.page_id)
SELECT p.page_id, CAST(p.fetched AS DATE) AS fetched, m.matched IS NOT NULL AS blocked, m.matched, m.category FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


@query("op5_urls", URLS_SQL)
def op5_urls(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", "url")
    return evaluate(demo_captures(pages), demo_entries(pages)).select("page_id", "fetched", "blocked", "matched", "category")
