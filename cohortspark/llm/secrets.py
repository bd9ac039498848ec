"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds one row per blob, rule and rule
version that has been scanned, with or without findings, and the update it came with. A scan visits only pairs the ledger
lacks; findings go back to all paths that hold the blob by a join on the address, in which often repeated blobs are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import no_null, span_list, span_text, split_join, unwrapped, with_spans, wrapped
from cohortspark.llm.registry import query, read
from cohortspark.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern with its version. Matches count whose capture group ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The patterns of the three base kinds. Runs of hex digits and of key letters are asked for at their least
# length at once, which finds the same spans as dropping the shorter ones afterwards.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{16,}"),
)
# The scan's own additions to the base kinds, as they were at first and as they are.
FIRST = (
    Rule("pem", 1, r"-----BEGIN PRIVATE KEY-----"),
)
ADDED = (
    Rule("pem", 2, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
)
RULES = BASE + ADDED
LEDGER_SCHEMA = "blob string, kind string, version int, found array<struct<start:bigint,end:bigint>>, update int"


def address():
    return F.sha2(no_null(F.col("text")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows (``blob, kind, version, found``) for the (blob, rule version) pairs that ``ledger`` lacks.

    Equal texts meet once, combined before the shuffle. A null text is the empty blob. No documents give no rows.
    """
    blobs = docs.groupBy(address().alias("blob")).agg(F.first(no_null(F.col("text"))).alias("text"))
    if ledger is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    key = {r.kind: f"{r.kind}:{r.version}" for r in rules}
    todo = todo.where(F.size(F.array_except(F.array(*[F.lit(k) for k in key.values()]), "done")) > 0)
    # A rule that has seen the blob gets an empty text.
    for_rule = todo.select("blob", "done", "text")
    found = with_spans(for_rule, "text", {r.kind: r.pattern for r in rules}, {r.kind: r.group for r in rules if r.group}) if ledger is None \
        else _fresh(for_rule, rules, key)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    kept = [F.coalesce(_long_enough(r), none).alias("found") for r in rules]
    rows = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), f) for r, f in zip(rules, kept, strict=True)])
    fresh = found.select("blob", "done", F.explode(rows).alias("r")).where(
        ~F.array_contains("done", F.concat_ws(":", "r.kind", "r.version")))
    return fresh.select("blob", "r.kind", "r.version", "r.found")


def _long_enough(rule: Rule):
    return F.transform(F.filter(F.col(rule.kind), lambda s: F.length(s["part"]) >= rule.least),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _fresh(todo: DataFrame, rules: Sequence[Rule], key: dict[str, str]) -> DataFrame:
    out = todo
    for r in rules:
        out = out.withColumn("_todo", F.when(~F.array_contains("done", key[r.kind]), F.col("text")))
        out = with_spans(out, "_todo", {r.kind: r.pattern}, {r.kind: r.group} if r.group else None).drop("_todo")
    return out


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``docs`` with one array column per rule, named as its kind (in place of one so named): its spans by the ledger's
    row of the rule's version; and ``first_scan``, the update with which the ledger first had the row's text.

    A column is null where the ledger has no row yet. Rows that share a text share its findings.
    """
    wanted = lambda r: (F.col("kind") == r.kind) & (F.col("version") == r.version)
    per_blob = ledger.groupBy("blob").agg(*[F.first(F.when(wanted(r), F.col("found")), True).alias(r.kind) for r in rules], F.min("update").alias("first_scan"))
    joined = split_join(wrapped(docs, blob=address()), per_blob, "blob")
    return unwrapped(joined, docs.columns, **{r.kind: r.kind for r in rules}, first_scan="first_scan")


def update_ledger(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scans what the ledger under ``path`` lacks, appends it there and returns the whole ledger. Updates are numbered from 1."""
    spark = docs.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(path) if exists else None
    number = 1 + (known.agg(F.max("update")).first()[0] or 0 if exists else 0)
    scan(docs, known, rules).withColumn("update", F.lit(number)).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scanned_pairs(ledger: DataFrame) -> DataFrame:
    """``update, kind, version, pairs``: how many blobs each update has scanned with each rule version."""
    return ledger.groupBy("update", "kind", "version").agg(F.count(F.lit(1)).alias("pairs"))


_SPAN_SQL = """list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT),
 'rank': {rank}, 'end': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT), 'kind': '{kind}', 'part': {part}}})"""


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int, flags: str = "") -> str:
    pattern = pattern.replace("'", "''")
    part = "length(g[i])" if group else "length(m[i])"
    return f"""SELECT doc_id, {rank} AS rank, list_filter({_SPAN_SQL.format(rank=rank, kind=kind, part=part)}, lambda s: s.part >= {least}) AS s
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0{flags}) AS m, regexp_extract_all(text, '{pattern}', {group}{flags}) AS g,
      string_split_regex(text, '{"(?i)" if flags else ""}{pattern}') AS p FROM t)"""


_KINDS_SQL = (
    (1, "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ", 'i'"),
    (2, "access", r"AKIA[A-Z0-9]+", 0, 18),
    (3, "hex", r"[0-9a-f]{16,}", 0, 16),
    (4, "pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 0),
)
_JOINED = "coalesce(array_to_string(list_transform(list_sort({0}), lambda s: s.kind || ':' || s.start || ':' || s.end), ','), '')"
SECRETS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join(_kind_sql(*x) for x in _KINDS_SQL)}),
d AS (SELECT doc_id, max(CASE WHEN rank = 1 THEN len(s) END) AS n_assign, max(CASE WHEN rank = 2 THEN len(s) END) AS n_access,
      max(CASE WHEN rank = 3 THEN len(s) END) AS n_hex, flatten(list(s ORDER BY rank) FILTER (rank <= 3)) AS base, flatten(list(s ORDER BY rank)) AS every FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(n_assign AS BIGINT) AS n_assign, CAST(n_access AS BIGINT) AS n_access, CAST(n_hex AS BIGINT) AS n_hex,
       sha256({_JOINED.format("base")}) AS base_sha256, {_JOINED.format("every")} AS spans, CAST(first_scan AS BIGINT) AS first_scan
FROM d JOIN (SELECT doc_id, min(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY text) AS first_scan FROM t) f ON f.doc_id = d.doc_id
"""


@query("op4_secrets", SECRETS_SQL)
def op4_secrets(spark, folder):
    """Findings of all documents from a ledger kept over two crawls: the first knows a third of the documents and the first rules,
    the second is the whole table, under the rules as they are. Of texts known by then, only the changed rule is scanned again."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    path = scratch_path(spark, "ledger")
    update_ledger(docs.where("doc_id % 3 = 0"), path, BASE + FIRST)
    found = findings(docs, update_ledger(docs, path, RULES))
    base = [r.kind for r in BASE]
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
                        F.sha2(span_text(span_list(base)), 256).alias("base_sha256"), span_text(span_list([r.kind for r in RULES])).alias("spans"),
                        F.col("first_scan").cast("bigint").alias("first_scan"))
