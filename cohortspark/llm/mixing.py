"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded draw per document.

Every document of a source gets the whole part of the source's rate as copies and, with the fraction as probability, one more.
The draws of a source hang together: along its documents by size, then by a hash of the id, the extra copies are spaced as
evenly as the fraction allows, from a seeded start. So each document's chance is the fraction, and the words taken end within
about one document of the target, however few or uneven the documents are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import broadcast_measured, fraction, null_safe, unwrapped, word_count, wrapped
from cohortspark.llm.registry import query, read
from cohortspark.operators.ranks import running_totals
from cohortspark.session import durable

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1:"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Targets from one row per source (``source``, ``source_size`` bigint): adds ``target`` double.

    Sources in code point order, null last, get the weights in turn. All sizes together are shared by weight; no target
    passes ``ceiling`` times its source's size, and what is cut off is shared among the rest by weight until none passes.
    Sorted by ceiling over weight, the sources that end at their ceiling come first, so two running sums find the level
    at which the others meet. Sources of size zero get zero. No rows give no rows.
    """
    placed = running_totals(sizes, [], [F.col("source").asc_nulls_last()], {"_pos": F.lit(1).cast("bigint")})
    cycle = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    ranked = placed.select("source", "source_size", F.get(cycle, ((F.col("_pos") - 1) % len(weights)).cast("int")).alias("_w"),
                           (F.col("source_size") * ceiling).alias("_cap"))
    sums = running_totals(ranked, [], [(F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()],
                          {"_caps": F.col("_cap"), "_ws": F.col("_w"), "_size": F.col("source_size")}, grand="_all_")
    # The level if all sources before this one are at their ceiling and this one and the later ones are not.
    before, weight_left = F.col("_caps") - F.col("_cap"), F.col("_all__ws") - F.col("_ws") + F.col("_w")
    left = F.col("_all__size") - before
    level = durable(sums.withColumn("_full", F.col("_cap") * weight_left < left * F.col("_w")))
    at = level.where(~F.col("_full")).agg(F.min(F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_caps", left.alias("left"), weight_left.alias("ws")))).first()[0]
    cap = F.col("_cap").cast("double")
    share = (F.lit(at["left"]) * F.col("_w")).cast("double") / F.lit(float(at["ws"])) if at else cap
    return level.select(*sizes.columns, F.when(F.col("_full"), cap).otherwise(F.least(share, cap)).alias("target"))


def rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """One row per source: ``source``, ``source_size`` (words of all its documents), ``target``."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)).cast("bigint").alias("source_size"))
    return source_targets(durable(sizes), weights, ceiling)


def _cuts(sized: DataFrame, table: DataFrame, seed: str) -> DataFrame:
    """``source, size, cut``: of a source's documents of one size, those whose hash is at most ``cut`` get an extra copy.

    A size's documents take as many copies as multiples of 1 / fraction, from the source's start, fall among their places. One
    row per source and size with extra copies; documents are only ordered where some of a size get one and some do not.
    """
    start = fraction(seed, F.col("source"))
    groups = running_totals(durable(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))), ["source"], ["size"], {"upto": F.col("n")})
    part = table.select("source", (F.col("rate") - F.floor("rate")).alias("part"))
    upto = lambda c: F.floor(start + c * F.col("part"))
    wanted = durable(null_safe(groups, broadcast_measured(part), ["source"]).withColumn(
        "extra", (upto(F.col("upto")) - upto(F.col("upto") - F.col("n"))).cast("bigint")).where("extra > 0").select("source", "size", "n", "extra"))
    some = broadcast_measured(wanted.where("extra < n"))
    placed = running_totals(null_safe(sized, some, ["source", "size"]), ["source", "size"], ["u", "at"], {"place": F.lit(1).cast("bigint")})
    return wanted.where("extra = n").select("source", "size", F.lit(1.0).alias("cut")).unionByName(
        placed.where("place = extra").select("source", "size", F.col("u").alias("cut")))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with (in place of columns so named) ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    Needs doc_id, text, source; other columns pass through. A null text has size 0; a null source is a source of its own.
    Rows of one source and size that repeat a doc_id get the same draw. The tables of sources and of sizes are broadcast when their
    measured size allows it; else a join follows, whose hot keys adaptive execution splits. No rows give no rows.
    """
    held = wrapped(docs, source=F.col("source"), size=word_count(F.col("text")), u=fraction(seed, F.col("doc_id")))
    sizes = rates(docs, weights, ceiling)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(F.lit(0.0))
    table = durable(sizes.withColumn("rate", rate))
    cuts = _cuts(durable(held.select("source", "size", "u", F.monotonically_increasing_id().alias("at"))), table, seed)
    joined = null_safe(held, broadcast_measured(table), ["source"], "left")
    joined = null_safe(joined, broadcast_measured(cuts), ["source", "size"], "left")
    copies = (F.floor("rate") + F.when(F.col("u") <= F.col("cut"), 1).otherwise(0)).cast("bigint")
    return unwrapped(joined, docs.columns, _size="size", _source_size="source_size", _target="target", _copies=copies)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as the plan says, columns unchanged."""
    planned = plan_mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"), weights, ceiling, seed)
    each = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return unwrapped(planned.where("_copies > 0").select("row", each), docs.columns)


# The level search of source_targets written plainly: try every source as the first that is not at its ceiling.
MIX_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w, 3 * source_size AS cap FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM w),
p AS (SELECT *, (SELECT sum(source_size) FROM t) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM r),
f AS (SELECT rest, ws FROM p WHERE cap * ws >= rest * w ORDER BY k LIMIT 1),
g AS (SELECT p.source, p.source_size, CASE WHEN p.cap * p.ws < p.rest * p.w THEN CAST(p.cap AS DOUBLE)
      ELSE least(CAST(f.rest * p.w AS DOUBLE) / CAST(f.ws AS DOUBLE), CAST(p.cap AS DOUBLE)) END AS target FROM p LEFT JOIN f ON true),
d AS (SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
      CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
      CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u,
      CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(s.source, 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS start
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, count(*) OVER (PARTITION BY source, size) AS n, count(*) OVER (PARTITION BY source ORDER BY size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
      row_number() OVER (PARTITION BY source, size ORDER BY u) AS k FROM d),
e AS (SELECT *, floor(start + upto * (rate - floor(rate))) - floor(start + (upto - n) * (rate - floor(rate))) AS extra FROM c)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u <= max(CASE WHEN k = extra THEN u END) OVER (PARTITION BY source, size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark, folder):
    """Every document's size, its source's size and target, and the words the mix takes of it."""
    planned = plan_mix(read(spark, folder, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                          F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
