"""Shared helpers: words, spans of pattern matches, measured broadcasts, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import durable, scratch_path

# A word is a run of anything but these six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 8 * 1024 * 1024
SUM_BLOCK = 256


def no_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(no_null(text), F.lit(WORD)).cast("bigint")


def words(text: Column) -> Column:
    return F.array_remove(F.split(no_null(text), BLANKS), "")


def fraction(seed: str, key: Column) -> Column:
    """Uniform number in [0, 1) from a key: the first 13 hex digits of an MD5, so SQL can follow it."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(16 ** 13))


def broadcast_measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Stores ``df`` and hints a broadcast only if the stored rows, counted byte by byte, stay under ``limit``."""
    kept = durable(df)
    width = sum((F.octet_length(F.coalesce(F.to_json(F.struct(F.col(c))), F.lit(""))) for c in kept.columns), F.lit(32))
    held = kept.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(kept) if held <= limit else kept


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage like a checkpoint, by a compressed table in the shared folder, of which later reads take columns."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; of the keys only the left ones stay. Other names must differ."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys])
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def split_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join with ``right``, which holds each key once, where few keys may hold most rows of ``left``.

    A key that repeats and has at least one in ``share`` rows is joined by broadcast, which at most ``share`` keys do; the rest
    is shuffled. Null keys find nothing and are not shuffled. ``left`` is read three times, so it should be stored or a plain scan.
    """
    total = left.count()
    hot = F.broadcast(durable(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > 1) & (F.col("__n") * share >= total)).select(key)))
    few = F.broadcast(durable(right.join(hot, key, "left_semi")))
    nulls = left.where(F.col(key).isNull()).join(right.limit(0), key, "left")
    some = left.join(hot, key, "left_semi").join(few, key, "left")
    rest = left.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(right, key, "left")
    return some.unionByName(rest).unionByName(nulls)


def wrapped(df: DataFrame, **added: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside the added columns, so that no name of the input can clash with them."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in added.items()])


def unwrapped(df: DataFrame, columns: Sequence[str], **added: Column | str) -> DataFrame:
    """The input's ``columns`` again, with the added ones; an input column of an added one's name gives way to it."""
    old = [F.col("row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*old, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in added.items()])


def byte_runs(held: pa.Array | pa.RecordBatch, size: int, by: int | None = None) -> Iterator[pa.Array | pa.RecordBatch]:
    """Runs of neighbouring values (or rows, by column ``by``) of about ``size`` bytes each; a longer one is alone."""
    if len(held):
        lengths = pc.fill_null(pc.binary_length(held if by is None else held.column(by)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(held)]
        for low, high in zip(cuts, cuts[1:]):
            yield held.slice(low, high - low)


def _running(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<bigint>"),
                       lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))


def _blocks(values: str) -> Column:
    last = F.greatest(F.ceil(F.size(values) / SUM_BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: _running(F.slice(F.col(values), b * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))


def _placed(blocks: str, totals: str) -> Column:
    before = lambda i: F.when(i > 0, F.get(F.col(totals), i - 1)).otherwise(F.lit(0))
    return F.flatten(F.transform(F.col(blocks), lambda r, i: F.transform(r, lambda x: x + before(i))))


def with_running_sums(df: DataFrame, out: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums of bigint arrays, in blocks, so that long arrays are not copied once per element."""
    step = df.select("*", *[c.alias(f"__v_{n}") for n, c in out.items()])
    step = step.select("*", *[F.when(F.size(f"__v_{n}") > 0, _blocks(f"__v_{n}")).alias(f"__b_{n}") for n in out])
    step = step.select("*", *[_running(F.transform(F.col(f"__b_{n}"), lambda r: F.element_at(r, -1))).alias(f"__t_{n}") for n in out])
    step = step.select("*", *[_placed(f"__b_{n}", f"__t_{n}").alias(n) for n in out])
    return step.drop(*[f"__{p}_{n}" for n in out for p in "vbt"])


def _spans(kind: str, grouped: bool) -> Column:
    end = lambda i: F.get(F.col(f"__e_{kind}"), i)
    return F.transform(F.col(f"__m_{kind}"), lambda m, i: F.struct(
        (end(i) - F.length(m)).alias("start"), end(i).alias("end"), m.alias("match"), (F.get(F.col(f"__g_{kind}"), i) if grouped else m).alias("part")))


def with_spans(df: DataFrame, text: str, kinds: dict[str, Column | str], groups: dict[str, int] | None = None) -> DataFrame:
    """For each kind adds an array of (start, end, match, part) of the pattern's leftmost, non-overlapping matches.

    Positions are code points, the end exclusive. ``part`` is the capture group named in ``groups`` (0: the match).
    A document without a match of a kind costs one pass of its pattern, and its array is null.
    """
    groups = groups or {}
    pattern = {k: p if isinstance(p, Column) else F.lit(p) for k, p in kinds.items()}
    step = df.select("*", *[F.regexp_extract_all(F.col(text), p, F.lit(0)).alias(f"__m_{k}") for k, p in pattern.items()])
    hit = {k: F.size(f"__m_{k}") > 0 for k in kinds}
    step = step.select("*", *[F.when(hit[k], F.split(F.col(text), p, -1)).alias(f"__p_{k}") for k, p in pattern.items()],
                       *[F.when(hit[k], F.regexp_extract_all(F.col(text), pattern[k], F.lit(g))).alias(f"__g_{k}") for k, g in groups.items()])
    step = with_running_sums(step, {f"__e_{k}": F.when(hit[k], F.zip_with(
        F.slice(F.col(f"__p_{k}"), F.lit(1), F.size(f"__m_{k}")), F.col(f"__m_{k}"), lambda a, b: (F.length(a) + F.length(b)).cast("bigint"))) for k in kinds})
    step = step.select("*", *[F.when(hit[k], _spans(k, k in groups)).alias(k) for k in kinds])
    return step.drop(*[f"__{p}_{k}" for k in kinds for p in "mpge"])


def span_list(kinds: Sequence[str]) -> Column:
    """All spans of the named columns as (start, rank, end, kind), ordered by start, then by the order of kinds."""
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    one = lambda i, k: F.coalesce(F.transform(F.col(k), lambda s: F.struct(
        s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind"))), empty)
    return F.array_sort(F.concat(*[one(i, k) for i, k in enumerate(kinds)]))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def components(links: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """Connected components of undirected links between bigint nodes: one row (node, root), root the least node.

    Alternates two kinds of star steps (every node's larger neighbours move to its least neighbour, then the smaller
    ones do) until nothing changes. Each step is one aggregation and one join; no group is ever collected. The links are
    stored after each round, so a lost executor costs one round. Null nodes are ignored; no links give no rows.
    """
    edges = durable(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, done = mark(edges), 0
    while seen[0] and (rounds is None or done < rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        now, done = mark(edges), done + 1
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
