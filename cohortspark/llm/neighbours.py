"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector; its hash is the
signed axis it is then nearest to. A table's key joins as many such hashes as keep its buckets small, so keys grow with the
rows. Queries probe each table's most promising keys, best first; what they find is reranked by exact distance on the original
vectors. How many keys to probe is fitted: a bounded sample of rows is compared with all rows, and the places of their true
neighbours' keys say how many probes reach the recall asked for.

The work on a key's first hashes is dealt in blocks of rows and of queries, so no task's size follows a hot key. Rows travel
with their vectors, once a table, and not as pairs of ids: a query has far more candidates than there are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import broadcast_measured
from cohortspark.llm.registry import query, read
from cohortspark.session import durable

TABLES = 4
RECALL = 0.98
SAMPLE = 256
BUCKET = 64
NEAREST = 10
ROWS = 8192
QUERIES = 2048
SEED = 20
CHUNK = 256
PAIRS = 1 << 15


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of the rows; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotated(unit: np.ndarray, table: int, at: int) -> np.ndarray:
    """Coordinates on the axes and their opposites after the table's pseudo-rotation for the given hash of its key."""
    rng, size = np.random.default_rng([SEED, table, at]), 1 << max(unit.shape[1] - 1, 0).bit_length()
    x = np.pad(unit, ((0, 0), (0, size - unit.shape[1])))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return np.concatenate([x, -x], axis=1)


def codes_of(dim: int) -> int:
    """Number of signed axes."""
    return 2 << max(dim - 1, 0).bit_length()


def hashes_for(rows: int, dim: int) -> int:
    """Hashes a key needs for buckets of about ``BUCKET`` rows or fewer."""
    return max(1, math.ceil(math.log(max(rows / BUCKET, 1)) / math.log(codes_of(dim)) - 1e-9))


def _doubles(packed: list[bytes], dim: int) -> np.ndarray:
    """Stored vectors: four or eight bytes a component, as the table has them."""
    raw = b"".join(packed)
    return np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * dim * len(packed) else "<f8").reshape(-1, dim).astype(np.float64)


def _unit(packed: list[bytes], dim: int) -> np.ndarray:
    x = _doubles(packed, dim)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, dim, packed`` of the vectors that take part: not null, not zero, all components finite; of an id's vectors the
    shortest, then the first in order."""
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    v = F.transform(F.col(vector), lambda x: x.cast("float" if single else "double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(x, dtype="<f4" if single else "<f8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], ["id", "dim", "packed"])

    held = vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(F.coalesce(good, F.lit(False)))
    one = held.groupBy("id").agg(F.min(F.struct(F.size("v").alias("n"), "v")).alias("s")).select("id", "s.v")
    return one.mapInArrow(run, "id long, dim int, packed binary")


def keyed(rows: DataFrame, tables: int, hashes: dict[int, int]) -> DataFrame:
    """Per row and table: ``dim, tab, c1`` (all hashes of its key but the last, as one number), ``c2`` (the last) and ``id, packed``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, part in frame.groupby("dim"):
                unit = _unit(part["packed"].tolist(), dim)
                for t in range(tables):
                    first = np.zeros(len(part), np.int64)
                    for h in range(hashes[dim] - 1):
                        first = first * codes_of(dim) + rotated(unit, t, h).argmax(axis=1)
                    yield pd.DataFrame({"dim": dim, "tab": t, "c1": first, "c2": rotated(unit, t, hashes[dim] - 1).argmax(axis=1),
                                        "id": part["id"].to_numpy(), "packed": part["packed"].to_numpy()})

    return rows.mapInPandas(run, "dim int, tab int, c1 long, c2 int, id long, packed binary")


def best_keys(parts: list[np.ndarray], count: int) -> np.ndarray:
    """Per query the ``count`` keys with the largest sums of one coordinate of each hash, as mixed numbers, best first.

    Two lists sorted from the best are joined at a time. A pair of places i and j has (i + 1)(j + 1) - 1 pairs that are no
    worse, so only pairs with (i + 1)(j + 1) up to ``count`` are added up: about count * ln(count) of them.
    """
    codes = parts[0].shape[1]
    order = np.argsort(-parts[0], axis=1, kind="stable")[:, :count]
    keys, score = order.astype(np.int64), np.take_along_axis(parts[0], order, axis=1)
    for part in parts[1:]:
        order = np.argsort(-part, axis=1, kind="stable")[:, :count]
        more = np.take_along_axis(part, order, axis=1)
        i = np.repeat(np.arange(score.shape[1]), [min(count // (k + 1), more.shape[1]) for k in range(score.shape[1])])
        j = np.concatenate([np.arange(min(count // (k + 1), more.shape[1])) for k in range(score.shape[1])])
        total = score[:, i] + more[:, j]
        top = np.argsort(-total, axis=1, kind="stable")[:, :count]
        score = np.take_along_axis(total, top, axis=1)
        keys = keys[np.arange(len(keys))[:, None], i[top]] * codes + order[np.arange(len(keys))[:, None], j[top]]
    return keys


def place_of(parts: list[np.ndarray], code: list[int]) -> int:
    """How many keys of one query have a larger sum than the key ``code``."""
    goal = sum(p[c] for p, c in zip(parts, code))
    sums = np.zeros(1)
    for p in parts[:-1]:
        sums = (sums[:, None] + p[None, :]).ravel()
    last = np.sort(parts[-1])
    return int((len(last) - np.searchsorted(last, goal - sums + 1e-12, "right")).sum())


def probes(rows: DataFrame, tables: int, hashes: dict[int, int], counts: dict[int, int]) -> DataFrame:
    """Per query, table and first part of a probed key: the last hashes to look at, as ``codes`` (uint32)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, whole in frame.groupby("dim"):
                for low in range(0, len(whole), 64):
                    part, out = whole.iloc[low:low + 64], []
                    unit = _unit(part["packed"].tolist(), dim)
                    for t in range(tables):
                        best = best_keys([rotated(unit, t, h) for h in range(hashes[dim])], counts[dim])
                        for i, (vec_id, packed) in enumerate(zip(part["id"], part["packed"])):
                            first, last = best[i] // codes_of(dim), best[i] % codes_of(dim)
                            order = np.argsort(first, kind="stable")
                            for mine in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
                                out.append((dim, t, int(first[mine[0]]), vec_id, packed, last[mine].astype("<u4").tobytes()))
                    yield pd.DataFrame(out, columns=["dim", "tab", "c1", "id", "packed", "codes"])

    return rows.mapInPandas(run, "dim int, tab int, c1 long, id long, packed binary, codes binary")


def fit_probes(index: DataFrame, hashes: dict[int, int], tables: int, nearest: int, recall: float, sample: int, rows: int, queries: int) -> dict[int, int]:
    """Probes per table and vector length with which the sample finds the share ``recall`` of its true neighbours.

    ``sample`` rows of each length, by a hash of the id, are compared with all rows. A neighbour is found from the probe on that
    comes first, over all tables, to its key; the share's quantile of these is the answer.
    """
    order = Window.partitionBy("dim").orderBy(F.xxhash64("id", F.lit(SEED)), "id")
    drawn = durable(index.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).drop("n"))
    found = _ranked(_against_all(index, drawn, nearest, rows, queries), nearest)
    pairs = found.join(drawn.select(F.col("id").alias("query_id"), "dim", F.col("packed").alias("q")), "query_id").join(
        index.select(F.col("id").alias("vec_id"), F.col("packed").alias("x")), "vec_id").select("dim", "q", "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, whole in frame.groupby("dim"):
                for low in range(0, len(whole), 64):
                    part = whole.iloc[low:low + 64]
                    q, x, least = _unit(part["q"].tolist(), dim), _unit(part["x"].tolist(), dim), np.full(len(part), np.iinfo(np.int64).max)
                    for t in range(tables):
                        turned = [rotated(q, t, h) for h in range(hashes[dim])]
                        code = [rotated(x, t, h).argmax(axis=1) for h in range(hashes[dim])]
                        least = np.minimum(least, [place_of([p[i] for p in turned], [c[i] for c in code]) for i in range(len(part))])
                    yield pd.DataFrame({"dim": dim, "place": least})

    # At most ``sample`` times ``nearest`` numbers of each vector length.
    places = pairs.mapInPandas(run, "dim int, place long").groupBy("dim").agg(F.sort_array(F.collect_list("place")).alias("places")).collect()
    out = dict.fromkeys(hashes, 1)
    for r in places:
        out[r["dim"]] = r["places"][min(math.ceil(recall * len(r["places"])), len(r["places"])) - 1] + 1
    return out


def _against_all(index: DataFrame, asked: DataFrame, nearest: int, rows: int, queries: int) -> DataFrame:
    whole = [F.lit(0).alias("tab"), F.lit(0).cast("bigint").alias("c1")]
    sizes = index.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("dim").agg(F.count(F.lit(1)).alias("m")), "dim").select("dim", *whole, "n", "m")
    return _in_blocks(index.select("dim", *whole, F.lit(0).alias("c2"), "id", "packed"),
                      asked.select("dim", *whole, "id", "packed", F.lit(b"").alias("codes")), sizes, nearest, rows, queries)


def _best(group: pd.DataFrame, nearest: int) -> pd.DataFrame:
    """Each query's nearest rows of a block among those with a probed second half (no list: among all)."""
    dim = int(group["dim"].iloc[0])
    asked = group["codes"].notna().to_numpy()
    queries, rows = group[asked], group[~asked].sort_values("id")
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if not len(rows) or not len(queries):
        return empty
    unpack = lambda packed: _doubles(packed.tolist(), dim)
    x, ids, second = unpack(rows["packed"]), rows["id"].to_numpy(), rows["c2"].to_numpy()
    found = [_nearest_of(queries.iloc[low:low + CHUNK], unpack(queries["packed"].iloc[low:low + CHUNK]), x, ids, second, nearest)
             for low in range(0, len(queries), CHUNK)]
    return pd.concat([empty, *found]) if len(found) > 1 else found[0]


def _nearest_of(queries: pd.DataFrame, q: np.ndarray, x: np.ndarray, ids: np.ndarray, second: np.ndarray, nearest: int) -> pd.DataFrame:
    """Squared lengths and products bound each distance up to rounding; what the bound leaves open is measured exactly."""
    query_ids = queries["id"].to_numpy()
    codes = [np.frombuffer(c, dtype="<u4") for c in queries["codes"]]
    sizes = np.array([len(c) for c in codes])
    allowed = np.zeros((len(q), max(int(second.max()), *(int(c.max()) for c in codes if len(c)), 0) + 1), dtype=bool)
    allowed[sizes == 0] = True
    allowed[np.repeat(np.arange(len(q)), sizes), np.concatenate(codes)] = True
    near = allowed[:, second] & (ids[None, :] != query_ids[:, None])
    with np.errstate(all="ignore"):
        qq, xx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
        rough = np.where(near, qq[:, None] + xx[None, :] - 2 * (q @ x.T), np.inf)
        slack = 1e-9 * (qq + xx.max())
        last = min(nearest, len(ids)) - 1
        # Where numbers overflow the bound is no number and rules nothing out.
        at, of = np.nonzero(near & ~(rough > (np.partition(rough, last, axis=1)[:, last] + slack)[:, None]))
        score = np.empty(len(at))
        for low in range(0, len(at), PAIRS):
            gap = x[of[low:low + PAIRS]] - q[at[low:low + PAIRS]]
            score[low:low + PAIRS] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    order = np.lexsort((ids[of], score, at))
    at, of, score = at[order], of[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < nearest
    return pd.DataFrame({"query_id": query_ids[at[keep]], "vec_id": ids[of[keep]], "score": score[keep]})


def _in_blocks(index: DataFrame, asked: DataFrame, sizes: DataFrame, nearest: int, rows: int, queries: int) -> DataFrame:
    """Top rows of each query in each block. ``sizes`` has the index rows ``n`` and the queries ``m`` of (dim, tab, c1)."""
    key = ["dim", "tab", "c1"]
    parts = broadcast_measured(sizes.select(*key, F.ceil(F.col("n") / rows).cast("int").alias("rb"), F.ceil(F.col("m") / queries).cast("int").alias("qb")))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(parts, key).select(*key, salt("rb").alias("r"), every("qb").alias("q"), "id", "packed", "c2", F.lit(None).cast("binary").alias("codes"))
    right = asked.join(parts, key).select(*key, every("rb").alias("r"), salt("qb").alias("q"), "id", "packed", F.lit(-1).alias("c2"), "codes")
    return left.unionByName(right).groupBy(*key, "r", "q").applyInPandas(lambda g: _best(g, nearest), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, tables: int = TABLES,
           recall: float = RECALL, sample: int = SAMPLE, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query row the ``nearest`` other rows found, by Euclidean distance.

    ``is_query`` is a condition on ``id``. Vectors only meet others of their length. Of equal vectors those beyond the
    ``nearest + 1`` smallest ids cannot be among any query's nearest and stay out of the index. The probes are fitted to ``recall``
    on ``sample`` rows of each length (``fit_probes``). A query for which they find too few rows is compared with all rows, in
    blocks. An id that repeats is one id with one of its vectors (``usable``); no rows give no rows.
    """
    base = durable(usable(vectors, key, vector))
    same = Window.partitionBy("dim", "packed").orderBy("id")
    index = durable(base.withColumn("k", F.row_number().over(same)).where(F.col("k") <= nearest + 1).drop("k"))
    asked = base.where(is_query)
    # One line per vector length.
    hashes = {r["dim"]: hashes_for(r["n"], r["dim"]) for r in index.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = fit_probes(index, hashes, tables, nearest, recall, sample, rows, queries)
    hashed, probed = keyed(index, tables, hashes), durable(probes(asked, tables, hashes, counts))
    group = ["dim", "tab", "c1"]
    sizes = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(probed.groupBy(*group).agg(F.count(F.lit(1)).alias("m")), group)
    first = durable(_ranked(_in_blocks(hashed, probed, sizes, nearest, rows, queries), nearest))
    enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("got")).where(F.col("got") >= nearest)
    short = durable(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti").select("dim", "id", "packed"))
    if not short.limit(1).count():
        return first.select("query_id", "rank", "vec_id", "score")
    again = _ranked(_against_all(index, short, nearest, rows, queries), nearest)
    return first.join(short.select("id"), F.col("query_id") == F.col("id"), "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(
        again.select("query_id", "rank", "vec_id", "score"))


@query("op1_neighbours")
def op1_neighbours(spark, folder):
    """The ten nearest rows of every hundredth id."""
    return search(read(spark, folder, "embeddings"), F.col("id") % 100 == 0)
