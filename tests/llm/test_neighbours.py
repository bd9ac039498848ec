import math

import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm.neighbours import best_keys, codes_of, fit_probes, hadamard, hashes_for, place_of, search, usable


def exact(rows, query, n=10):
    found = sorted((math.dist(query[1], v), i) for i, v in rows if i != query[0] and len(v) == len(query[1]))
    return [i for _, i in found[:n]], [d for d, _ in found[:n]]


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(hadamard(hadamard(x)), x)


def test_probes_are_the_best_keys():
    rng = np.random.default_rng(5)
    for hashes, count in ((1, 5), (2, 1), (2, 40), (3, 100), (2, 10_000)):
        parts = [rng.normal(size=(4, 16)) for _ in range(hashes)]
        sums = parts[0]
        for p in parts[1:]:
            sums = (sums[:, :, None] + p[:, None, :]).reshape(4, -1)
        want, got = np.argsort(-sums, axis=1)[:, :count], best_keys(parts, count)
        assert np.array_equal(got, want)
        for q in range(4):
            for place in {0, want.shape[1] // 2, want.shape[1] - 1}:
                key, code = int(want[q, place]), []
                for _ in range(hashes):
                    key, c = divmod(key, 16)
                    code.insert(0, c)
                assert place_of([p[q] for p in parts], code) == place


def measured(spark, rows):
    """Recall of the search over rows of (id, vector), and the share of a table's keys that is probed."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    hits = wanted = 0
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        d[at] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = [got[ids[at]][k] for k in sorted(got[ids[at]])]
        assert len(mine) == 10 and mine == sorted(mine, key=lambda m: (m[1], m[0]))
        place = {int(i): k for k, i in enumerate(ids)}
        assert all(abs(d[place[i]] - s) < 1e-12 for i, s in mine)
        hits, wanted = hits + len(set(ids[best].tolist()) & {i for i, _ in mine}), wanted + 10
    index = usable(df).cache()
    hashes = {64: hashes_for(len(rows), 64)}
    return hits / wanted, fit_probes(index, hashes, 4, 10, 0.98, 256, 8192, 2048)[64] / codes_of(64) ** hashes[64]


def test_recall_at_every_size(spark):
    shares = []
    for sf in ("0.001", "0.01", "0.1"):
        rows = [(int(r["vec_id"]), [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
        recall, share = measured(spark, rows)
        assert recall >= 0.95
        shares.append(share)
    made = np.random.default_rng(11).normal(size=(50_000, 64)).astype(np.float32)
    recall, share = measured(spark, [(7 * i, v.tolist()) for i, v in enumerate(made)])
    assert recall >= 0.95 and share < shares[2] < max(shares[:2])


def test_small_and_odd_tables(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100, [0.0, 2.0, 0.0]), (200, [1.0, 1.0, 1.0]), (300, [1.0, 2.0])]
    bad = [(400, None), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 0.0]), (700, [float("nan"), 1.0, 0.0]), (800, [float("inf"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (900, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad + rows[:2]], "vec_id long, embedding array<float>, id string, dim int")
    got = {}
    for r in search(df, F.col("id") % 100 == 0, rows=7, queries=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 100, 200}
    for q in (0, 100, 200):
        ids, _ = exact(rows, (q, dict(rows)[q]))
        assert [v for _, v in sorted(got[q])] == ids
    assert search(df.limit(0), F.col("id") % 100 == 0).collect() == []
    assert len(search(df.where("vec_id IN (0, 100)"), F.col("id") % 100 == 0).collect()) == 2


def test_one_vector_per_id(spark):
    rows = [(i, [float(i % 9), 1.0, float(i % 5)]) for i in range(1, 60)] + [(100, [5.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (7, [0.5, 0.5, 0.5])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 100).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11)) and len({r["vec_id"] for r in got}) == 10
    kept = {**dict(reversed(rows)), 100: [1.0, 1.0, 1.0], 7: [0.5, 0.5, 0.5]}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == exact(list(kept.items()), (100, kept[100]))[0]
