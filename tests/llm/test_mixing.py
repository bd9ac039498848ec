import hashlib
import math

import pytest

from cohortspark.llm.mixing import mix, plan_mix, rates


def shared(sizes, weights=(5, 2, 1), ceiling=3):
    """Targets by the stated rule: share by weight, cut at the ceiling, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = set(), dict.fromkeys(order, 0.0)
    while True:
        rest = sum(sizes.values()) - sum(ceiling * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        left = {s: float(ceiling * sizes[s]) if s in full else rest * weight[s] / total for s in order}
        above = {s for s in open_ if left[s] > ceiling * sizes[s]}
        if not above:
            return left
        full |= above


def draw(name, seed="mix-1:"):
    return int(hashlib.md5(f"{seed}{'null' if name is None else name}".encode()).hexdigest()[:13], 16) / 16 ** 13


def plain_copies(rows, rate, seed="mix-1:"):
    """Per source: documents by size, then hash; every multiple from the start on that falls in a place is a copy."""
    out = []
    for s in rate:
        mine = sorted(((len((t or "").split()), draw(i, seed), str(i)) for i, t, x in rows if x == s), key=lambda x: x[:2])
        part, whole, at = rate[s] - math.floor(rate[s]), math.floor(rate[s]), 0
        for size in sorted({m[0] for m in mine}):
            group = [m for m in mine if m[0] == size]
            extra = math.floor(draw(s, seed) + (at + len(group)) * part) - math.floor(draw(s, seed) + at * part)
            cut = group[extra - 1][1] if extra else -1.0
            out += [(name, str(s), size, whole + (u <= cut)) for _, u, name in group]
            at += len(group)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 10, None: 5}, {"b": 7}, {"é": 3, "z": 50, "Z": 1, "𝄞": 4, "": 9}, {"a": 0, "b": 0}, {"a": 100, "b": 0, None: 1}])
def test_targets_equal_the_stated_rule(documents, sizes):
    docs = documents([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = {r["source"]: r["target"] for r in rates(docs).collect()}
    want = shared(sizes)
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-12), s


def test_plan_and_mix(documents):
    long = "word " * 20000
    rows = [(i, " ".join(["x"] * (i % 7)), "big") for i in range(400)] + [(1000 + i, "rare words here", "rare") for i in range(20)]
    rows += [(2000, None, "big"), (2001, "\t \n", None), (2002, long, "long"), (None, "a b", "rare"), (1001, "rare words here", "rare")]
    docs = documents(rows)
    planned = plan_mix(docs).collect()
    assert len(planned) == len(rows)
    size = lambda t: len((t or "").split())
    size = lambda t: len((t or "").split())
    for r in planned:
        assert r["_size"] == size(r["text"]) and r["_copies"] <= 3
    got = sorted((str(r["doc_id"]), str(r["source"]), r["_size"], r["_copies"]) for r in planned)
    assert got == sorted(plain_copies(rows, {r["source"]: min(r["_target"] / r["_source_size"], 3.0) if r["_source_size"] else 0.0 for r in planned}))
    mixed = mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["_copies"] for r in planned)
    assert {r["_size"] for r in mixed.collect()} == {"x"}
    assert mix(docs.limit(0)).count() == 0


def taken_and_targets(docs):
    taken, target, most, n = {}, {}, {}, {}
    for r in plan_mix(docs).select("source", "_size", "_copies", "_target").collect():
        s = r["source"]
        taken[s], n[s] = taken.get(s, 0) + r["_size"] * r["_copies"], n.get(s, 0) + 1
        most[s], target[s] = max(most.get(s, 0), r["_size"]), r["_target"]
    return {s: (taken[s], target[s], most[s], n[s]) for s in taken}


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_taken_words_end_within_one_document_of_the_target(spark, sf):
    for taken, target, most, _ in taken_and_targets(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).values():
        assert abs(taken - target) <= most


def test_large_sources_end_within_one_per_cent(documents):
    for taken, target, _, n in taken_and_targets(documents([(i, "w " * (1 + i * i % 97), "abc"[i % 3]) for i in range(3000)])).values():
        assert n >= 500 and taken == pytest.approx(target, rel=0.01)


def test_each_document_is_drawn_as_often_as_the_fraction_says():
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(60)]
    rate, runs = {"a": 1.7, "b": 0.3}, 400
    drawn = dict.fromkeys(range(60), 0)
    for k in range(runs):
        for name, _, _, copies in plain_copies(rows, rate, f"s{k}:"):
            drawn[int(name)] += copies
    for i, n in drawn.items():
        # Five standard errors.
        assert abs(n / runs - rate["ab"[i % 2]]) <= 5 * (0.21 / runs) ** 0.5
