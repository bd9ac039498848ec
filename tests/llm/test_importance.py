import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from cohortspark.llm.importance import PIECE, checksums, drawn, features, gains, resample, weigh

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " ", "One two TWO", "x", "é-é É 𝄞𝄞 1a", "\x00a\x7fb{c`d", "a " * 50, "b" * 5000 + " c", " ".join(f"w{i % 37} the" for i in range(30000))]


def runs(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def test_checksums_equal_the_library():
    data = np.random.default_rng(1).integers(0, 256, 40_000).astype(np.uint8)
    lengths = np.array([0, 1, 2, 2, 7, PIECE - 1, PIECE, PIECE + 1, 3 * PIECE, 3 * PIECE, 5 * PIECE + 9, 30_000] + [5] * 900)
    starts = np.random.default_rng(2).integers(0, 10_000, len(lengths))
    assert checksums(data, starts, lengths).tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]


def test_features_equal_plain_ones():
    for held in (TEXTS, TEXTS[::-1], [None], []):
        doc, got, words = features(pa.array(["skipped words", *held], pa.string()).slice(1))
        assert words.tolist() == [len(runs(t)[0]) for t in held]
        for i, t in enumerate(held):
            assert sorted(got[doc == i].tolist()) == sorted(bucket(f) for f in runs(t)[1])


def plain(rows, targets):
    counts = [{}, {}]
    for k, texts in enumerate(([t for _, t in rows], targets)):
        for t in texts:
            for f in runs(t)[1]:
                counts[k][bucket(f)] = counts[k].get(bucket(f), 0) + 1
    s, t = (sum(c.values()) for c in counts)
    gain = lambda b: math.floor(1000 * math.log((counts[1].get(b, 0) + 1) * (s + 10000) / ((counts[0].get(b, 0) + 1) * (t + 10000))))
    out = []
    for i, text in rows:
        words, found = runs(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, [x[0] for x in fit[:25 * len(fit) // 100]]


def test_draw_equals_brute_force(spark, documents):
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(f"t{(i * j) % 23}" for j in range(1, 19 + i % 4))) for i in range(60)]
    rows += [(None, "no id " * 30), (101, "again " * 30), (7, TEXTS[7]), (7, TEXTS[7])]
    docs, targets = documents(rows), ["t1 t2 t3 t4", "t5 t1", None]
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(targets)], "item_id long, text string, weight int")
    want, ids = plain(rows, targets)
    found = drawn(weigh(docs.withColumn("rank", docs.doc_id).withColumn("weight", docs.doc_id), gains(docs, target))).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found), key=key) == sorted((x[:4] for x in want), key=key)
    assert [r["doc_id"] for r in sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])] == ids
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(ids) + 1))
    kept = resample(docs, target)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, ids))


def test_empty_tables(documents):
    none = documents([])
    assert drawn(weigh(none, gains(none, none))).collect() == []
    some = documents([(1, "a b " * 20)])
    assert resample(some, none).collect() == []
