import random

import numpy as np
import xxhash

from cohortspark.llm.simhash import fingerprint, keep_one, local_stars, near_duplicates, trie_links
from cohortspark.llm.common import components


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, budget=2):
    """Least index per component of values linked at the budget, by all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one TWO", "ÄB Ç d e\x0bf", "a b c"] + [
        " ".join(rng.choice("ab cd ef gh Ij kl".split()) for _ in range(n)) for n in (3, 4, 50, 256, 257, 700)]
    assert [fingerprint(t) for t in texts] == [plain(t) for t in texts]


def clustered(n, seed):
    rng = random.Random(seed)
    out = {0, 2 ** 64 - 1}
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


def test_local_walk_equals_all_pairs():
    values = clustered(400, 2)
    fps = np.array(values, dtype=np.uint64)
    member, root = local_stars(fps, fps, True, 2)
    want = groups(values)
    got = dict(zip(member.tolist(), root.tolist()))
    assert [got.get(v, v) for v in values] == [values[w] for w in want]


def test_distributed_trie_equals_all_pairs(spark):
    values = clustered(300, 3)
    signed = [v - 2 ** 64 if v >= 2 ** 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(trie_links(fps, leaf=5), "a", "b").collect()}
    want = groups(values)
    sets = lambda labels: sorted(sorted(k for k, x in zip(signed, labels) if x == label) for label in set(labels))
    assert sets([roots.get(v, v) for v in signed]) == sets(want)


def test_groups_and_edge_cases(spark, documents):
    long = " ".join(f"w{i % 97}x{i}" for i in range(20000))
    rows = [(5, "a b c d e f g h"), (3, "A b c d\te f g h"), (9, None), (8, ""), (7, " \n "), (10, long), (11, long), (12, "unlike anything else here"),
            (12, "unlike anything else here"), (None, "only a null id has this text"), (None, "a b c d e f g h")]
    docs = documents(rows)
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (10, 10), (11, 10), (12, 12), (None, None), (None, 3)}
    assert near_duplicates(docs).count() == len(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect())[1:] == [(True, 3), (True, 7), (True, 10), (True, 12)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_rows_sharing_an_id_are_told_by_text(spark, documents):
    rows = [(3, "a b c d e f g h"), (5, "A b c d e f g h"), (5, "unlike anything else here"), (None, "one text without any id"), (None, "quite another set of words"),
            (None, "quite another set of words"), (None, "a b c d\te f g h")]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in keep_one(documents(rows)).collect())
    assert kept == [(0, "one text without any id"), (0, "quite another set of words"), (3, "a b c d e f g h"), (5, "unlike anything else here")]
