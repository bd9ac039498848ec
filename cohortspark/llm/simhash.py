"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie joined with itself.

Documents of one fingerprint are one entry from the start. Fingerprints form a binary trie. Node pairs go down it
together, their differing bits add up, and a pair ends once it passes the budget. The upper part, cut where a node holds
no more than ``LEAF`` fingerprints however unevenly they lie, is walked by joins of node tables; pairs of such leaves are
then walked in tasks of bounded size, which keep a spanning star per component instead of all links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import components, no_null, null_safe, unwrapped, wrapped
from cohortspark.llm.registry import query, read
from cohortspark.session import durable

WIDTH = 3
BUDGET = 2
SEED = 42
STEP = 4
LEAF = 16384
CHUNK = 1 << 15
PIECE = 1 << 18


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is set when more than half the shingles' XXH64 values (repeats included) have it set; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(len(words) - width + 1, 1)
    digest, ones, half = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), count / 2
    for low in range(0, count, PIECE):
        part = (digest(b" ".join(words[i:i + width]), SEED) for i in range(low, min(low + PIECE, count)))
        ones += _bit_counts(np.fromiter(part, dtype=np.uint64))
    return int.from_bytes(np.packbits(ones[::-1] > half).tobytes(), "big")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many values have each bit set: eight byte lanes are added at once, in runs of 255 so that none overflows."""
    starts = np.arange(0, len(hashes), 255)
    lanes, out = np.uint64(0x0101010101010101), np.zeros(64, dtype=np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        out[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def _digest(text: Column) -> Column:
    return F.sha2(no_null(text.cast("string")), 256)


def fingerprints(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """``doc_id, fp`` (bigint, the fingerprint's 64 bits) for each row, from its whole text; if asked for, its ``digest``."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            more = [b.column(i) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *more], ["doc_id", "fp", "digest"][:2 + len(more)])

    more = [_digest(F.col("text")).alias("digest")] if digest else []
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(
        run, "doc_id bigint, fp bigint" + ", digest string" * digest)


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of linked positions: each pass hooks larger roots under smaller ones, then shortens all paths."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := parent[parent], parent):
            parent = shorter
    return parent


def _close(left: np.ndarray, right: np.ndarray, same: bool, budget: int):
    """Yields positions (i, j) of sorted fingerprints within the budget, walking both tries' node pairs bit by bit."""
    one = lambda v: np.array([v])
    stack = [(0, one(0), one(len(left)), one(0), one(len(right)), one(0))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > CHUNK:
            for part in np.array_split(np.arange(len(al)), 2):
                stack.append((bit, al[part], ah[part], bl[part], bh[part], err[part]))
            continue
        size = (ah - al) * (bh - bl)
        few = (size <= 32) | (bit == 64)
        if few.any():
            n, wide = size[few], (bh - bl)[few]
            node = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
            i, j = al[few][node] + at // wide[node], bl[few][node] + at % wide[node]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
        deep = ~few
        if not deep.any():
            continue
        al, ah, bl, bh, err = al[deep], ah[deep], bl[deep], bh[deep], err[deep]
        am, bm = _middle(left, al, ah, bit), _middle(right, bl, bh, bit)
        twin = (al == bl) & (ah == bh) if same else np.zeros(len(al), dtype=bool)
        kids = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1),
                (am[~twin], ah[~twin], bl[~twin], bm[~twin], err[~twin] + 1)]
        kids = [np.concatenate(x) for x in zip(*kids, strict=True)]
        live = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)
        stack.append((bit + 1, *[x[live] for x in kids]))


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """First position in [low, high) whose value has ``bit`` (from the top) set; all values there share the bits above."""
    keep = np.uint64(0 if bit == 0 else (2 ** 64 - 2 ** (64 - bit)))
    return np.clip(np.searchsorted(values, (values[low] & keep) | np.uint64(2 ** (63 - bit))), low, high)


def local_stars(left: np.ndarray, right: np.ndarray, same: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for every fingerprint linked within the two leaves to one other than itself."""
    both = left if same else np.concatenate([left, right])
    shift, parent = 0 if same else len(left), np.arange(len(both))
    for i, j in _close(left, right, same, budget):
        parent = _merge(parent, i, j + shift)
    member = np.flatnonzero(parent != np.arange(len(both)))
    return both[member], both[parent[member]]


def _prefix(depth: int):
    return F.lit(0).cast("bigint") if depth == 0 else F.shiftrightunsigned("fp", 64 - depth)


def trie_links(fps: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Links (``a``, ``b``) that connect distinct fingerprints (``fp``) exactly as all pairs within the budget would.

    A trie level takes ``STEP`` bits. Nodes with more than ``leaf`` fingerprints are split at the next level, so dense
    regions go deeper; at 64 bits a node holds one. The driver sees only how many nodes are left to split.
    """
    spark = fps.sparkSession
    rest, leaves, pairs, kids = fps.select("fp"), [], None, None
    done_pairs, depth = [], 0
    while True:
        nodes = durable(rest.groupBy(_prefix(depth).alias("p")).agg(F.count(F.lit(1)).alias("n")))
        placed = rest.withColumn("p", _prefix(depth))
        # The node pairs of this level, each with the bits in which they differ. A leaf met earlier stays as it is.
        if depth == 0:
            pairs = nodes.select(F.lit(0).alias("da"), F.col("p").alias("a"), F.lit(0).alias("db"), F.col("p").alias("b"), F.lit(0).alias("err"))
        else:
            pairs = _descend(pairs, nodes, depth, budget)
        marks = nodes.select(F.col("p").alias("q"), (F.col("n") > leaf).alias("open"))
        side = lambda d, p: marks.select(F.lit(depth).alias(f"{d}_"), F.col("q").alias(f"{p}_"), F.col("open").alias(f"{p}_open"))
        pairs = pairs.join(side("da", "a"), (F.col("da") == F.col("da_")) & (F.col("a") == F.col("a_")), "left") \
            .join(side("db", "b"), (F.col("db") == F.col("db_")) & (F.col("b") == F.col("b_")), "left") \
            .select("da", "a", "db", "b", "err", F.coalesce("a_open", F.lit(False)).alias("a_open"), F.coalesce("b_open", F.lit(False)).alias("b_open"))
        pairs = durable(pairs)
        done_pairs.append(pairs.where("NOT a_open AND NOT b_open"))
        pairs = pairs.where("a_open OR b_open")
        closed = placed.join(marks.where("NOT open"), F.col("p") == F.col("q"), "left_semi")
        leaves.append(closed.select("fp", F.lit(depth).alias("d"), "p"))
        wide = marks.where("open")
        if not wide.limit(1).count():
            break
        rest = durable(placed.join(wide, F.col("p") == F.col("q"), "left_semi").select("fp"))
        depth += STEP
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    held, found = union(leaves), union(done_pairs).select("da", "a", "db", "b")
    key = F.xxhash64("da", "a", "db", "b")
    as_a = held.join(found, (F.col("d") == F.col("da")) & (F.col("p") == F.col("a"))).select(
        "da", "a", "db", "b", F.when((F.col("da") == F.col("db")) & (F.col("a") == F.col("b")), 2).otherwise(0).alias("side"), "fp")
    as_b = held.join(found.where("da != db OR a != b"), (F.col("d") == F.col("db")) & (F.col("p") == F.col("b"))).select(
        "da", "a", "db", "b", F.lit(1).alias("side"), "fp")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        side = group["side"].to_numpy()
        same = bool((side == 2).all())
        left = np.sort(fp[side != 1])
        right = left if same else np.sort(fp[side == 1])
        member, root = local_stars(left, right, same, budget)
        return pd.DataFrame({"a": member.view(np.int64), "b": root.view(np.int64)})

    return as_a.unionByName(as_b).groupBy("da", "a", "db", "b").applyInPandas(run, "a bigint, b bigint")


def _descend(pairs: DataFrame, nodes: DataFrame, depth: int, budget: int) -> DataFrame:
    """Children of the open nodes of each pair, paired unless their new bits pass the budget."""
    up = F.shiftrightunsigned("p", STEP)
    low = F.col("p").bitwiseAND(2 ** STEP - 1)
    kids = lambda s: nodes.select(F.lit(depth - STEP).alias(f"{s}d"), up.alias(f"{s}up"), F.col("p").alias(f"{s}kid"), low.alias(f"{s}bits"))
    step = pairs.join(kids("x"), (F.col("da") == F.col("xd")) & (F.col("a") == F.col("xup")) & F.col("a_open"), "left")
    step = step.join(kids("y"), (F.col("db") == F.col("yd")) & (F.col("b") == F.col("yup")) & F.col("b_open"), "left")
    both = F.col("xkid").isNotNull() & F.col("ykid").isNotNull()
    err = F.col("err") + F.when(both, F.bit_count(F.col("xbits").bitwiseXOR(F.col("ybits")))).otherwise(0)
    mirrored = (F.col("da") == F.col("db")) & (F.col("a") == F.col("b")) & (F.col("xkid") > F.col("ykid"))
    return step.where(~F.coalesce(mirrored, F.lit(False)) & (err <= budget)).select(
        F.when(F.col("xkid").isNotNull(), depth).otherwise(F.col("da")).alias("da"), F.coalesce("xkid", "a").alias("a"),
        F.when(F.col("ykid").isNotNull(), depth).otherwise(F.col("db")).alias("db"), F.coalesce("ykid", "b").alias("b"), err.alias("err"))


def _rooted(prints: DataFrame, budget: int, leaf: int) -> DataFrame:
    """``fp, least, root`` for each fingerprint of ``prints``: its smallest doc_id and its component's node."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(trie_links(durable(nodes.select("fp")), budget, leaf), "a", "b")
    return durable(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: fingerprints at ``budget`` or fewer differing bits are linked.

    ``component_id`` is the smallest doc_id reachable, the row's own included (null when only null ids are). Rows without
    words have fingerprint 0 and link like any other. A row repeated comes out repeated; no rows give no rows.
    """
    prints = durable(fingerprints(docs, width))
    rooted = _rooted(prints, budget, leaf)
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` per group of near-duplicates: the one of smallest doc_id, null last, then of least text hash.

    A row is told by its doc_id and a hash of its text, so rows that share an id (null included) but not a group all stay.
    """
    prints = durable(fingerprints(docs, width, digest=True))
    rooted = _rooted(prints, budget, LEAF).select(F.col("fp").alias("_fp"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    heads = prints.join(rooted, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min(order).alias("h"))
    heads = heads.select(F.col("h.doc_id").alias("_id"), F.col("h.digest").alias("_digest"))
    rows = wrapped(docs, _id=F.col("doc_id").cast("bigint"), _digest=_digest(F.col("text")))
    kept = null_safe(rows, heads, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"])
    return unwrapped(kept, docs.columns)


@query("op3_simhash")
def op3_simhash(spark, folder):
    found = near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
