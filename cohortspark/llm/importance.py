"""Target-distribution importance resampling over hashed word n-grams.

A text's features are its runs of one and two words, each hashed by CRC-32 into one of ``BUCKETS``. A bucket's gain is the
log ratio of its share in the target texts to its share in the corpus. Texts are drawn without replacement with
probabilities that follow their mean gain, by adding Gumbel noise from a hash of the id and keeping the highest sums.

Hashing goes over many features at once: the distinct features of a batch are grouped by their length in bytes, each group
is a matrix of bytes, and one step per column updates the checksums of all its rows; then every occurrence looks up the
checksum of its feature. Memory follows the batch's bytes, and steps follow the lengths, not the number of features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import byte_runs, unwrapped, wrapped
from cohortspark.llm.registry import query, read
from cohortspark.operators.ranks import ranked
from cohortspark.session import durable

BUCKETS = 10_000
SCALE = 1000
SHARE = 25
LEAST_WORDS = 20
SEED = "7:"
SLICE = 4 << 20
CELLS = 1 << 21
PIECE = 256


def _table() -> np.ndarray:
    """The checksum's 256 steps for one byte, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _table()


def _past(length: int) -> np.ndarray:
    """Registers after ``length`` zero bytes, for each value of each of a register's four bytes (a linear map)."""
    reg = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(length):
        reg = TABLE[reg & 0xFF] ^ (reg >> 8)
    return reg


def _registers(data: np.ndarray, starts: np.ndarray, length: int, first: int) -> np.ndarray:
    """Registers of the byte strings of one length that begin at ``starts``, column by column over a matrix of bytes."""
    out = np.empty(len(starts), np.uint32)
    step = max(CELLS // max(length, 1), 1)
    for low in range(0, len(starts), step):
        matrix = data[np.arange(length)[:, None] + starts[None, low:low + step]]
        reg = np.full(matrix.shape[1], first, np.uint32)
        for column in matrix:
            reg = TABLE[(reg ^ column) & 0xFF] ^ (reg >> 8)
        out[low:low + step] = reg
    return out


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data`` (uint8), as uint32.

    A slice longer than ``PIECE`` bytes enters the matrix as rows of that length, whose registers are then folded.
    """
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    past = None
    for rows in np.split(order, cuts) if len(order) else []:
        length, at = int(lengths[rows[0]]), starts[rows]
        pieces, head = divmod(length, PIECE)
        if length <= PIECE:
            pieces, head = 0, length
        reg = _registers(data, at, head, 0xFFFFFFFF)
        if pieces:
            past = _past(PIECE) if past is None else past
            each = _registers(data, (at[:, None] + head + PIECE * np.arange(pieces)).ravel(), PIECE, 0).reshape(len(rows), pieces)
            for column in each.T:
                reg = past[0][reg & 0xFF] ^ past[1][(reg >> 8) & 0xFF] ^ past[2][(reg >> 16) & 0xFF] ^ past[3][reg >> 24] ^ column
        out[rows] = ~reg
    return out


# Bytes of words: letters and digits of ASCII, and every byte of other characters; A-Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[ord("0"):ord("9") + 1] = IN_WORD[ord("a"):ord("z") + 1] = IN_WORD[ord("A"):ord("Z") + 1] = IN_WORD[128:] = True


def _first_of(codes: np.ndarray, size: int) -> np.ndarray:
    first = np.empty(size, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, bucket, words)``: document and bucket of every feature, and every document's number of words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(edges[-1] - edges[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0]:edges[-1]] if size else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside = IN_WORD[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    border = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < size)]
    starts[border] |= inside[border]
    ends[border - 1] |= inside[border - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(edges, starts, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    # All words, one blank after each: word i is at[i]:to[i], and at[i]:to[i + 1] is the pair it begins.
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - 1
    at = to - lengths
    letters = LOWER[raw[inside]]
    line = np.full(int(to[-1]) + 1, 32, np.uint8)
    line[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), lengths)] = letters
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(letters)]).dictionary_encode()
    word, n_words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    left = np.flatnonzero(doc[1:] == doc[:-1])
    pair, pairs = pd.factorize(word[left] * n_words + word[left + 1])
    one, two = _first_of(word, n_words), left[_first_of(pair, len(pairs))]
    crc = checksums(line, np.concatenate([at[one], at[two]]), np.concatenate([to[one] - at[one], to[two + 1] - at[two]])).astype(np.int64) % buckets
    return np.concatenate([doc, doc[left]]), np.concatenate([crc[word], crc[n_words + pair]]), words


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often all features of all texts fall into each bucket that occurs.

    Every task adds up its own texts first, so at most ``buckets`` rows of each are shuffled. No texts give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in byte_runs(b.column(0), SLICE):
                total += np.bincount(features(part, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, scale: int = SCALE) -> list[int]:
    """Each bucket's gain, floor(scale * ln of the ratio of shares), both counts with one added. ``buckets`` numbers."""
    both = bucket_counts(corpus, text, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, text, buckets).withColumn("side", F.lit(1)))
    n = np.zeros((2, buckets))
    # Two rows a bucket at most.
    for r in both.collect():
        n[r["side"], r["bucket"]] = r["n"]
    s, t = n.sum(axis=1)
    return [math.floor(scale * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in n.T.tolist()]


def weigh(docs: DataFrame, gain: list[int], text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the floored mean gain of the text's features (none: 0).

    Input columns of these names give way. A null text has no words; each row is judged by itself.
    """
    buckets, values = len(gain), np.array(gain, np.int64)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in byte_runs(texts, SLICE):
            doc, bucket, words = features(part, buckets)
            n = np.bincount(doc, minlength=len(part))
            # Sums of whole numbers far below 2 ** 53 are exact in doubles.
            total = np.bincount(doc, weights=values[bucket], minlength=len(part)).astype(np.int64)
            out.append((words, n, total // np.maximum(n, 1)))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["n_words", "n_features", "weight"])

    judge = F.arrow_udf(run, "n_words long, n_features long, weight long")
    rows = wrapped(docs, w=judge(F.col(text).cast("string")))
    return unwrapped(rows, docs.columns, **{c: F.col(f"w.{c}") for c in ("n_words", "n_features", "weight")})


def noise(key: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """floor(scale * Gumbel noise) from the first 32 bits of a SHA-256 of the seed and the key (null: the word null)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def drawn(weighed: DataFrame, key: str = "doc_id", share: int = SHARE, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Adds ``score`` and ``rank`` to weighed rows: of the rows with ``least`` words or more, the highest ``share`` per cent
    by score have ranks from 1, the others null.

    Ties go to the smaller key, null last. Rows that repeat a key share its noise; those that tie in everything take
    neighbouring ranks in some order. Ranks come from ranges of the score, so no task holds them all. No rows give no rows.
    """
    columns = [c for c in weighed.columns if c not in ("score", "rank")]
    rows = durable(wrapped(weighed, key=F.col(key), w=F.col("weight"), n=F.col("n_features"), fit=F.col("n_words") >= least,
                           score=F.col("weight") + noise(F.col(key), seed)))
    wanted = rows.where("fit").count() * share // 100
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("n"), F.col("at")]
    placed = ranked(rows.where("fit").withColumn("at", F.monotonically_increasing_id()), [], order, "place")
    out = placed.select("row", "score", F.when(F.col("place") <= wanted, F.col("place")).alias("rank"))
    rest = rows.where("NOT fit").select("row", "score", F.lit(None).cast("bigint").alias("rank"))
    return unwrapped(out.unionByName(rest), columns, score="score", rank="rank")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs`` (doc_id, text and others), columns unchanged, chosen towards the texts of ``target``."""
    gain = gains(docs, target)
    held = docs.select(F.struct("*").alias("held"), "doc_id", "text")
    return drawn(weigh(held, gain).drop("text"), "doc_id", share, least, seed).where("rank IS NOT NULL").select("held.*")


# The checksum byte by byte over a table made by rule, for each different feature.
IMPORTANCE_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
f AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
c AS (SELECT kind, id, f, count(*) AS n FROM f GROUP BY kind, id, f),
h AS (SELECT f, xor(list_reduce(list_transform(range(CAST(length(hex(f)) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT)),
        lambda r, b: xor(tab.t[CAST(xor(r, b) & 255 AS INTEGER) + 1], r >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 10000 AS b
      FROM (SELECT DISTINCT f FROM f), tab),
k AS (SELECT b, sum(CASE WHEN kind = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN kind = 'b' THEN n ELSE 0 END) AS t FROM c JOIN h USING (f) GROUP BY b),
z AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM k),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(k.t AS DOUBLE) + 1) * (z.s + 10000) / ((CAST(k.s AS DOUBLE) + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM k, z),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM c JOIN h USING (f) JOIN g USING (b) WHERE kind = 'd' GROUP BY id),
d AS (SELECT w.id AS doc_id, len(w.w) >= 20 AS fit, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight,
      coalesce(m.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN m ON m.id = w.id WHERE w.kind = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM d WHERE fit)
SELECT d.doc_id, n_features, weight, score, CASE WHEN r.rank <= 25 * r.n // 100 THEN r.rank END AS rank FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


@query("op13_importance", IMPORTANCE_SQL)
def op13_importance(spark, folder):
    """Gains of the benchmark over all documents, then every document's weight, score and rank."""
    docs, target = read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark")
    found = drawn(weigh(docs, gains(docs, target)).drop("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
