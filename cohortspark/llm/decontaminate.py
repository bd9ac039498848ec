"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are partitioned by their number of shingles. Within a partition of sizes up to u an item's sketch holds its
floor((1 - t) u) + 1 least shingle hashes (a bottom-k MinHash of the partition's own length): a document that contains a
share t of the item misses at most (1 - t) of its shingles, so it holds one of the sketch. Documents are far longer than
items and need no sketch of their own; each streams past the sketches and is compared only with the items it meets, and
only if it is long enough. Candidates are then verified on the shingles themselves.

An item shorter than a shingle is one shingle of its own length; documents make shingles of such lengths as well, where the
benchmark has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import broadcast_measured, no_null, null_safe, unwrapped, wrapped
from cohortspark.llm.registry import query, read
from cohortspark.session import durable

WIDTH = 5
# Sketches up to this size are broadcast; beyond it the documents' shingles are shuffled to them.
SKETCH_BYTES = 64 * 1024 * 1024
THRESHOLD = 0.8


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, so that blanks and punctuation between words don't matter."""
    return F.array_remove(F.split(F.lower(no_null(text)), r"[^\p{L}\p{N}]+"), "")


def _positions(items: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(items) - width, F.lit(0)))


def _hashes(tokens: str, width: int) -> Column:
    """A hash per shingle, from its words' hashes; without words none, with fewer than ``width`` one of all words."""
    at = lambda i, k: F.get(F.col(tokens), i + k)
    return F.when(F.size(tokens) > 0, F.transform(_positions(F.col(tokens), width), lambda i: F.xxhash64(*[at(i, k) for k in range(width)])))


def _runs(tokens: str, length: int, each) -> Column:
    """``each`` run of ``length`` words; shorter texts have none."""
    return F.when(F.size(tokens) >= length, F.transform(F.sequence(F.lit(0), F.size(tokens) - length), each)).otherwise(F.array())


def short_lengths(benchmark: DataFrame, width: int = WIDTH) -> list[int]:
    """Numbers of words below ``width`` that items have: at most ``width - 1`` numbers."""
    n = F.size(plain_words(F.col("text")))
    return sorted(r[0] for r in benchmark.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < width)).distinct().collect())


def _all_hashes(tokens: str, width: int, lengths: list[int]) -> Column:
    def of(n: int) -> Column:
        return _runs(tokens, n, lambda i: F.xxhash64(*[F.get(F.col(tokens), i + k) for k in range(n)])).cast("array<bigint>")

    return F.concat(_hashes(tokens, width), *map(of, lengths)) if lengths else _hashes(tokens, width)


def _all_shingles(tokens: str, width: int, lengths: list[int]) -> Column:
    def of(n: int) -> Column:
        return _runs(tokens, n, lambda i: F.array_join(F.slice(F.col(tokens), i + 1, F.lit(n)), " ")).cast("array<string>")

    return F.array_distinct(F.concat(_shingles(tokens, width), *map(of, lengths))) if lengths else _shingles(tokens, width)


def _shingles(tokens: str, width: int) -> Column:
    return F.when(F.size(tokens) > 0, F.array_distinct(F.transform(
        _positions(F.col(tokens), width), lambda i: F.array_join(F.slice(F.col(tokens), i + 1, F.lit(width)), " "))))


def _word_hashes(text: Column) -> Column:
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


def sketches(benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``item, hash, least``: each item's sketch and the least number of distinct shingles a document of it can have."""
    hashed = benchmark.select(F.col("item_id").alias("item"), _word_hashes(F.col("text")).alias("wh"))
    hashed = hashed.select("item", F.array_sort(F.array_distinct(_hashes("wh", width))).alias("hs")).where(F.size("hs") > 0)
    q = F.size("hs")
    upper = F.pow(F.lit(2), F.floor(F.log2(q)) + 1) - 1
    length = (F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int")
    return hashed.select("item", F.explode(F.slice("hs", F.lit(1), length)).alias("hash"), F.ceil(threshold * q - 1e-9).cast("int").alias("least"))


def candidates(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Distinct ``doc, item`` that share a sketch hash; none that reaches the threshold is missing."""
    table, lengths = broadcast_measured(sketches(benchmark, threshold, width), SKETCH_BYTES), short_lengths(benchmark, width)
    hashed = docs.select(F.col("doc_id").alias("doc"), _word_hashes(F.col("text")).alias("wh"))
    met = hashed.select("doc", F.size("wh").alias("n"), F.explode(_all_hashes("wh", width, lengths)).alias("h")).join(table, F.col("h") == F.col("hash"))
    return met.where(F.greatest(F.col("n") - width + 1, F.lit(1)) >= F.col("least")).select("doc", "item").distinct()


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment`` for each document that holds a share ``threshold`` or more
    of an item's distinct shingles.

    doc_id and item_id name documents and items: of rows that repeat one the highest containment counts, null is an id.
    Null and empty texts have no shingles and match nothing; an item shorter than ``width`` words matches wherever its words
    follow each other. Empty tables give no rows.
    """
    met = durable(candidates(docs, benchmark, threshold, width))
    # Stored candidates are few unless the corpus is full of items; then the texts are shuffled once to meet them.
    per_doc = met.groupBy("doc").agg(F.collect_set(F.struct("item")).alias("items"))
    suspects = null_safe(docs.select(F.col("doc_id").alias("doc"), "text"), broadcast_measured(per_doc), ["doc"])
    suspects = suspects.select("doc", "items", plain_words(F.col("text")).alias("ws")).select("doc", "items", _all_shingles("ws", width, short_lengths(benchmark, width)).alias("held"))
    wanted = benchmark.select(F.col("item_id").alias("item"), plain_words(F.col("text")).alias("ws")) \
        .select("item", _shingles("ws", width).alias("wanted")).where(F.size("wanted") > 0)
    pairs = suspects.select("doc", "held", F.explode("items").alias("i")).select("doc", "held", F.col("i.item").alias("item"))
    both = null_safe(pairs, broadcast_measured(wanted), ["item"]).select(
        "doc", "item", F.size("wanted").cast("bigint").alias("n_shingles"), F.size(F.array_intersect("wanted", "held")).cast("bigint").alias("n_found"))
    best = both.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold - 1e-12)
    top = best.groupBy("doc", "item").agg(F.max(F.struct("containment", "n_shingles", "n_found")).alias("b"))
    return top.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "b.n_shingles", "b.n_found", "b.containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; columns unchanged.

    Each text is judged by itself, so a leak takes no other row of its doc_id (null included) with it.
    """
    digest = F.sha2(no_null(F.col("text")), 256)
    hit = contained(docs.select(digest.alias("doc_id"), "text"), benchmark, threshold, width).select(F.col("doc_id").alias("_digest")).distinct()
    rows = wrapped(docs, _digest=digest)
    return unwrapped(rows.join(broadcast_measured(hit), "_digest", "left_anti"), docs.columns)


CONTAINED_SQL = r"""
WITH x AS (SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
        FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
sh AS (SELECT kind, id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM x WHERE len(w) > 0
  UNION SELECT kind, id, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' ')))) AS s
  FROM x, (SELECT DISTINCT len(w) AS n FROM x WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4) WHERE kind = 'd' AND len(w) >= n),
n AS (SELECT id, count(*) AS n FROM sh WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(max(n.n) AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_found, count(*) / max(n.n) AS containment
FROM sh d JOIN sh b ON d.kind = 'd' AND b.kind = 'b' AND d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) / max(n.n) >= 0.8 - 1e-12
"""


@query("op7_decontamination", CONTAINED_SQL)
def op7_decontamination(spark, folder):
    return contained(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
