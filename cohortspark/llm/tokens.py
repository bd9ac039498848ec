"""Token ids in fixed-width bit-packed files.

A file set is a Parquet table of blocks, so any store Spark writes to will do and a lost task leaves no half file. A block
(``shard, block, first, n_ids, width, packed, doc_ids, lengths``) holds whole documents, about ``BLOCK`` ids: every id in
the vocabulary's least number of bits, the first id in the lowest bits. ``first`` is the shard's number of ids before the
block, so id ``i`` of a shard lies in the block of the greatest ``first`` not above ``i``, at bit ``(i - first) * width``,
and document boundaries are the running sums of ``lengths``. Shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import broadcast_measured, no_null
from cohortspark.llm.registry import query, read
from cohortspark.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END = 2
BLOCK = 1 << 16
TOGETHER = 20_000
LETTERS = 12_000_000


def width_of(largest: int) -> int:
    """Bits that hold every id up to ``largest``."""
    return max(int(largest).bit_length(), 1)


def pack(ids: np.ndarray, width: int) -> bytes:
    ids = np.asarray(ids, dtype=np.uint64)
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, n: int, width: int, skip: int = 0) -> np.ndarray:
    """Ids ``skip`` to ``n`` of a block as uint32; bytes before the first are not touched."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, dtype=f"<u{width // 8}")[skip:n].astype(np.uint32)
    low = skip * width // 8
    bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)[low:(n * width + 7) // 8], bitorder="little")
    bits = bits[skip * width - 8 * low:n * width - 8 * low].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Where every blank is followed by something else than white space, a text falls apart before each blank without
    changing its ids. Such pieces repeat, so each different one of a batch is encoded once, many to a call, and the ids
    are put together by position. Other texts, and those holding a special token, are encoded as they are.
    """

    odd = r" (?:[\s\p{Z}\x0b\x1c-\x1f\x{85}]|$)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.zeros(self.size, dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.opens[i] = piece.startswith("Ġ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, each after a blank, and where each piece's begin (one more at the end).

        A last comma or full stop after a letter is a unit of its own, so such pieces share the word's ids.
        """
        bare = pc.replace_substring_regex(names, r"(\pL)[.,]$", r"\1")
        words = bare.dictionary_encode()
        cuts = [*range(0, len(words.dictionary), TOGETHER), len(words.dictionary)]
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, words.dictionary.cast(pa.string())), " ").to_pylist()
        ids = np.concatenate(self.plain([" " + j for j in joined]))
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words.dictionary):
            raise ValueError("the vocabulary has an id that runs across a blank")
        at = words.indices.to_numpy()
        n = np.diff(np.append(starts, len(ids)))[at]
        marked = pc.not_equal(pc.binary_length(names), pc.binary_length(bare)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n + marked)
        out, last = np.empty(int(ends[-1]), dtype=np.uint32), np.zeros(int(ends[-1]), dtype=bool)
        last[ends[marked] - 1] = True
        out[~last] = ids[spread(starts[at], n)]
        comma, stop = (i[0] for i in self.plain([",", "."]))
        out[last] = np.where(pc.ends_with(names, ",").to_numpy(zero_copy_only=False)[marked], comma, stop)
        return out, np.append(0, ends)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(odd), self.plain(texts.filter(pa.array(odd)).to_pylist()), strict=True):
            out[i] = ids
        even = np.flatnonzero(~odd)
        if not len(even):
            return out
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        # The first piece of a text has no blank before it.
        heads = self.plain(pc.list_element(split, 0).to_pylist())
        coded = split.flatten().dictionary_encode()
        ids, starts = self.pieces(coded.dictionary)
        at = coded.indices.to_numpy()
        n = np.diff(starts)[at]
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        n[edges[:-1]] = 0
        flat = ids[spread(starts[at], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[edges]
        for k, i in enumerate(even):
            out[i] = np.concatenate([heads[k], flat[ends[k]:ends[k + 1]]])
        return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... counts[i] of them, for all i in turn."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def encoder(name: str) -> Encoder:
    """One encoder per worker process. Functions travel by value, so it is kept where it outlives a task."""
    held = sys.modules.setdefault("_cohortspark_encoders", types.ModuleType("_cohortspark_encoders")).__dict__
    if name not in held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers

        held[name] = Encoder(public_tokenizers.path(name) if "/" not in name else name)
    return held[name]


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int | None = END, block: int = BLOCK) -> None:
    """Encodes whole texts (null: empty), appends ``end`` to each and writes the file set under ``path``.

    Shards are ranges of doc_id, null first. Rows that repeat a doc_id follow each other in some order, over several
    shards if they are many. No rows write an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        width = width_of(max(tool.size - 1, end or 0))
        number = first = 0
        for b in batches:
            for part in slices(b, LETTERS):
                got = tool.batch(part.column(2))
                if end is not None:
                    got = [np.append(g, np.uint32(end)) for g in got]
                shard, ids, made = part.column(0)[0].as_py(), part.column(1).to_pylist(), []
                cuts = np.flatnonzero(np.diff(np.cumsum([0] + [len(g) for g in got]) // block)) + 1
                for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(got)]):
                    if low < high:
                        flat = np.concatenate(got[low:high])
                        made.append((shard, number, first, len(flat), width, pack(flat, width), ids[low:high], [len(g) for g in got[low:high]]))
                        number, first = number + 1, first + len(flat)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types_, strict=True)], [n for n, _ in fields])

    fields = [("shard", "int"), ("block", "int"), ("first", "long"), ("n_ids", "long"), ("width", "int"), ("packed", "binary"), ("doc_ids", "array<long>"), ("lengths", "array<long>")]
    types_ = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    order = ["doc_id", "key", "row"]
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), no_null(F.col("text").cast("string")).alias("text"),
                        F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"))
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    # Packed ids hardly compress.
    placed.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields)).write.option("compression", "none").parquet(path)


def slices(batch: pa.RecordBatch, letters: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about so many bytes of text (column 2)."""
    if batch.num_rows:
        group = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)) // letters
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids before them in all shards."""
    table = spark.read.parquet(path)
    ends = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per writing task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("base"))
    return table.join(broadcast_measured(base), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens`` and ``ids_crc32`` of its ids as little-endian uint32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, n, crc = [], [], [], []
            for at, count, width, packed, ids, lengths in zip(*[c.to_pylist() if i != 3 else c for i, c in enumerate(b.columns)], strict=True):
                flat = memoryview(unpack(packed.as_buffer(), count, width).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                doc += ids
                start += (at + ends - lengths).tolist()
                n += lengths
                crc += [zlib.crc32(flat[4 * (e - m):4 * e]) for e, m in zip(ends.tolist(), lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    held = blocks(spark, path).select("start", "n_ids", "width", "packed", "doc_ids", "lengths")
    return held.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, low: int, high: int) -> np.ndarray:
    """Ids ``low`` to ``high`` of the whole corpus: only blocks that hold some of them are read, from their own bit on."""
    held = blocks(spark, path).where((F.col("start") < high) & (F.col("start") + F.col("n_ids") > low)).select("start", "n_ids", "width", "packed")
    parts = [unpack(r["packed"], min(high - r["start"], r["n_ids"]), r["width"], max(low - r["start"], 0)) for r in held.orderBy("start").toLocalIterator()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def encode_corpus(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes the corpus in the shared folder and returns what the files hold of each document."""
    path = scratch_path(spark, "token-ids")
    write(docs, path)
    return read_documents(spark, path)


@query("op6_tokens")
def op6_tokens(spark, folder):
    return encode_corpus(spark, read(spark, folder, "documents"))
