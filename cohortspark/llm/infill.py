"""Fill-in-middle transformation over texts kept in seekable compressed frames.

A text is cut into units, runs of ASCII letters or single other characters. It is stored as zstandard frames of about
``FRAME`` bytes that can be read apart, each beginning with a unit, with the units and characters before each frame. A cut
is found by decompressing the one frame that holds it; outputs and digests stream over the frames in output order, so
no more than a frame of a text is open at a time, however long it is.

The store is a Parquet table, a row per document: ``row`` (the other columns), ``key``, ``n`` units, ``marked`` (the text holds
a mark), ``data`` (all frames) and ``at, units, chars``: what lies before each frame, and at the end the totals.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortspark.llm.common import byte_runs, no_null
from cohortspark.llm.registry import query, read
from cohortspark.session import scratch_path

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = re.compile(rb"<[PSM]>")
SEED = "1:"
PLAIN_FROM = 90
SPM_BELOW = 20
FRAME = 1 << 15
TOGETHER = 4 << 20

LETTER = np.zeros(256, dtype=bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = True

STORED = [("key", "string", pa.string()), ("n", "long", pa.int64()), ("marked", "boolean", pa.bool_()), ("data", "binary", pa.large_binary()),
          ("at", "array<long>", pa.list_(pa.int64())), ("units", "array<long>", pa.list_(pa.int64())), ("chars", "array<long>", pa.list_(pa.int64()))]
MADE = [("n", "long", pa.int64()), ("form", "string", pa.string()), ("prefix_chars", "long", pa.int64()), ("middle_chars", "long", pa.int64()),
        ("output_sha256", "string", pa.string()), ("restored_sha256", "string", pa.string())]


def _heads(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a character."""
    return (data & 0xC0) != 0x80


def _starts(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a unit, if the first one does."""
    letter, out = LETTER[data], _heads(data)
    out[1:] &= ~(letter[1:] & letter[:-1])
    return out


@dataclass(frozen=True)
class Frames:
    """A stored text."""

    data: bytes
    at: Sequence[int]
    units: Sequence[int]
    chars: Sequence[int]

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[self.at[i]:self.at[i + 1]])

    def place(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and characters before the given unit (past the last: the end)."""
        if unit >= self.units[-1]:
            return len(self.at) - 1, 0, self.chars[-1]
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        data = np.frombuffer(self.frame(i), np.uint8)
        byte = int(np.flatnonzero(_starts(data))[unit - self.units[i]])
        return i, byte, self.chars[i] + int(_heads(data[:byte]).sum())

    def stream(self, low: tuple[int, int] = (0, 0), high: tuple[int, int] | None = None) -> Iterator[bytes]:
        """Bytes between two places (frame, byte), frame by frame."""
        last, end = high or (len(self.at) - 1, 0)
        for i in range(low[0], last + (end > 0)):
            yield self.frame(i)[low[1] if i == low[0] else 0:end if i == last else None]


def framed(text: bytes, size: int = FRAME) -> Frames:
    """Frames of about ``size`` bytes; a longer unit stays in one frame."""
    data, low, out = np.frombuffer(text, np.uint8), 0, []
    at, units, chars = [0], [0], [0]
    compress = zstandard.ZstdCompressor().compress
    while low < len(data):
        high = min(low + size, len(data))
        while high < len(data):
            ahead = _starts(data[high - 1:high + size])[1:]
            if ahead.any():
                high += int(ahead.argmax())
                break
            high += len(ahead)
        out.append(compress(text[low:high]))
        at.append(at[-1] + len(out[-1]))
        units.append(units[-1] + int(_starts(data[low:high]).sum()))
        chars.append(chars[-1] + int(_heads(data[low:high]).sum()))
        low = high
    return Frames(b"".join(out), at, units, chars)


def choice(key: str, n: int, marked: bool) -> tuple[str, int, int]:
    """Form and the two cuts, in units, from a SHA-256 of the key."""
    digest = hashlib.sha256((SEED + key).encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))
    form = "plain" if marked or n == 0 or h3 % 100 >= PLAIN_FROM else "spm" if h4 % 100 < SPM_BELOW else "psm"
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    return form, *cuts


def output(text: Frames, form: str, low: tuple[int, int], high: tuple[int, int]) -> Iterator[bytes]:
    """The transformed text, piece by piece."""
    if form == "plain":
        yield from text.stream()
        return
    parts = {PREFIX: text.stream((0, 0), low), SUFFIX: text.stream(high), MIDDLE: text.stream(low, high)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield mark
        yield from parts[mark]


def restored(pieces: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The original text, piece by piece, from the pieces of an output. The suffix waits compressed until all else is out."""
    if form == "plain":
        yield from pieces
        return
    waiting, part, tail = [], None, b""

    def put(piece: bytes) -> Iterator[bytes]:
        if part != SUFFIX:
            yield piece
        elif piece:
            waiting.append(zstandard.ZstdCompressor(level=1).compress(piece))

    for piece in pieces:
        tail += piece
        while m := MARK.search(tail):
            yield from put(tail[:m.start()])
            part, tail = m.group(), tail[m.end():]
        # The last two bytes may begin a mark.
        yield from put(tail[:-2])
        tail = tail[-2:]
    yield from put(tail)
    for held in waiting:
        yield zstandard.ZstdDecompressor().decompress(held)


def _digest(pieces: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
    return h.hexdigest()


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = FRAME) -> None:
    """Stores whole texts (null: empty) under ``path``. Rows that repeat are stored as often; no rows make an empty table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_runs(b, TOGETHER, 2):
                made = []
                for k, v in zip(part.column(1).to_pylist(), part.column(2)):
                    raw = v.as_py()
                    f = framed(raw, size)
                    made.append((k, f.units[-1], MARK.search(raw) is not None, f.data, f.at, f.units, f.chars))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, (_, _, t) in zip(zip(*made), STORED, strict=True)]], names)

    names = ["row", *[n for n, _, _ in STORED]]
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"),
                       no_null(F.col(text).cast("string")).cast("binary").alias("text"))
    out = StructType([rows.schema["row"], *StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in STORED)).fields])
    rows.mapInArrow(run, out).write.option("compression", "none").parquet(path)


def transformed(spark: SparkSession, path: str, texts: bool = True) -> DataFrame:
    """Every stored document: its columns but the text, then ``n, form, prefix_chars, middle_chars``, digests of the output
    and of the text restored from it, and, unless ``texts`` is off, the ``output`` itself.

    Columns so named give way. The lengths count characters and are null in plain form, which texts without units, texts
    that hold a mark and a tenth of the rest take. Rows that repeat a key are cut by the same hash, null as the word null.
    """
    fields = [*MADE, *([("output", "string", pa.large_string())] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_runs(b, TOGETHER, 4):
                made = []
                for k, n, marked, data, *seek in zip(*[part.column(i) if i == 4 else part.column(i).to_pylist() for i in range(1, 8)], strict=True):
                    held = Frames(data.as_py(), *seek)
                    form, one, two = choice(k, n, marked)
                    low, high = ((0, 0, 0), (0, 0, 0)) if form == "plain" else (held.place(one), held.place(two))
                    pieces = lambda: output(held, form, low[:2], high[:2])  # noqa: B023, E731
                    lengths = (None, None) if form == "plain" else (low[2], high[2] - low[2])
                    row = (n, form, *lengths, _digest(pieces()), _digest(restored(pieces(), form)))
                    made.append((*row, b"".join(pieces()).decode()) if texts else row)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, (_, _, t) in zip(zip(*made), fields, strict=True)]], names)

    names = ["row", *[n for n, _, _ in fields]]
    table = spark.read.parquet(path).select("row", *[n for n, _, _ in STORED])
    out = StructType([table.schema["row"], *StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in fields)).fields])
    made = table.mapInArrow(run, out)
    kept = [c for c in table.schema["row"].dataType.names if c not in names]
    return made.select(*[F.col("row").getField(c).alias(c) for c in kept], *names[1:])


INFILL_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
c AS (SELECT doc_id, text, u, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM c),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256 FROM p
"""


@query("op12_infill", INFILL_SQL)
def op12_infill(spark, folder):
    """Stores all documents in frames, then cuts, transforms and restores them from there."""
    path = scratch_path(spark, "frames")
    write(read(spark, folder, "documents").select("doc_id", "text"), path)
    return transformed(spark, path, texts=False)
