"""Token ids as binary segments with Elias-Fano document boundaries.

A segment file holds a run of documents in ascending document id:

    magic "TIDS0001" | id width (2 or 4) | documents n | tokens m | first start in its partition
    Elias-Fano of the n + 1 boundaries | Elias-Fano of the n document ids | ids

Elias-Fano of n non-decreasing values below u keeps floor(log2(u / n)) low bits of
each, packed, and the high parts in unary; every 64th one of the unary bits is
sampled, so that ``select`` scans a few words. That is about 2 + log2(u / n) bits a
value, in place of a 64-bit table.

Documents are dealt by ranges of their id, each range writes its own segments, and a
file is renamed into place when whole, so that a repeated task replaces it by equal
content. The base of a range is the sum of the ranges before it: one number a range.

Null text counts as empty (its end id alone). A null document id sorts first, and
repeated ids and rows keep all their rows. Texts are read whole, however long. Other
columns are left aside, whatever their names. An empty table gives no segment and no row.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, new_path
from .word_ids import END, encoder

MAGIC = b"TIDS0001"
#: A segment ends with the document that reaches so many ids.
SEGMENT_IDS = 4_000_000
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of unsigned integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        # low parts, most significant bit first
        shifts = np.arange(low_bits - 1, -1, -1, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()) if low_bits else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        at, value = i * self.low_bits, 0
        for k in range(at, at + self.low_bits):
            value = value << 1 | int(self.low[k >> 3]) >> (7 - (k & 7)) & 1
        return value

    def select(self, i: int) -> int:
        """The i-th value, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) & 0xFF >> (at & 7)  # from the sampled one on
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for k in range(8):
            if word >> (7 - k) & 1:
                if left == 0:
                    return (byte * 8 + k - i) << self.low_bits | self._low(i)
                left -= 1
        raise AssertionError("a sampled one is missing")

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits - 1, -1, -1, dtype=np.int64))
        return high.astype(np.int64) << self.low_bits | low

    def tobytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return struct.pack("<QBQQQ", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def frombytes(cls, raw: memoryview, at: int) -> tuple["EliasFano", int]:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        low, high, samples = np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c // 4, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + c


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """The documents' ids with their end id. A null document id is kept as the least value of the sequence."""
    lengths = np.array([len(x) + 1 for x in ids], np.int64)
    all_ids = np.full(int(lengths.sum()), END, np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    for x, at in zip(ids, bounds):
        all_ids[at : at + len(x)] = x
    width = 2 if not len(all_ids) or all_ids.max() < 1 << 16 else 4
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    head = MAGIC + struct.pack("<BQQQQq", width, len(ids), int(bounds[-1]), base, nulls, least)
    shifted = (known.astype(object) - least).astype(np.uint64) if len(known) else known
    return head + EliasFano.encode(bounds).tobytes() + EliasFano.encode(shifted).tobytes() + all_ids.astype(f"<u{width}").tobytes()


class Segment:
    def __init__(self, raw: bytes):
        view = memoryview(raw)
        if view[:8] != MAGIC:
            raise ValueError("not a token segment")
        width, self.n, self.m, self.base, self.nulls, self.least = struct.unpack_from("<BQQQQq", view, 8)
        self.bounds, at = EliasFano.frombytes(view, 8 + struct.calcsize("<BQQQQq"))
        self.doc_ids, at = EliasFano.frombytes(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.m, at)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, with the end id."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def document_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + int(x) for x in self.doc_ids.decode()]


def put(url: str, content: bytes) -> None:
    """Writes a whole file under another name, then renames it; a repeated task replaces the file."""
    store, path = filesystem(url)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part := f"{path}.{os.getpid()}.part") as out:
        out.write(content)
    store.move(part, path)


def write(df: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> list[tuple[int, int]]:
    """Writes the segments of ``df`` under ``out``; returns (range, ids) for each range, in order of document id."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # equal ids may fall to several ranges, so that no id can fill one
    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        part, segment, base, names, kept, size = None, 0, 0, [], [], 0

        def flush():
            nonlocal segment, base, names, kept, size
            put(f"{out}/part-{part:06d}-{segment:06d}.tids", pack_segment(names, kept, base))
            segment, base, names, kept, size = segment + 1, base + size, [], [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for at in range(0, len(ids), 256):
                for d, x in zip(ids[at : at + 256], e.encode_all([t or "" for t in texts[at : at + 256]])):
                    names.append(d)
                    kept.append(x)
                    size += len(x) + 1
                    if size >= segment_ids:
                        flush()
        if names:
            flush()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([base], pa.int64())], names=["part", "ids"])

    return sorted((r["part"], r["ids"]) for r in dealt.mapInArrow(run, "part int, ids bigint").collect())


def read(spark: SparkSession, out: str, ranges: list[tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, found by ``select`` in the segment files."""
    if not ranges:
        return spark.createDataFrame([], f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    bases, total = {}, 0
    for part, ids in ranges:
        bases[part] = total
        total += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Segment(raw.as_buffer().to_pybytes())
                base = bases[int(os.path.basename(path).split("-")[1])] + s.base
                names = s.document_ids()
                for at in range(0, s.n, 4096):
                    # the boundaries of a few documents at a time, never the whole table
                    bounds = [s.bounds.select(i) for i in range(at, min(at + 4096, s.n) + 1)]
                    spans = list(zip(bounds, bounds[1:]))
                    columns = [names[at : at + 4096], [base + a for a, _ in spans], [b - a for a, b in spans], [zlib.crc32(s.ids[a:b].astype("<u4")) for a, b in spans]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[id_col, "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tids").load(out).select("path", "content")
    return files.mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``df`` to the shared folder and reads the segments back."""
    spark = df.sparkSession
    out = new_path(spark, "tokens")
    return read(spark, out, write(df, out, tokenizer, id_col, text_col), id_col)
