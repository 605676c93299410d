"""Removal of lines that many documents share, by a sharded minimal perfect hash.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case.
Keys of LEAST_CHARS code points or more get a 128-bit hash. Rows are counted by it, and
the hashes found in LEAST_DOCS documents or more make the index: shards of some
SHARD_KEYS hashes, each with

* a minimal perfect hash: bitmaps level by level, a hash settles on the first level where
  it has a bit to itself, its number is that bit's rank over all levels;
* compact arrays by that number: a 64-bit fingerprint that tells strangers (all other
  lines meet some number too), the count of documents, and the largest document id.

Documents probe the arrays. An index of HELD_BYTES or less is read by each worker from the
shared folder, shard by shard as its lines ask; beyond that the lines' hashes are dealt to
the shards' tasks, without texts, crowded shards in several tasks, and the answers come
back to their rows.

Every row is a document. A line that is to go stays in the rows with the largest id that
holds it, however often it stands there; rows without an id count as the least id (-2**63).
Null and empty texts are one empty line. Texts are read whole, however long; other columns
may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shield, filesystem, map_beside, new_path, scratch, written

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Hashes of a shard, about.
SHARD_KEYS = 1 << 20
#: An index of so many bytes is held whole by each worker.
HELD_BYTES = 256_000_000
#: Bytes of a hash in the index: fingerprint, document id, count, and about 4 bits of the bitmaps.
KEY_BYTES = 21
NO_ID = -(1 << 63)
_TAIL = bytes(range(0x80, 0xC0))
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def keys_of(raw: bytes) -> list[bytes | None]:
    """Each line's key; null for keys of fewer than LEAST_CHARS code points."""
    return [k if len(k) >= LEAST_CHARS and (k.isascii() or len(k.translate(None, _TAIL)) >= LEAST_CHARS) else None for k in map(bytes.strip, raw.lower().split(b"\n"))]


def hashes(keys: list[bytes]) -> np.ndarray:
    """Rows of two signed 64-bit words."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (a + np.uint64((level + 1) * int(_C1) & (1 << 64) - 1)) * _C2 ^ b * _C3
    x ^= x >> np.uint64(31)
    x *= _C3
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0..n-1 of n distinct pairs of words."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # 64-bit words of each bitmap
        counts = [np.bitwise_count(w).astype(np.int64) for w in levels]
        total, self.before = 0, []
        for c in counts:
            self.before.append(total + np.concatenate([[0], np.cumsum(c)[:-1]]))
            total += int(c.sum())
        self.n = total

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "PerfectHash":
        levels: list[np.ndarray] = []
        while len(a):
            words = (2 * len(a) + 63) // 64
            at = _place(a, b, len(levels), 64 * words)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair of the set; that of any other pair is one of the set's, or -1."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for k, words in enumerate(self.levels):
            if not len(left):
                break
            at = _place(a[left], b[left], k, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[k][at[hit] >> 6] + below
            left = left[~hit]
        return out


class Shard:
    """A minimal perfect hash and its arrays; ``columns`` and ``of`` carry them through a table's row."""

    SCHEMA = "sizes array<int>, bits binary, marks binary, counts binary, owners binary"

    def __init__(self, sizes: list[int], bits: bytes, marks: bytes, counts: bytes, owners: bytes):
        words, ends = np.frombuffer(bits, "<u8"), np.cumsum(sizes)
        self.hash = PerfectHash([words[e - s : e] for s, e in zip(sizes, ends)])
        self.marks, self.counts, self.owners = np.frombuffer(marks, "<i8"), np.frombuffer(counts, "<u4"), np.frombuffer(owners, "<i8")
        self.bytes = len(bits) + len(marks) + len(counts) + len(owners)

    @staticmethod
    def columns(pairs: np.ndarray, n: np.ndarray, owner: np.ndarray) -> list:
        a, b = (np.ascontiguousarray(pairs[:, k]).view(np.uint64) for k in (0, 1))
        h = PerfectHash.build(a, b)
        order = np.argsort(h.find(a, b))
        bits = np.concatenate([*h.levels, np.empty(0, "<u8")])
        counts = np.minimum(n[order], (1 << 32) - 1).astype("<u4")
        return [[len(w) for w in h.levels], bits.tobytes(), pairs[order, 1].astype("<i8").tobytes(), counts.tobytes(), owner[order].astype("<i8").tobytes()]

    def owner(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a pair is in the set, its largest document id)."""
        a, b = (np.ascontiguousarray(pairs[:, k]).view(np.uint64) for k in (0, 1))
        at = self.hash.find(a, b)
        known = at >= 0
        known[known] = self.marks[at[known]] == pairs[known, 1]
        owner = np.zeros(len(at), np.int64)
        owner[known] = self.owners[at[known]]
        return known, owner


def shard_of(first: np.ndarray, bits: int) -> np.ndarray:
    return (first.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)


class Shards:
    """The index's shards in the shared folder, read when asked for; the latest of them, of HELD_BYTES at most and one at least, stay."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits
        self.held: OrderedDict[int, Shard] = OrderedDict()

    def shard(self, k: int) -> Shard | None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if k not in self.held:
            store, at = filesystem(f"{self.path}/shard={k}")
            files = [f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]
            rows = [r for f in files for r in pq.ParquetFile(f, filesystem=store).read(columns=["sizes", "bits", "marks", "counts", "owners"]).to_pylist()]
            self.held[k] = Shard(**rows[0]) if rows else None
        self.held.move_to_end(k)
        while len(self.held) > 1 and sum(s.bytes for s in self.held.values() if s) > HELD_BYTES:
            self.held.popitem(last=False)
        return self.held[k]

    def lost(self, pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a line of each hash goes from a document of each id."""
        out, of = np.zeros(len(pairs), bool), shard_of(np.ascontiguousarray(pairs[:, 0]), self.bits)
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(part) and (s := self.shard(int(of[part[0]]))):
                known, owner = s.owner(pairs[part])
                out[part] = known & (owner != ids[part])
        return out


_opened: dict[str, Shards] = {}


def opened(path: str, bits: int) -> Shards:
    """One index for each worker process, the latest."""
    if path not in _opened:
        _opened.clear()
        _opened[path] = Shards(path, bits)
    return _opened[path]


def _raw(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()):
        yield x.as_py() or b""


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def line_hashes(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(a, b, id, more...): the distinct keys of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [list({k for k in keys_of(raw) if k}) for raw in _raw(batch, "t")], _ids(batch, "id")
            pairs, each = hashes([k for ks in found for k in ks]), [len(ks) for ks in found]
            carried = [pa.array(np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(), each)) for c in more]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.repeat(ids, each)), *carried], names=["a", "b", "id", *more])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *more)
    return rows.mapInArrow(run, "a bigint, b bigint, id bigint" + "".join(f", {c} bigint" for c in more))


def build(df: DataFrame, id_col: str, text_col: str, least_docs: int = LEAST_DOCS) -> tuple[str, int, int]:
    """(path, bits, hashes) of the index over the lines of ``df`` that ``least_docs`` documents hold; 2**bits shards."""
    counted = line_hashes(df, id_col, text_col).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("id")).where(F.col("n") >= least_docs)
    with scratch():
        common = written(counted, "common-lines")
        n = common.count()
        bits = max(0, math.ceil(math.log2(max(1, n) / SHARD_KEYS)))
        path = new_path(df.sparkSession, "line-index")

        def one(t: pa.Table) -> pa.Table:
            pairs = np.column_stack([t.column(c).to_numpy() for c in ("a", "b")])
            made = Shard.columns(pairs, t.column("n").to_numpy(), t.column("id").to_numpy())
            return pa.table([pa.array([t.column("shard")[0].as_py()], pa.int64()), *[pa.array([c]) for c in made[:1]], *[pa.array([c], pa.binary()) for c in made[1:]]], names=["shard", "sizes", "bits", "marks", "counts", "owners"]).cast(_ARROW)

        shard = F.shiftrightunsigned("a", 64 - bits) if bits else F.lit(0).cast("long")
        shards = common.withColumn("shard", shard).groupBy("shard").applyInArrow(one, "shard bigint, " + Shard.SCHEMA)
        shards.write.partitionBy("shard").parquet(path)
    return path, bits, n


_ARROW = pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("bits", "marks", "counts", "owners")]])
KEPT = "n_lines bigint, n_dropped bigint, kept binary"


def _cut(raw: bytes, lost: set[bytes]) -> tuple[int, int, bytes]:
    lines = raw.split(b"\n")
    if not lost:
        return len(lines), 0, raw
    stay = [line for line, k in zip(lines, keys_of(raw)) if k not in lost]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The columns of ``df`` and n_lines (before), n_dropped, kept (the text without the lines that go)."""
    at = Shield(df)
    text, rows = at.of[text_col], at.df.withColumn("_id", F.col(at.of[id_col]).cast("long"))
    path, bits, n = build(rows, "_id", text, least_docs)
    if n * KEY_BYTES <= held_bytes:
        out = map_beside(rows, _probe_here(path, bits, text), KEPT)
    else:
        # each row must keep its number, so that the table it's read from is written
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        out = map_beside(_answers(rows, path, bits, text), _apply(text), KEPT)
    return out.select(*at.back, "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))


def _probe_here(path: str, bits: int, text: str) -> Callable:
    def make():
        index = opened(path, bits)

        def f(batch: pa.RecordBatch) -> list:
            raws, ids = list(_raw(batch, text)), _ids(batch, "_id")
            found = [list({k for k in keys_of(raw) if k}) for raw in raws]
            each = [len(ks) for ks in found]
            lost = index.lost(hashes([k for ks in found for k in ks]), np.repeat(ids, each)).tolist()
            got, start = [], 0
            for raw, ks, m in zip(raws, found, each):
                got.append(_cut(raw, {k for k, x in zip(ks, lost[start : start + m]) if x}))
                start += m
            return [list(c) for c in zip(*got)]

        return f

    return make


def _answers(rows: DataFrame, path: str, bits: int, text: str) -> DataFrame:
    """``rows`` with ``_lost``, the hashes that go from each: hashes are dealt to the shards, and crowded shards to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = opened(path, bits)
        for batch in batches:
            pairs = np.column_stack([batch.column(k).to_numpy() for k in (0, 1)]).reshape(-1, 2)
            yield batch.filter(pa.array(index.lost(pairs, batch.column(2).to_numpy()))).select([0, 1, 3])

    shard = F.shiftrightunsigned("a", 64 - bits) if bits else F.lit(0).cast("long")
    asked = line_hashes(rows, "_id", text, "_row").withColumn("shard", shard).hint("rebalance", "shard").drop("shard")
    lost = asked.mapInArrow(run, "a bigint, b bigint, _row bigint").groupBy("_row").agg(F.collect_list(F.struct("a", "b")).alias("_lost"))
    return rows.join(lost, "_row", "left")


def _apply(text: str) -> Callable:
    def make():
        def f(batch: pa.RecordBatch) -> list:
            got = []
            for raw, lost in zip(_raw(batch, text), batch.column(batch.schema.get_field_index("_lost")).to_pylist()):
                keys = list({k for k in keys_of(raw) if k}) if lost else []
                gone = {(x["a"], x["b"]) for x in lost or ()}
                got.append(_cut(raw, {k for k, p in zip(keys, hashes(keys).tolist()) if tuple(p) in gone}))
            return [list(c) for c in zip(*got)]

        return f

    return make
