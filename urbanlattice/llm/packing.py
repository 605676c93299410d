"""Sum-of-squares packing of documents into token sequences.

Documents longer than a sequence are cut into full pieces, which are sequences by
themselves; the rest of each document is placed whole. N(g) counts the open sequences
with gap g. Each piece, longest first, goes into the gap that holds it and makes the sum
over all gaps of N(g)**2 least; ties take the smallest gap. A new sequence is opened only
if no gap holds the piece: the rule that also opens one where that makes the sum less
needs more sequences than best fit. Full sequences count as no gap. Where this takes
more sequences than the tokens fill, gaps compete within a shorter reach (REACHES), down
to best fit, and the fewest sequences stand.

Pieces are dealt at random into groups of bounded size that are packed apart, a
group's loss being a few sequences. Null text counts as empty: its end id alone.
Rows count by themselves: repeated ones, and those that share an id or have none, are
packed as often as they occur. Other columns are left aside, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted
from .word_ids import END, encoder

CAPACITY = 4096
#: Pieces of a packing group, about. More pieces waste less and take longer in one task.
GROUP_PIECES = 60_000


#: How much larger than a piece the gaps may be that compete for it. The first reach is all gaps; the others are tried
#: only if it takes more sequences than the pieces' tokens fill. At the last the smallest gap wins.
REACHES = (CAPACITY, 1024, 256, 64, 16, 0)


def _placed(sizes: np.ndarray, capacity: int, reach: int) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(-sizes, kind="stable")
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    bins_at: dict[int, list[int]] = defaultdict(list)
    where, offset, bins = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in order.tolist():
        s = int(sizes[i])
        g = np.flatnonzero(count[s:]) + s
        if len(g):
            g = g[: max(1, int(np.searchsorted(g, s + reach, "right")))]
            # adding to gap g takes 2 N(g) - 1 from the sum; the gap that stays adds 2 N(g - s) + 1, or nothing if none stays
            left = g - s
            change = 1 - 2 * count[g] + np.where(left > 0, 2 * count[left] + 1, 0)
            best = int(g[change.argmin()])
            b = bins_at[best].pop()
            count[best] -= 1
        else:
            b, best = bins, capacity
            bins += 1
        where[i], offset[i] = b, capacity - best
        if best > s:
            bins_at[best - s].append(b)
            count[best - s] += 1
    return where, offset, bins


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins) of each size, in any order of sizes given; sizes are 1..capacity."""
    least, best = -(-int(sizes.sum()) // capacity), None
    for reach in REACHES:
        got = _placed(sizes, capacity, reach)
        if best is None or got[2] < best[2]:
            best = got
        if best[2] == least:
            break
    return best


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, row): the pieces of each document's ids with the end id; ``row`` numbers rows of
    ``df`` and holds once the pieces are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            docs, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(docs), 256):
                rows = []
                texts = batch.column(1)[at : at + 256].to_pylist()
                for d, r, x in zip(docs[at : at + 256], numbers[at : at + 256], e.encode_all([t or "" for t in texts])):
                    ids = np.append(x, np.uint32(END)).astype("<u4")
                    rows += [(d, k, s, len(p), zlib.crc32(p), r) for k, s in enumerate(range(0, len(ids), capacity)) for p in [ids[s : s + capacity]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=[id_col, "piece", "start", "length", "ids_crc32", "row"])

    docs = df.select(F.col(quoted(id_col)).cast("long").alias(id_col), F.col(quoted(text_col)).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return docs.mapInArrow(run, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint")


def pack(cut: DataFrame, n_pieces: int, id_col: str = "doc_id", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to written pieces. ``n_pieces``: how many rows ``cut`` has."""
    groups = max(1, round(n_pieces / group_pieces))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long"))
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def one(t: pa.Table) -> pa.Table:
        # the order of rows must not depend on how they arrived
        t = t.sort_by([(c, "ascending") for c in ("row", "piece")])
        bins, offsets, _ = pack_sizes(t.column("length").to_numpy(), capacity)
        g = t.column("_group")[0].as_py()
        return pa.table([*[t.column(c) for c in names[:5]], pa.array(bins * groups + g), pa.array(offsets)], names=names)

    return dealt.groupBy("_group").applyInArrow(one, schema)
