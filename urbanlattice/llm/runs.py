"""Runs of words that repeat with a period, by branching tandem repeats of a suffix tree.

The words ``[^\\x20\\x09-\\x0D]+`` of a text are numbered from 0. A run is a stretch of
consecutive words with smallest period q and length >= max(LEAST, 3 q) that no
neighbouring word extends keeping the period. A word is dropped if a run contains it
after that run's first q words.

Every window of GATE words of a run recurs in it, q words on or back. So texts are first cut to the stretches
whose windows' hashes recur (equal windows have equal hashes, so that none is missed).
The stretches of a few documents make one text with separators of their own, of which

* suffixes are sorted by doubling, common prefixes of neighbours taken from the ranks of
  each doubling, and the tree's inner nodes are the intervals of equal prefixes;
* at each node of depth q the leaves of all children but the largest are looked at: leaf i
  is a branching tandem repeat of half q if leaf i + q (or i - q) is below the node too and
  the word after the square differs from the one q before it;
* each branching repeat is rotated to the left as far as words agree, and repeats of the
  same stretch are merged under the least half, which makes the maximal runs.

Rows count by themselves, whatever their ids. Null and empty texts have no words. Texts
are read whole; one text at a time is held. Other columns may have any name. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shield, map_beside

LEAST, TIMES = 24, 3
#: Words of the windows that all recur in each run. A run of length n and period q has windows with a like q on in all but
#: its last q + GATE - 1 places and q back in all but its first q: these cover it if GATE <= n - 2 q + 1, of which this is the least.
GATE = LEAST - 2 * (LEAST // TIMES) + 1
#: Words of the stretches that make one tree, about; one document's may be more.
TREE_WORDS = 200_000
#: Leaves that are looked at together.
LEAVES = 2_000_000


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their places, common prefix of each with the one before) of a text of whole numbers."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n > 1 and step < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        ranks.append(rank)
        step *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero((a < n) & (b < n))
        same = live[ranks[level][a[live]] == ranks[level][b[live]]]
        common[same + 1] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, common


def light_children(common: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows (depth, first leaf, last leaf, child's first, child's last): for each inner node of depth up to ``most``, its children but the largest."""
    out: list[tuple[int, int, int, int, int]] = []
    depths, firsts, kids = [0], [0], [[]]
    size = 0
    for i, d in enumerate([*common[1:].tolist(), 0]):
        first, last = i, i  # the leaf, or the node that ends here
        while d < depths[-1]:
            depth, lo, mine = depths.pop(), firsts.pop(), kids.pop()
            mine.append((first, last))
            if depth <= most:
                big = max(range(len(mine)), key=lambda k: mine[k][1] - mine[k][0])
                for k, (a, b) in enumerate(mine):
                    if k != big:
                        out.append((depth, lo, i, a, b))
                        size += b - a + 1
            first, last = lo, i
        if d == depths[-1]:
            kids[-1].append((first, last))
        else:
            depths.append(d)
            firsts.append(first)
            kids.append([(first, last)])
        if size >= LEAVES:
            yield np.array(out, np.int64)
            out, size = [], 0
    if out:
        yield np.array(out, np.int64)


def branching_repeats(text: np.ndarray, most: int) -> np.ndarray:
    """Distinct rows (start, half) of the branching tandem repeats of halves up to ``most``."""
    n = len(text)
    order, place, common = suffix_order(text)
    found = []
    for rows in light_children(common, most):
        depth, lo, hi, a, b = rows.T
        many = b - a + 1
        which = np.repeat(np.arange(len(rows)), many)
        leaf = order[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + a[which]]
        q, lo, hi = depth[which], lo[which], hi[which]
        for start, other in ((leaf, leaf + q), (leaf - q, leaf - q)):
            far = start + 2 * q
            ok = (other >= 0) & (other < n) & (far <= n)
            at = place[np.where(ok, other, 0)]
            ok &= (at >= lo) & (at <= hi)
            end = np.where(ok & (far < n), text[np.minimum(far, n - 1)], -1)
            ok &= end != text[np.where(ok, start, 0)]
            found.append(np.column_stack([start[ok], q[ok]]))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def rotated(text: np.ndarray, start: int, half: int) -> int:
    """The first place that ``start`` comes to by rotating its repeat to the left."""
    step = 64
    while start > 0:
        lo = max(0, start - step)
        unlike = np.flatnonzero(text[lo:start] != text[lo + half : start + half])
        if len(unlike):
            return lo + int(unlike[-1]) + 1
        start, step = lo, 2 * step
    return 0


def maximal_runs(text: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, of which no stretch without separators is longer than ``longest``."""
    repeats = branching_repeats(text, longest // TIMES)
    by_end: dict[int, list[tuple[int, int]]] = {}
    out = []
    for start, half in repeats[np.lexsort((repeats[:, 0], repeats[:, 1]))].tolist():
        end = start + 2 * half
        mine = by_end.setdefault(end, [])
        # a multiple of a known period inside the known stretch is no smallest period
        if any(half % p == 0 and s <= start for s, p in mine):
            continue
        first = rotated(text, start, half)
        mine.append((first, half))
        if end - first >= max(LEAST, TIMES * half):
            out.append((first, end - first, half))
    return out


def hot_stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of the stretches of a text, given its words' hashes, outside which no run can lie."""
    n = len(hashes)
    if n < LEAST:
        return []
    h, width = hashes, 1
    while width < GATE:
        # a window of twice the width, or of the width that is left
        step = min(width, GATE - width)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ h[step:] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        width += step
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    hot = np.zeros(len(h) + 2, np.int8)
    hot[order[1:][same] + 1] = 1
    hot[order[:-1][same] + 1] = 1
    turns = np.flatnonzero(np.diff(hot))
    return [(a, b + GATE - 1) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()) if b + GATE - 1 - a >= LEAST]


def find_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    pieces, owners, longest, size, number, apart = [], [], 0, 0, 0, 0

    def close() -> None:
        nonlocal pieces, owners, longest, size, number, apart
        if pieces:
            firsts = np.array([o[0] for o in owners])
            for start, length, period in maximal_runs(np.concatenate(pieces), longest):
                at, doc, first = owners[int(np.searchsorted(firsts, start, "right")) - 1]
                out[doc].append((first + start - at, length, period))
        pieces, owners, longest, size, number, apart = [], [], 0, 0, 0, 0

    for d, words in enumerate(docs):
        found = hot_stretches(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
        if not found:
            continue
        if size and size + sum(b - a for a, b in found) > TREE_WORDS:
            close()
        ids: dict[bytes, int] = {}
        for a, b in found:
            numbers = np.array([ids.setdefault(w, number + len(ids)) for w in words[a:b]], np.int64)
            owners.append((size, d, a))
            # separators are unlike each other and all words
            pieces += [numbers, np.array([-2 - apart], np.int64)]
            size, longest, apart = size + b - a + 1, max(longest, b - a), apart + 1
        number += len(ids)
    close()
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; the least start, then period, on ties."""
    return min(runs, key=cmp_to_key(lambda x, y: y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2])) if runs else None


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by a space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, k in zip(words, (np.cumsum(gone) == 0).tolist()) if k])


FOUND = "runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed binary"


def detect(df: DataFrame, text_col: str = "text", words: Callable[[list[bytes], int | None], list[bytes]] | None = None, id_col: str | None = None) -> DataFrame:
    """The columns of ``df`` and runs, best (null without runs), collapsed (the words that stay, joined by a space).

    ``words``: what to make of a row's words, given the row's ``id_col``, before runs are sought."""
    at = Shield(df)
    text, id_at = at.of[text_col], at.of.get(id_col)
    triple = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    named = lambda r: dict(zip(("start", "length", "period"), r))

    def make():
        def f(batch: pa.RecordBatch) -> list:
            docs = [(x.as_py() or b"").split() for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary())]
            if words:
                docs = [words(w, i) for w, i in zip(docs, batch.column(batch.schema.get_field_index(id_at)).to_pylist())]
            found = find_runs(docs)
            best = [strongest(r) for r in found]
            return [pa.array([[named(x) for x in r] for r in found], pa.list_(triple)), pa.array([b and named(b) for b in best], triple), pa.array([collapsed(w, r) for w, r in zip(docs, found)], pa.binary())]

        return f

    return map_beside(at.df, make, FOUND).select(*at.back, "runs", "best", F.col("collapsed").cast("string").alias("collapsed"))


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by their ids, repeat the words from a place on with a period; the others, and those without an id, stay."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row after ``periodic``."""
    rows = detect(df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)), text_col, periodic, id_col)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("best")
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
