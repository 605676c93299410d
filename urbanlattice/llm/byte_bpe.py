"""Byte-level BPE by a segment tree over byte positions.

Each leaf holds the rank of the pair that starts at that live byte position; inner
nodes hold the least rank, leftmost on ties. A merge takes the root, joins the pair
and its right neighbour, and updates the at most three leaves that changed, each in
O(log n). Runs of any length therefore encode in O(n log n).

Texts are cut at single spaces before the public token pattern, where that can't change
its matches; other patterns see whole texts. What a worker has encoded is cached by
piece. Null or empty text: no ids. Rows are encoded each by their own text: repeated
rows, and rows that share an id or have none, give as many results. Texts are read
whole, however long. Other columns are left aside, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

CACHE_PIECES = 700_000
NONE = 1 << 40
_codecs: dict[tuple[str, str], "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the token pattern."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    # a node is rank * size + position, so that the least is the leftmost of the least rank
    tree = [NONE * size] * (2 * size)
    end = list(range(1, n + 1))  # where the live token that starts here ends
    prev = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    none = NONE * size

    def put(i: int, v: int) -> None:
        i += size
        tree[i] = v
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            v = a if a < b else b
            if tree[i] == v:
                return
            tree[i] = v

    while (top := tree[1]) < none:
        i = top % size
        j = end[i]
        e = end[i] = end[j]
        put(j, none)
        if e < n:
            prev[e] = i
            r = get(piece[i : end[e]])
            put(i, none if r is None else r * size + i)
        else:
            put(i, none)
        if (p := prev[i]) >= 0:
            r = get(piece[p:e])
            put(p, none if r is None else r * size + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex

        self.cut = pattern == public_tokenizers.PATTERN
        self.ranks = read_ranks(path)
        self.bytes_of = {str(r): b for b, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        # a space that doesn't end a run of white space of its own
        self.unsafe = re.compile(r"\s (?:\s|$)|  ").search
        self.words: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def _match(self, m: str) -> str:
        if (got := self.words.get(m)) is None:
            if len(self.words) >= CACHE_PIECES:
                self.words.clear()
            got = ",".join(map(str, merge(m.encode("utf-8", "replace"), self.ranks)))
            if len(m) <= 64:
                self.words[m] = got
        return got

    def _piece(self, p: str) -> str:
        got = ",".join(map(self._match, self.find(p)))
        if len(p) <= 64:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            self.pieces[p] = got
        return got

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if not self.cut or self.unsafe(text):
            return ",".join(map(self._match, self.find(text)))
        pieces, first = self.pieces, text.split(" ")
        rest = [" " + p for p in first[1:]]
        if first[0]:
            rest.insert(0, first[0])
        return ",".join([pieces[p] if p in pieces else self._piece(p) for p in rest])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text."""
    import numpy as np

    def make():
        c = codec(path, pattern)

        def f(batch: pa.RecordBatch):
            got = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            return [batch.column(0), pa.array([np.array(g.split(","), np.int32) if g else np.zeros(0, np.int32) for g in got], pa.list_(pa.field("element", pa.int32())))]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>", [id_col, "ids"])


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes of each row's ids."""

    def make():
        c = codec(path, pattern)

        def f(batch: pa.RecordBatch):
            return [batch.column(0), [c.decode(",".join(map(str, x or []))) for x in batch.column(1).to_pylist()]]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, ids_col), make, f"`{id_col}` {kind}, bytes binary", [id_col, "bytes"])


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded in one pass, without moving the ids."""

    def make():
        c = codec(path, pattern)

        def f(batch: pa.RecordBatch):
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [batch.column(0), n, a, b]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", names)
