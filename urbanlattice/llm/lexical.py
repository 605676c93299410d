"""Ranked lexical search with block-max pruning.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in the whole
text, A-Z in lower case. With N documents that have terms, L terms in all, n terms of a
document, df documents with a term and tf occurrences in a document:

    weight of a term   floor(1000 * ln((2 N + 2) / (2 df + 1)))
    impact of a term   (10**9 * tf) div (1000 * tf + 8 * (25 + (75 * n * N) div L))
    score              sum over the query's terms, repeats included, of weight * impact

all in 64-bit integers but for the logarithm.

The index holds one row for each block, a range of documents as they lie in the table, of
BLOCK_DOCS documents or BLOCK_BYTES of text: ids, the block's terms, each term's greatest
impact in the block, and a forward index (each document's terms and impacts). A search
sums weights times greatest impacts to a bound of each query in each block, sorts the
blocks by it, and scores blocks until the bound drops below the query's threshold, the
score of its k-th document so far. Blocks whose bound equals the threshold are scored, as
ties go by id. A first pass over the bounds alone finds each query's SEEDS best blocks;
their documents give the thresholds that all tasks start from.

Queries are taken in groups of QUERIES rows or QUERY_BYTES of text, which is what tasks
get sent. Every row counts by itself, queries and documents: repeated rows are ranked as
often as they occur, documents without an id after those with one. Null and empty texts
have no terms: such documents are in no result, such queries give no rows. Texts are
indexed whole; other columns are left aside, whatever their names. Empty tables give no
rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, quoted

#: Documents of a block, and bytes of text that a block of several documents may have.
BLOCK_DOCS, BLOCK_BYTES = 128, 2_000_000
#: Blocks of a task that are sorted together: bytes of index rows, about.
SORT_BYTES = 64_000_000
QUERIES, QUERY_BYTES = 2000, 4_000_000
#: Blocks and bytes of a row group: readers hold one whole, so that a task's memory doesn't go with its file.
GROUP_BLOCKS, GROUP_BYTES = 16, 16_000_000
SEEDS = 4
_term = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def terms(raw: bytes) -> list[bytes]:
    return _term(raw.lower())


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in documents of ``n`` terms, whose numbers are Python's where they could pass 64 bits."""
    if len(n) and int(n.max()) * 75 * docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)
    else:
        m = 25 + 75 * n.astype(np.int64) * docs // total
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[bytes]:
    for x in batch.column(k).cast(pa.binary()):
        yield x.as_py() or b""


def totals(df: DataFrame, text_col: str) -> tuple[int, int]:
    """(N, L)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        for batch in batches:
            for raw in _texts(batch, 0):
                n = len(terms(raw))
                docs, total = docs + (n > 0), total + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["d", "t"])

    r = df.select(F.col(quoted(text_col)).cast("string")).mapInArrow(run, "d bigint, t bigint").agg(F.sum("d"), F.sum("t")).first()
    return r[0] or 0, r[1] or 0


#: ids: null where a document has none; starts: of each document in ``at`` and ``impacts`` (4-byte numbers of terms, impacts).
BLOCK = "block bigint, terms array<binary>, dfs array<int>, best array<int>, ids array<bigint>, starts binary, at binary, impacts binary"


def _block(key: int, ids: list[int | None], texts: list[list[bytes]], docs: int, total: int) -> list:
    number: dict[bytes, int] = {}
    at, tf, sizes = [], [], []
    for words in texts:
        counts = Counter(words)
        at += [number.setdefault(w, len(number)) for w in counts]
        tf += counts.values()
        sizes.append(len(counts))
    at_, n = np.array(at, np.int32), np.repeat([len(w) for w in texts], sizes)
    got = impact(np.array(tf, np.int64), n, docs, total).astype(np.int32)
    best = np.zeros(len(number), np.int32)
    np.maximum.at(best, at_, got)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return [key, list(number), np.bincount(at_, minlength=len(number)), best, ids, starts.tobytes(), at_.tobytes(), got.tobytes()]


def index(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Writes the blocks of ``df``'s documents under ``path``; returns (N, L). Documents without terms are in no block."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n, total = totals(df, text_col)
    schema = to_arrow_schema(StructType.fromDDL(BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(_block(key, ids, texts, n, total), schema)], schema=schema)

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                if not (words := terms(raw)):
                    continue
                if len(ids) == BLOCK_DOCS or (ids and size + len(raw) > BLOCK_BYTES):
                    yield made()
                    key, ids, texts, size = key + 1, [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(raw)
        if ids:
            yield made()

    docs = df.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string"))
    small = {"parquet.block.row.count.limit": GROUP_BLOCKS, "parquet.block.size": GROUP_BYTES}
    docs.mapInArrow(run, BLOCK).write.options(compression="zstd", **small).parquet(path)
    return n, total


class Asked:
    """A group of queries: ``of[term]`` lists (query, weight times repeats)."""

    def __init__(self, queries: list[Counter], weight: dict[bytes, int], thresholds: list[int]):
        self.of: dict[bytes, list[tuple[int, int]]] = {}
        for q, words in enumerate(queries):
            for w, k in words.items():
                if weight.get(w):
                    self.of.setdefault(w, []).append((q, weight[w] * k))
        self.thresholds = thresholds

    def weights(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in ``words``, weight) of each query's terms among ``words``, by query."""
        rows = np.array([(q, k, x) for k, w in enumerate(words) if w in self.of for q, x in self.of[w]], np.int64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        return rows[:, 0], rows[:, 1], rows[:, 2]


def bounds(weights: tuple[np.ndarray, np.ndarray, np.ndarray], best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries with terms in a block, their bounds)."""
    q, at, x = weights
    if not len(q):
        return q, x
    first = np.flatnonzero(np.diff(q, prepend=-1))
    return q[first], np.add.reduceat(x * best[at].astype(np.int64), first)


def _values(x) -> np.ndarray:
    return x.values.to_numpy()


def _numbers(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32)


def scores(block: tuple, q: int) -> np.ndarray:
    """Query ``q``'s score of each document of a block."""
    (of, place, x), best, _, starts, at, impacts = block
    mine = slice(*np.searchsorted(of, (q, q + 1)))
    weight = np.zeros(len(best), np.int64)
    weight[place[mine]] = x[mine]
    return np.add.reduceat(weight[at] * impacts, starts[:-1])


def _searcher(asked: Asked, k: int):
    """Scores a task's blocks in groups of SORT_BYTES; gives each query's ``k`` best documents of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list[tuple]] = {}  # of each query, best first: (-score, no id, id)

        def least(q: int) -> int:
            mine = top.get(q, ())
            return max(asked.thresholds[q], -mine[-1][0] if len(mine) == k else 0)

        def score(blocks: list[tuple]) -> None:
            todo: dict[int, list[tuple[int, int]]] = {}
            for b, (weights, best, *_) in enumerate(blocks):
                for q, bound in zip(*(c.tolist() for c in bounds(weights, best))):
                    if bound >= least(q):
                        todo.setdefault(q, []).append((-bound, b))
            for q, order in todo.items():
                for minus, b in sorted(order):
                    if -minus < least(q):
                        break
                    got, ids = scores(blocks[b], q), blocks[b][2]
                    for d in np.flatnonzero(got >= max(1, least(q))).tolist():
                        top.setdefault(q, []).append((-int(got[d]), ids[d] is None, ids[d] or 0))
                    if q in top:
                        top[q] = sorted(top[q])[:k]

        held, size = [], 0
        for batch in batches:
            words, best, ids, *raw = (batch.column(batch.schema.get_field_index(c)) for c in ("terms", "best", "ids", "starts", "at", "impacts"))
            for r in range(batch.num_rows):
                block = (asked.weights(words[r].as_py()), _values(best[r]), ids[r].as_py(), *[_numbers(c[r]) for c in raw])
                held.append(block)
                size += block[1].nbytes + sum(a.nbytes for a in (*block[0], *block[3:]))
                if size >= SORT_BYTES:
                    score(held)
                    held, size = [], 0
        score(held)
        rows = [(q, -s, None if none else i) for q, mine in top.items() for s, none, i in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["q", "score", "id"])

    return run


def _bounder(asked: Asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for key, words, best in zip(*(batch.column(c) for c in range(3))):
                for q, bound in zip(*(c.tolist() for c in bounds(asked.weights(words.as_py()), _values(best)))):
                    mine = top.setdefault(q, [])
                    mine.append((-bound, key.as_py()))
                    if len(mine) > 4 * SEEDS:
                        top[q] = sorted(mine)[:SEEDS]
        rows = [(q, -s, b) for q, mine in top.items() for s, b in sorted(mine)[:SEEDS]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["q", "bound", "block"])

    return run


def _first(rows: DataFrame, k: int, order: list) -> DataFrame:
    """The first ``k`` rows of each query, chosen in parts before all parts meet."""
    for keys in (["q", "_part"], ["q"]):
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = (rows.withColumn("_part", F.spark_partition_id() % 64) if "_part" in keys else rows).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return rows.drop("_part")


def _group(blocks: DataFrame, queries: list[Counter], k: int, docs: int) -> DataFrame:
    """(q, score, id, _rank) of a group of queries."""
    spark = blocks.sparkSession
    vocabulary = sorted({w for q in queries for w in q})
    words = spark.createDataFrame([(bytearray(w),) for w in vocabulary], "term binary")
    df_of = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.dfs").alias("n")).join(F.broadcast(words), "term").groupBy("term").agg(F.sum("n").alias("n"))
    weight = {bytes(r["term"]): math.floor(1000 * math.log((2 * docs + 2) / (2 * r["n"] + 1))) for r in df_of.collect()}
    asked = Asked(queries, weight, [0] * len(queries))
    order = lambda value, name: [F.desc(value), F.asc_nulls_last(name)]
    best = blocks.select("block", "terms", "best").mapInArrow(_bounder(asked), "q int, bound bigint, block bigint")
    seeds = sorted({r["block"] for r in _first(best, SEEDS, order("bound", "block")).collect()})
    columns = ["terms", "best", "ids", "starts", "at", "impacts"]
    some = blocks.where(F.col("block").isin(seeds)).select(*columns).mapInArrow(_searcher(asked, k), "q int, score bigint, id bigint")
    for r in _first(some, k, order("score", "id")).where(F.col("_rank") == k).collect():
        asked.thresholds[r["q"]] = r["score"]
    found = blocks.select(*columns).mapInArrow(_searcher(asked, k), "q int, score bigint, id bigint")
    return _first(found, k, order("score", "id"))


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, rank from 1, id, score): each query's ``k`` best documents of ``df`` with a score above 0."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "blocks")
    docs, _ = index(df, path, id_col, text_col)
    blocks = spark.read.schema(BLOCK).parquet(path)
    rows = queries.select(F.col(quoted(query_id)).alias("i"), F.col(quoted(query_text)).cast("string").alias("t"))
    kind = dict(rows.dtypes)["i"]
    schema = f"`{query_id}` {kind}, rank int, `{id_col}` bigint, score bigint"
    results: list[DataFrame] = []
    names: list = []
    group: list[Counter] = []
    size = 0

    def close() -> None:
        nonlocal names, group, size
        if group:
            of = spark.createDataFrame(list(enumerate(names)), f"q int, _name {kind}")
            got = _group(blocks, group, k, docs).join(F.broadcast(of), "q")
            results.append(got.select(F.col("_name").alias(query_id), F.col("_rank").alias("rank"), F.col("id").alias(id_col), "score"))
        names, group, size = [], [], 0

    for r in rows.toLocalIterator():
        words = Counter(terms((r["t"] or "").encode("utf-8", "replace")))
        if not words:
            continue
        names.append(r["i"])
        group.append(words)
        size += len(r["t"])
        if len(group) == QUERIES or size >= QUERY_BYTES:
            close()
    close()
    out = results[0] if results else spark.createDataFrame([], schema)
    for more in results[1:]:
        out = out.unionByName(more)
    return out
