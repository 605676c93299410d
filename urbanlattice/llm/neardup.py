"""Near-duplicates: MinHash bands find candidates, odd sketches sift them, full sets confirm them.

A document's set holds its distinct shingles of words [^\\x20\\x09-\\x0D]+, A-Z in lower
case. Rows with equal sets form a class. Each class gets 150 MinHash samples: 30 bands
of 5 are the bucket keys (a pair of likeness 0.8 misses all bands in 7 of a million
cases), and all samples fold into an odd sketch, a bitmap of 512 parities. The XOR of
two odd sketches has few ones if many samples agree, and tells likenesses above 0.6
apart precisely.

No bucket is expanded into its pairs:

1. each bucket's members are compared with its least one, which joins most groups of
   copies at once;
2. buckets that still hold several components are compared block by block on sketches,
   in vectorised tasks of bounded size. A task passes on the closest pairs that would
   join its components (a forest: fewer pairs than members) and says whether it held
   more back;
3. buckets that held pairs back and still hold several components get a second pass,
   whose tasks have the texts too: every pair in different components whose sketches
   allow the threshold is confirmed in its first common bucket, and one link of two
   components is passed on.

So every candidate pair is either inside one component already or compared. All links
rest on full sets; sizes and components follow from them. Joins on keys that a group
may fill are spread (``common.spread_join``).

Every row is a document of its own, also where ids repeat or are null. Null and empty
texts, and texts without a word, have no set: linked with nothing. A component's id is
the least id of its rows, null ids coming last; a group whose ids are all null has
none. Texts are read whole, in pieces of bounded size. An empty table gives no rows;
columns to be kept may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_beside, maybe_in, quoted, scratch, spread_join, written
from .graph import components

BANDS, ROWS, SKETCH_BITS = 30, 5, 512
SAMPLES = BANDS * ROWS
#: Members of a block that is compared with another in one task, and the shingles they may have together, about.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Bytes of text that are hashed at once.
SEGMENT = 1 << 18

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SEGMENT + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from differences of running sums."""
    power, inverse = _tables()
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + SEGMENT)
        part = b[at:end]
        word = ~_SPACE[part]
        if end < len(b):
            if word.all():  # a word longer than a segment: its polynomial piece by piece
                stop = end
                while stop < len(b) and not (gaps := np.flatnonzero(_SPACE[b[stop : stop + SEGMENT]])).size:
                    stop = min(len(b), stop + SEGMENT)
                if stop < len(b):
                    stop += int(gaps[0])
                h = 0
                for s in range(at, stop, SEGMENT):
                    piece = _BYTE[b[s : min(s + SEGMENT, stop)]]
                    h += int((piece * power[: len(piece)]).sum(dtype=np.uint64)) * pow(_BASE, s - at, 1 << 64)
                out.append(np.array([h % (1 << 64)], np.uint64))
                at = stop
                continue
            end = at + int(np.flatnonzero(~word)[-1]) + 1
            part, word = b[at:end], word[: end - at]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.r_[0, edge]
        if len(edge) % 2:
            edge = np.r_[edge, len(word)]
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        out.append((sums[ends] - sums[starts]) * inverse[starts])
        at = end
    return _mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles; of the whole sequence if it has fewer words."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    take = min(size, len(h))
    out = np.full(len(h) - take + 1, take, np.uint64)
    for k in range(take):
        out *= _P1
        out += h[k : len(h) - take + 1 + k]
    return np.unique(_mix(out))


_A = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def samples(s: np.ndarray) -> np.ndarray:
    """The least of each of 150 32-bit hashes over the set (not empty)."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024, None] * _A
        part += _B
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x9E3779B1)
        np.minimum(best, part.min(0), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket keys of (documents, SAMPLES) samples."""
    k = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(m), BANDS))
    for r in range(ROWS):
        k = _mix(k * _P1 + m.reshape(len(m), BANDS, ROWS)[:, :, r] + _P3)
    return k.view(np.int64)


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """(documents, 8) words of parities: each sample, tagged by its number, flips one of 512 bits."""
    bit = (_mix(m + np.arange(SAMPLES, dtype=np.uint64) * _P1) >> np.uint64(55)).astype(np.int64)
    bit += np.arange(len(m))[:, None] * SKETCH_BITS
    odd = np.bincount(bit.ravel(), minlength=len(m) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(m), SKETCH_BITS // 64)


def most_ones(threshold: float) -> int:
    """XOR population count that a pair at the threshold stays below: its mean and five deviations of samples and parities together."""
    apart = SAMPLES * (1 - threshold) + 1
    still = (1 - 2 / SKETCH_BITS) ** (2 * apart)
    # a sample that differs flips a bit in each of the two sketches
    samples_dev = 2 * still * math.sqrt(SAMPLES * threshold * (1 - threshold))
    return math.ceil(SKETCH_BITS / 2 * (1 - still) + 5 * math.hypot(samples_dev, math.sqrt(SKETCH_BITS) / 4))


def estimate(ones: int) -> float:
    """Likeness from an XOR population count."""
    if 2 * ones >= SKETCH_BITS:
        return 0.0
    return max(0.0, 1 - math.log(1 - 2 * ones / SKETCH_BITS) / math.log(1 - 2 / SKETCH_BITS) / (2 * SAMPLES))


def _lists(values: np.ndarray, full: np.ndarray) -> pa.Array:
    """A list column: a row of ``values`` for each true of ``full``, an empty list for the others."""
    offsets = np.concatenate([[0], np.cumsum(full * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), pa.list_(pa.field("element", pa.int64())))


def with_sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """``df`` with n_shingles, digest, keys and sketch beside its columns; no digest and empty arrays for an empty set."""

    def make():
        def f(batch: pa.RecordBatch):
            texts = batch.column(batch.schema.get_field_index(text))
            n, digests, found = np.zeros(len(texts), np.int64), [], []
            for i, t in enumerate(texts):
                s = shingle_set(t.as_py(), size)
                n[i] = len(s)
                digests.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                if len(s):
                    found.append(samples(s))
            m = np.array(found, np.uint64).reshape(-1, SAMPLES)
            return [pa.array(n), digests, _lists(band_keys(m), n > 0), _lists(odd_sketches(m), n > 0)]

        return f

    return map_beside(df, make, "n_shingles bigint, digest binary, keys array<bigint>, sketch array<bigint>")


def sifted(pairs: DataFrame, sketches: DataFrame, most: int, rows: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose sketches allow the threshold; many pairs may share their b."""
    one, two = (sketches.select(F.col("id").alias(n), F.col("sketch").alias(f"s{n}")) for n in "ab")
    ones = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    at = spread_join(pairs.join(one, "a"), two, "b", pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), rows)
    return at.where(ones <= most).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: int, rows: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets have 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(k) for k in range(4))):
                if last != (y := y.as_py()):  # rows often share their second document
                    last, kept = y, shingle_set(t.as_py(), size)
                one = shingle_set(s.as_py(), size)
                both = len(np.intersect1d(one, kept, assume_unique=True))
                if 100 * both >= threshold * (len(one) + len(kept) - both):
                    a.append(x.as_py()), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    one, two = (texts.select(F.col("id").alias(n), F.col("text").alias(f"t{n}")) for n in "ab")
    at = spread_join(pairs.join(one, "a"), two, "b", pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), rows)
    return at.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def blocked(mixed: DataFrame, *more: str) -> DataFrame:
    """Rows (key, main, first, rest, id, comp, sketch, more) dealt out so that any two of a bucket in different components meet in the
    task of (key, lo, hi).

    Members of the bucket's largest component, ``main``, are in ``first`` blocks that meet the ``rest`` blocks of the others
    alone: they needn't meet each other, so that few strays beside a large component cost no square of its size."""
    own, h = F.col("comp") == F.col("main"), F.xxhash64("id")
    first, rest = F.col("first").cast("int"), F.col("rest").cast("int")
    at = mixed.withColumn("mine", F.when(own, F.pmod(h, first)).otherwise(first + F.pmod(h, rest)).cast("int"))
    others = F.sequence(F.when(own, first).otherwise(F.lit(0)), first + rest - 1)
    at = at.select("key", "id", "comp", "sketch", *more, "mine", F.explode(others).alias("other"))
    at = at.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    return at.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id").select("key", "lo", "hi", "mine", "id", "comp", "sketch", *more)


def block_pairs(ids, comps, sketches, mine, lo, hi, most) -> Iterator[tuple]:
    """(i, j, ones) of a block's pairs in different components whose sketches allow the threshold."""
    left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    for s in range(0, len(left), 128):
        rows = left[s : s + 128]
        apart = comps[rows][:, None] != comps[right][None, :]
        if lo == hi:
            apart &= ids[rows][:, None] < ids[right][None, :]
        if not apart.any():
            continue
        ones = np.zeros(apart.shape, np.uint16)
        for k in range(sketches.shape[1]):
            ones += np.bitwise_count(sketches[rows, k][:, None] ^ sketches[right, k][None, :])
        i, j = np.nonzero(apart & (ones <= most))
        yield rows[i], right[j], ones[i, j]


def each_block(batches: Iterator[pa.RecordBatch], group, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``group(key, lo, hi, mine, ids, comps, sketches, rest)`` of each block pair with several components: about 2 * BLOCK rows."""
    key, rows = None, []

    def flush() -> list:
        if len(rows) < 2:
            return []
        mine, ids, comps = (np.array([r[k] for r in rows]) for k in range(3))
        if (comps == comps[0]).all():
            return []
        return list(group(*key, mine, ids, comps, np.array([r[3] for r in rows], np.int64).view(np.uint64), [r[4:] for r in rows]))

    out = lambda got: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], names=names)
    for batch in batches:
        got = []
        for x, lo, hi, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if key != (x, lo, hi):
                got += flush()
                key, rows = (x, lo, hi), []
            rows.append(row)
        if got:
            yield out(got)
    if got := flush():
        yield out(got)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b), taken in their order, that join two trees of those taken before."""
    parent = {x: x for x in np.union1d(a, b).tolist()}
    trees, taken = len(parent), []

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            taken.append(k)
            trees -= 1
            if trees == 1:
                break
    return np.array(taken, np.int64)


def close_pairs(mixed: DataFrame, most: int) -> DataFrame:
    """Of a block's pairs whose sketches allow the threshold, closest first, those that join components: (a, b, key, cut).
    cut: the block held more back."""

    def group(key, lo, hi, mine, ids, comps, sketches, _):
        found = list(block_pairs(ids, comps, sketches, mine, lo, hi, most))
        if not found:
            return
        i, j, ones = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            return
        order = np.lexsort((ids[j], ids[i], ones))
        i, j = i[order], j[order]
        kept = forest(comps[i], comps[j])
        cut = np.full(len(kept), len(kept) < len(i))
        i, j = i[kept], j[kept]
        yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.full(len(i), key), cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, group, ["a", "b", "key", "cut"])

    return blocked(mixed).mapInArrow(run, "a bigint, b bigint, key bigint, cut boolean")


def exact_links(mixed: DataFrame, most: int, size: int, threshold: int) -> DataFrame:
    """A confirmed pair (a, b) of each two components of a block that have one; ``mixed`` has keys and text too."""

    def group(key, lo, hi, mine, ids, comps, sketches, rest):
        keys, sets = np.array([r[0] for r in rest]), [shingle_set(r[1], size) for r in rest]
        n = np.array([len(x) for x in sets])
        joined: set[tuple[int, int]] = set()
        for i, j, _ in block_pairs(ids, comps, sketches, mine, lo, hi, most):
            # sizes must allow the threshold; other common buckets leave the pair to the first
            fits = 100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            for x in np.unique(i):
                y = j[i == x]
                same = keys[x] == keys[y]
                for k in y[keys[x][same.argmax(1)] == key]:
                    two = (min(comps[x], comps[k]), max(comps[x], comps[k]))
                    if two in joined:
                        continue
                    both = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                    if 100 * both >= threshold * (n[x] + n[k] - both):
                        joined.add(two)
                        yield np.array([ids[x]]), np.array([ids[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, group, ["a", "b"])

    return blocked(mixed, "keys", "text").mapInArrow(run, "a bigint, b bigint").distinct()


def linked(df: DataFrame, id_col: str, text_col: str, size: int, threshold: int, columns: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(sets, classes, rows): ``sets`` has a row number, id, n_shingles and digest of each row of ``df`` beside its
    ``columns`` (as k0, k1, ...); ``classes`` has each digest's rows n and the component's best row (its ``best.row``, ``best.id``)."""
    with scratch() as keep:
        return _linked(df, id_col, text_col, size, threshold, columns, keep)


def _linked(df, id_col, text_col, size, threshold, columns, keep) -> tuple[DataFrame, DataFrame, int]:
    most = most_ones(threshold / 100)
    kinds = dict(df.dtypes)
    text = f"k{columns.index(text_col)}" if text_col in columns and kinds[text_col] == "string" else "text"
    docs = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).cast("long").alias("id"), *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(columns)],
        *([F.col(quoted(text_col)).cast("string").alias("text")] if text == "text" else []),
    )
    # row numbers hold from here on, for they are written with what they number
    sets = written(with_sets(docs, text, size), "sets")
    full = sets.where("digest IS NOT NULL")
    # equal sets have equal keys and sketches
    own = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = written(full.groupBy("digest").agg(F.min(own).alias("best"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("w")), "classes")
    found = classes.agg(F.sum("n"), F.count(F.lit(1))).first()
    rows, reps = found[0] or 0, found[1]
    bodies = classes.select(F.col("best.row").alias("id"), "keys", "sketch", "w")
    sketches = bodies.select("id", "sketch")
    keys = bodies.select("id", F.explode("keys").alias("key"))
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).where("n > 1"), "sizes", BANDS * reps)
    active = written(spread_join(keys, sizes.select("key", "leader"), "key", sizes, BANDS * reps), "buckets", BANDS * reps)
    # most texts are in no bucket with others: they are told by bits, and only the rest is moved to meet its id
    ids = written(active.select("id").distinct(), "ids", reps)
    texts = maybe_in(sets.select(F.col("row").alias("id"), F.col(text).alias("text")), ids, "id").where("_maybe").drop("_maybe")
    texts = written(texts.join(ids, "id", "left_semi"), "texts")

    pairs = written(active.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "pairs", reps)
    n = pairs.count()
    links = written(confirmed(written(sifted(pairs, sketches, most, n), "sifted", n), texts, size, threshold, n), "links")
    roots = components(links)

    def mixed(roots: DataFrame, of: DataFrame) -> DataFrame:
        """Members with their component, of the buckets with several, with the largest component of each bucket and the numbers
        of blocks of its members and of the others."""
        at = written(of.join(roots, of["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("comp")), "members", BANDS * reps)
        several = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("most")).where("n > most.m")
        blocks = lambda m: F.ceil(m / BLOCK)
        several = written(several.select("key", "n", F.col("most.comp").alias("main"), blocks(F.col("most.m")).alias("first"), blocks(F.col("n") - F.col("most.m")).alias("rest")), "mixed", BANDS * reps)
        return spread_join(at, several.select("key", "main", "first", "rest"), "key", several, at.count())

    close = written(close_pairs(mixed(roots, active).join(sketches, "id"), most), "close")
    more = close.select("a", "b").distinct()
    more = written(confirmed(more, texts, size, threshold, close.count()), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    cut = written(close.where("cut").select("key").distinct(), "cut", reps)
    if not cut.isEmpty():
        held = mixed(roots, active.join(cut, "key", "left_semi")).join(bodies.select("id", "keys", "sketch", "w"), "id")
        held = written(held, "held")
        # texts come in, so that blocks are bounded by shingles too
        own = F.col("comp") == F.col("main")
        at_least = lambda c, mine: F.greatest(F.first(c), F.coalesce(F.ceil(F.sum(F.when(mine, F.col("w"))) / BLOCK_SHINGLES), F.lit(1))).alias(c)
        weights = held.groupBy("key").agg(at_least("first", own), at_least("rest", ~own), F.count(F.lit(1)).alias("n"))
        held = spread_join(held.drop("first", "rest"), weights.drop("n"), "key", weights, held.count())
        more = written(exact_links(held.join(texts, "id"), most, size, threshold), "links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    at = classes.select("digest", "best", "n").join(roots, F.col("best.row") == roots["node"], "left").select("digest", "best", "n", F.coalesce("root", "best.row").alias("root"))
    at = written(at, "rooted", reps)
    of = at.groupBy("root").agg(F.min("best").alias("of"), F.count(F.lit(1)).alias("n"))
    named = written(spread_join(at, of.select("root", "of"), "root", of, reps).select("digest", "n", F.col("best.row").alias("rep"), F.col("of").alias("best")), "named", reps)
    return keep(sets), keep(named), rows


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``df``."""
    sets, classes, rows = linked(df, id_col, text_col, size, threshold, [])
    full = spread_join(sets.where("digest IS NOT NULL").select("row", "id", "n_shingles", "digest"), classes.select("digest", "best"), "digest", classes, rows)
    none = sets.where("digest IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return full.select("id", "n_shingles", F.col("best.id").alias("component_id")).unionByName(none).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``df`` without those linked to a row of lesser id (or of equal id, or none, and lesser place)."""
    sets, classes, rows = linked(df, id_col, text_col, size, threshold, df.columns)
    # a class's representative stays if it is its component's best row; other rows of the class go
    full = sets.where("digest IS NOT NULL")
    gone = written(classes.where("rep != best.row").select(F.col("rep").alias("row")), "gone", rows)
    # rows of classes of one row and without links, most of all, are told by bits and don't move
    asked = maybe_in(maybe_in(full, gone, "row").withColumnRenamed("_maybe", "_gone"), written(classes.where("n > 1").select("digest"), "copied", rows), "digest")
    alone = asked.where("NOT _gone AND NOT _maybe")
    rest = asked.where("_gone OR _maybe")
    best = classes.select(F.col("best.row").alias("row")).distinct()
    names = [f"k{i}" for i in range(len(df.columns))]
    kept = alone.select(*names).unionByName(rest.join(best, "row", "left_semi").select(*names)).unionByName(sets.where("digest IS NULL").select(*names))
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)])
