"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Words [^\\x20\\x09-\\x0D]+ in lower case give shingles of five (fewer words: the whole
sequence as one). Each shingle is hashed once; the top 7 bits choose one of 128 bins,
each bin keeps its least hash. An empty bin b is filled by optimal densification: it
tries the bins that a sequence of universal hashes of b names, and borrows from the
first full one. How many tries the sequence of b needs to reach bin j is a table, so
that the lender is the full bin of the fewest tries. The low 4 bits of each bin are kept: 512 bits as 128 hexadecimal digits. Two such fingerprints agree by chance in
1/16 of the bins, so that with a share P of equal bins the likeness is
(P - 1/16) / (1 - 1/16), at least 0.

A text without words has the fingerprint "": likeness 1 to another such text and 0 to
any other. Null text counts as empty. ``with_next`` orders rows by (id, text), null
ids first; the last row is followed by the first, a lone row by itself. Repeated rows
follow one another. Rows of one id (or of none) lie in one range, which one task sorts
and may spill; ids are meant to be all but unique. Texts are read whole, however long.
Other columns are left aside, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, text_or_empty
from .quality import window_hashes, words_of

BINS, BITS, SHINGLE = 128, 4, 5
_EACH_LOW = 0x1111111111111111
_NULL_ID = -(1 << 63)


def tries() -> list[int]:
    """At b * BINS + j: the number of the first try t at which ((a_t * b + c_t) mod 8191) mod BINS is j."""
    out = []
    for b in range(BINS):
        first: dict[int, int] = {}
        t = 0
        while len(first) < BINS:
            first.setdefault(((7919 * (t + 1) % 8191) * b + 4973 * (t + 2) ** 2) % 8191 % BINS, t)
            t += 1
        out += [first[j] for j in range(BINS)]
    return out


TRIES = tries()


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds ``name``: the packed fingerprint, an array of 8 longs, empty for a text without words. ``text_col``: not null."""
    keep = df.columns
    df = hold(df, "_w", words_of(F.lower(F.col(text_col))))
    df = hold(df.select(*keep, "_w"), "_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    shingles = F.when(n >= SHINGLE, window_hashes(F.col("_h"), SHINGLE)).when(n > 0, F.array(F.xxhash64(F.lit(n), F.col("_h")))).otherwise(F.array().cast("array<bigint>"))
    df = hold(df.select(*keep, "_h"), "_s", F.sort_array(shingles))
    bin_of = lambda h: F.shiftrightunsigned(h, 57).cast("int")
    first = F.filter("_s", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col("_s"), i - 1))))
    df = hold(df.select(*keep, "_s"), "_least", first)
    df = hold(df.select(*keep, "_least"), "_bins", F.transform("_least", bin_of))
    all_bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    place = F.transform(all_bins, lambda b: F.array_position("_bins", b).cast("int"))
    df = hold(df, "_filled", F.transform(place, lambda p: F.when(p > 0, F.get("_least", p - 1))))
    # one literal, which the optimizer splits once, instead of one for each number
    first = F.split(F.lit(",".join(map(str, TRIES))), ",").cast("array<int>")
    lender = lambda b: F.array_min(F.transform("_bins", lambda j: F.get(first, b * BINS + j) * BINS + j)).bitwiseAND(BINS - 1)
    filled = F.transform("_filled", lambda h, b: F.coalesce(h, F.get("_filled", lender(b))))
    df = hold(df, "_low", F.transform(filled, lambda h: h.bitwiseAND((1 << BITS) - 1)))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), lambda g: F.aggregate(F.slice("_low", g * 16 + 1, 16), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x)))
    out = F.when(F.size("_bins") > 0, packed).otherwise(F.array().cast("array<bigint>"))
    return hold(df, name, out).select(*keep, name)


def as_string(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated resemblance of two packed fingerprints."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(_EACH_LOW)))

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    raw = ((BINS - unlike) / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), raw))


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most ``key``: a coarse look first, then one slice."""
    step = max(1, int(len(cuts) ** 0.5))
    if not cuts:
        return F.lit(0)
    array = lambda xs: F.lit(list(xs)).cast("array<bigint>")
    coarse = F.size(F.filter(array(cuts[::step]), lambda c: c <= key))
    start = F.greatest(coarse - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(array(cuts), start + 1, step), lambda c: c <= key))


def with_next(df: DataFrame, key: str, order: list[str], values: dict[str, str], buckets: int, derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Adds to each row values of the next row in order of ``key`` (long, not null) and ``order``; after the last comes the first.

    Rows are dealt into ranges of the key. Each range also gets a copy of the next range's first row, so that a window over
    a range sees every successor. The ranges' cuts and first keys come to the driver: ``buckets`` numbers.

    ``derive`` adds costly columns, of which ``values`` may name some: it runs once, after the passes that find the ranges."""
    share = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, share, 20 * buckets).alias("c")).first()["c"] if share else []
    cuts = sorted(set(found or []))
    at = df.withColumn("_bucket", bucket_of(F.col(key), cuts))
    firsts = sorted((r["_bucket"], r["k"]) for r in at.groupBy("_bucket").agg(F.min(key).alias("k")).collect())
    if not firsts:
        return derive(at).select("*", *[F.col(c).alias(n) for c, n in values.items()]).drop("_bucket")
    # the first row of range i+1 closes range i; that of the first range closes the last
    closes = {firsts[(i + 1) % len(firsts)][1]: b for i, (b, _) in enumerate(firsts)}
    keys = F.lit(sorted(closes)).cast("array<bigint>")
    owner = F.lit([closes[k] for k in sorted(closes)]).cast("array<int>")
    # one row for each of these keys: the least in order
    least = df.where(F.col(key).isin(sorted(closes))).groupBy(key).agg(F.min(F.struct(*order, *[c for c in values if c in df.columns and c not in order])).alias("_v"))
    ends = least.select(F.col("_v.*"), F.get(owner, (F.array_position(keys, F.col(key)) - 1).cast("int")).alias("_bucket"), F.lit(1).alias("_end"))
    rows = derive(at.withColumn("_end", F.lit(0)).unionByName(ends, allowMissingColumns=True))
    w = Window.partitionBy("_bucket").orderBy("_end", key, *order)
    return rows.select("*", *[F.lead(c).over(w).alias(n) for c, n in values.items()]).where("_end = 0").drop("_bucket", "_end")


def near_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last quarter replaced by the start of the next document."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_key", F.coalesce("_id", F.lit(_NULL_ID)))
    buckets = max(8, min(20_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at = with_next(docs, "_key", ["_text"], {"_text": "_next", "_fp": "_next_fp"}, buckets, lambda rows: with_fingerprint(rows, "_text", "_fp"))
    n = F.char_length("_text")
    quarter = F.floor(n / 4).cast("int")
    at = hold(at, "_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - quarter), F.substring(F.col("_next"), F.lit(1), quarter)))
    at = at.select("_id", n.cast("long").alias("n_chars"), "_fp", "_next_fp", "_edited", F.sha2("_edited", 256).alias("edited_sha256"))
    at = with_fingerprint(at, "_edited", "_edited_fp")
    return at.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_string(F.col("_fp")).alias("fingerprint"),
        as_string(F.col("_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"),
        likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )
