"""WARC archives and a globally ordered capture index by external merge.

Each task writes its pages, ordered by id, as gzip members into archive files of bounded
size and, for each archive, a run: its captures sorted by (URL key, timestamp, page).
The manifest, a table of the archives that finished tasks have written, says what is
read back. Cut points taken from every run at regular steps bound each index range: at
most COARSE of them come to the driver, the finer ones between them stay in tables. A
run is cut at them and only whole slices travel: a merge task gets the slices of all
runs for its range and merges them with a loser tree. The ranges follow one another, so
that the index is ordered globally, also where one URL holds a third of all captures.

Of records with equal payloads of at least ``min_bytes``, the one with the largest
page id is a response and the others revisit it. Null html counts as an empty payload,
a null URL as empty, however long they are. Rows that repeat a page id are written each
(their record ids are then the same, as they name the page); rows without an id follow
the same rules, but never refer to each other. Other columns are left aside, whatever
their names. An empty table gives no rows. Files are renamed into place when whole,
named by their partition, so that a repeated task replaces them by equal content.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, lookup_join, new_path, written
from .token_store import put

#: An archive ends with the record that reaches so many compressed bytes.
ARCHIVE_BYTES = 16_000_000
#: Captures of an index range, about, and samples a range.
RANGE_CAPTURES, SAMPLES_A_RANGE = 50_000, 16
#: Ranges whose cut points come to the driver, and the samples these are taken from, at most.
COARSE, COARSE_SAMPLES = 256, 16_384
SLICE = 1 << 16
FIRST_CAPTURE = 1_577_836_800  # 2020-01-01, for tables without a time of capture


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of one site lie together."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].lower().rpartition("@")[2].partition(":")[0]
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (rest[cut:] or "/")


def stamp(seconds: int) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str, when: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit names the response and carries no payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {when}",
        "WARC-Target-URI: " + json.dumps(url)[1:-1],
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 5, mtime=0)


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, offset past the record) of the member at ``at``."""
    z, view, parts, end = zlib.decompressobj(31), memoryview(raw), [], at
    while not z.eof:
        # in slices: what lies past the member is copied, a slice of it at most
        if end >= len(view):
            raise ValueError(f"the record at {at} isn't whole")
        parts.append(z.decompress(view[end : end + SLICE]))
        end = min(len(view), end + SLICE)
    end, plain = end - len(z.unused_data), b"".join(parts)
    head, _, body = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])], end


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, the overall winner sits on top. One path of
    log2(k) matches replaces a winner; equal items come in order of their source."""

    def __init__(self, sources: list[Iterator]):
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [-1] * self.k
        winners = [-1] * (2 * self.k)
        for i in range(self.k):
            winners[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self):
        while (head := self.heads[self.top]) is not None:
            yield head
            i = self.top
            self.heads[i] = next(self.sources[i], None)
            node = (self.k + i) // 2
            while node:
                if self.losers[node] >= 0 and self._first(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.top = i


def decided(df: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int, when: Column | None) -> DataFrame:
    """(id, url, html, seconds, refers_to): which page each row revisits, null for responses."""
    at = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), (when if when is not None else FIRST_CAPTURE + F.coalesce(F.col(id_col).cast("long"), F.lit(0)) % 1_000_000_000).cast("long").alias("seconds"))
    at = at.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    size = F.octet_length("html")
    n = at.count()
    groups = at.where(size >= min_bytes).groupBy("sha").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = lookup_join(at, groups, "sha", "n", n)
    return out.select("id", "url", "html", "seconds", F.when((size >= min_bytes) & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write(pages: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives and runs; returns the manifest, a written table of each archive's (archive, captures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, parts, size, captures, done = None, 0, [], 0, [], []

        def flush():
            nonlocal k, parts, size, captures
            name = f"part-{part:06d}-{k:06d}"
            put(f"{out}/archives/{name}.warc.gz", b"".join(parts))
            captures.sort()
            put(f"{out}/runs/{name}.run", zlib.compress("\n".join(json.dumps(c) for c in captures).encode(), 1))
            done.append((name, len(captures)))
            k, parts, size, captures = k + 1, [], 0, []

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(5)[0].as_py()
            for page, url, html, seconds, refers in zip(*(batch.column(c).to_pylist() for c in range(5))):
                payload = html.encode("utf-8", "surrogatepass")
                when = stamp(seconds)
                r = record(page, url, when, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), refers)
                captures.append((url_key(url), when, -1 if page is None else page, f"part-{part:06d}-{k:06d}", size, len(r)))
                parts.append(r)
                size += len(r)
                if size >= archive_bytes:
                    flush()
        if parts:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "captures"])

    ordered = pages.withColumn("_h", F.xxhash64("url", "html")).sortWithinPartitions("id", "_h")
    at = ordered.select("id", "url", "html", "seconds", "refers_to", F.spark_partition_id().alias("part"))
    return written(at.mapInArrow(run, "archive string, captures bigint"), "manifest")


def _captures(raw: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(raw).split(b"\n") if x]


def _packed(captures: list[list]) -> bytes:
    return zlib.compress("\n".join(json.dumps(c) for c in captures).encode(), 1)


def _dealt(manifest: DataFrame, archives: int) -> DataFrame:
    """The manifest's names, a few for each task."""
    spread = 3 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("archive").repartition(max(1, min(archives, max(spread, archives // 16))), "archive")


def _content(url: str) -> bytes:
    store, path = filesystem(url)
    with store.open_input_file(path) as f:
        return f.read()


INDEX = "index_range int, place bigint, url_key string, captured string, page_id bigint, archive string, position bigint, bytes bigint"


def merged_index(manifest: DataFrame, out: str, range_captures: int = RANGE_CAPTURES, most_coarse: int = COARSE) -> DataFrame:
    """The capture index: rows of one range by ``place``, ranges in order, (URL key, timestamp, page id) ascending."""
    from bisect import bisect_left, bisect_right

    total, archives = manifest.agg(F.sum("captures"), F.count(F.lit(1))).first()
    ranges = max(1, -(-total // range_captures))
    coarse = min(ranges, most_coarse)
    fine = -(-ranges // coarse)
    step = max(1, total // (ranges * SAMPLES_A_RANGE))
    names, cuts = _dealt(manifest, archives), []
    key = "url_key string, captured string, page bigint"

    def sample(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                got = [c[:3] for c in _captures(_content(f"{out}/runs/{name}.run"))[step // 2 :: step]]
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["url_key", "captured", "page"])

    if ranges > 1:
        seen = written(names.mapInArrow(sample, key), "samples")
        n = seen.count()
        some = seen.where(F.pmod(F.xxhash64("url_key", "captured", "page"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, COARSE_SAMPLES / 2 / max(n, 1))))
        # about half of COARSE_SAMPLES at most; the limit guards the driver only against a hash that deals badly
        keys = sorted(tuple(r) for r in some.limit(COARSE_SAMPLES).collect())
        cuts = sorted({keys[len(keys) * i // coarse] for i in range(1, coarse)}) if keys else []

    def coarse_slices(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                got = _captures(_content(f"{out}/runs/{name}.run"))
                keys = [tuple(c[:3]) for c in got]
                at = [0, *(bisect_left(keys, c) for c in cuts), len(got)]
                rows = [(i, name, _packed(got[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary()))], names=["coarse", "archive", "slice"])

    dealt = names.mapInArrow(coarse_slices, "coarse int, archive string, slice binary")
    if fine > 1:
        # cut points within each coarse range, from all samples: they go with the slices of their range alone

        def coarse_of(batches):
            for batch in batches:
                at = [bisect_right(cuts, x) for x in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["coarse", "url_key", "captured", "page"])

        w = Window.partitionBy("coarse").orderBy("url_key", "captured", "page")
        placed = seen.mapInArrow(coarse_of, f"coarse int, {key}").withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("coarse")))
        place = lambda k: F.floor((k - 1) * fine / F.col("n"))
        firsts = placed.where((F.col("k") > 1) & (place(F.col("k")) > place(F.col("k") - 1)))
        finer = firsts.groupBy("coarse").agg(F.sort_array(F.collect_list(F.struct("url_key", "captured", "page"))).alias("cuts")).withColumnRenamed("coarse", "_coarse")
        dealt = dealt.join(finer, F.col("coarse") == F.col("_coarse"), "left").select("coarse", "archive", "slice", "cuts")

    def fine_slices(batches):
        for batch in batches:
            for c, name, raw, within in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not within:
                    rows = [(c * fine, name, raw)]
                else:
                    got = _captures(raw)
                    keys = [tuple(x[:3]) for x in got]
                    at = [0, *(bisect_left(keys, (x["url_key"], x["captured"], x["page"])) for x in within), len(got)]
                    rows = [(c * fine + i, name, _packed(got[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary()))], names=["index_range", "archive", "slice"])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("archive")
        rows = list(LoserTree([iter(_captures(s)) for s in t.column("slice").to_pylist()]))
        n, r = len(rows), t.column("index_range")[0].as_py()
        cols = list(zip(*rows))
        return pa.table(
            [pa.array([r] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(cols[0]), pa.array(cols[1]), pa.array([None if x < 0 else x for x in cols[2]], pa.int64()), pa.array(cols[3]), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
            names=["index_range", "place", "url_key", "captured", "page_id", "archive", "position", "bytes"],
        )

    if fine > 1:
        dealt = dealt.mapInArrow(fine_slices, "index_range int, archive string, slice binary")
    else:
        # coarse ranges are the index ranges: a second worker beside the first would only hand the slices on
        dealt = dealt.withColumnRenamed("coarse", "index_range")
    return dealt.groupBy("index_range").applyInArrow(merge, INDEX)


def read(manifest: DataFrame, out: str) -> DataFrame:
    """(archive, position, page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives.
    A response's length and digest are those of the payload as read; a revisit's are its header's."""

    def run(batches):
        ident = lambda s: None if s is None or s[10:-1] == "None" else int(s[10:-1])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                raw, at, rows = _content(f"{out}/archives/{name}.warc.gz"), 0, []
                while at < len(raw):
                    fields, payload, end = parse(raw, at)
                    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        length = len(payload)
                        if (seen := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
                            raise ValueError(f"{name} at {at}: payload {seen}, header {digest}")
                    rows.append((name, at, ident(fields["WARC-Record-ID"]), length, digest, fields["WARC-Type"], ident(fields.get("WARC-Refers-To"))))
                    at = end
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["archive", "position", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _dealt(manifest, manifest.count()).mapInArrow(run, "archive string, position bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, when: Column | None = None, archive_bytes: int = ARCHIVE_BYTES, range_captures: int = RANGE_CAPTURES, most_coarse: int = COARSE) -> DataFrame:
    """Writes archives and index to the shared folder and reads both back: each record with its place in the capture index."""
    spark = df.sparkSession
    out = new_path(spark, "warc")
    manifest = write(decided(df, id_col, url_col, html_col, min_bytes, when), out, archive_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, index_range int, place bigint")
    index = merged_index(manifest, out, range_captures, most_coarse).select("archive", "position", "index_range", "place")
    return index.join(read(manifest, out), ["archive", "position"]).select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "index_range", "place")
