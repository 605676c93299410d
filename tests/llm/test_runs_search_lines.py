"""Runs of words, ranked search and shared lines against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

sha = lambda b: hashlib.sha256(b).hexdigest()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROW = "doc_id bigint, text string, block bigint, terms string, best string, runs string, _text string, _id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y", "z", "t", "u") for i, t in rows], ROW)


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    out = []
    for _ in range(rng.randrange(7)):
        p = [rng.choice("abcdefgh"[: rng.choice((1, 2, 3, 8))]) for _ in range(rng.randrange(1, 20))]
        out += (p * rng.randrange(1, 12))[: rng.randrange(1, 150)]
    return out


def test_runs_of_a_suffix_tree():
    from urbanlattice.llm import runs as R

    rng = random.Random(11)
    for _ in range(150):
        texts = [[w.encode() for w in periodic_words(rng)] for _ in range(rng.randrange(1, 5))]
        assert R.find_runs(texts) == [plain_runs(t) for t in texts]
    assert R.find_runs([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]
    assert R.find_runs([[b"%d" % (i % 9973) for i in range(40_000)]]) == [[(0, 40_000, 9973)]]


def test_runs_query(spark):
    from urbanlattice.llm import runs as R

    rng = random.Random(12)
    rows = [(i, " ".join(periodic_words(rng)) if i % 3 else "\t".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(200)))) for i in range(120)]
    rows += [(5, rows[5][1]), (None, "one two " * 20), (None, None), (500, None), (501, ""), (502, " \x0b\n "), (503, "é ü " * 30_000), (504, "z z " * 40)]
    got = sorted(map(tuple, R.digest(docs(spark, rows)).collect()), key=repr)
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w) if n < 10_000 else [(0, n, 2)]
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode())))
    assert got == sorted(want, key=repr)
    assert R.digest(docs(spark, [])).count() == 0
    kept = R.detect(docs(spark, rows[:3]))
    assert kept.columns == [*[c.split()[0] for c in ROW.split(", ")], "runs", "best", "collapsed"] and kept.count() == 3


def plain_search(rows, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    bags = [(i, Counter(words(t))) for i, t in rows]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * (25 + 75 * b.total() * n_docs // total))) for w in words(text) if b[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search(spark, monkeypatch):
    from urbanlattice.llm import lexical as L

    rng = random.Random(13)
    word = lambda: rng.choice(["the", "The", "é", "É", "x1", "a_b"]) if rng.random() < 0.5 else f"t{int(rng.paretovariate(0.7)) % 300}"
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randrange(60))) for i in range(700)]
    rows += [(3, rows[3][1])] * 3 + [(None, rows[4][1]), (None, rows[4][1]), (None, None), (900, None), (901, ""), (902, "--- \x00"), (903, text(60_000)), (904, rows[8][1]), (905, rows[8][1])]
    items = [(j, text(rng.randrange(1, 25))) for j in range(30)] + [(40, "the the the t5"), (41, None), (42, ""), (43, "unheard"), (44, rows[8][1]), (None, "t7"), (40, "é"), (45, text(3000))]
    monkeypatch.setattr(L, "BLOCK_DOCS", 20)
    monkeypatch.setattr(L, "QUERIES", 16)
    queries = spark.createDataFrame([(j, t, 1, 2) for j, t in items], "item_id bigint, text string, q int, score int")
    got = sorted(map(tuple, L.search(docs(spark, rows).repartition(6), queries).collect()), key=repr)
    assert got == plain_search(rows, items)
    assert L.search(docs(spark, []), queries).count() == 0
    assert L.search(docs(spark, rows[:5]), queries.limit(0)).count() == 0


def test_blocks_are_left_out(spark, monkeypatch):
    """Of blocks that lie far below the threshold no document is scored."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from urbanlattice.llm import lexical as L

    asked = L.Asked([Counter({b"rare": 1})], {b"rare": 100}, [0])
    made = [L._block(b, list(range(3 * b, 3 * b + 3)), [[b"rare"] * (9 - b) + [b"x"] * 3] * 3, 30, 300) for b in range(9)]
    schema = to_arrow_schema(StructType.fromDDL(L.BLOCK))
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], f.type) for c, f in enumerate(schema)], schema=schema)
    scored, scores = [], L.scores
    monkeypatch.setattr(L, "scores", lambda block, q: scored.append(block[2]) or scores(block, q))
    out = next(L._searcher(asked, 3)(iter([batch])))
    assert out.column(2).to_pylist() == [0, 1, 2] and scored == [[0, 1, 2]]


def plain_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOW)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(list)
    for i, lines in split:
        for k in {key(x) for x in lines if len(key(x)) >= 40}:
            holders[k].append(i)
    owner = {k: max((x for x in ids if x is not None), default=None) for k, ids in holders.items() if len(ids) >= 5}
    out = []
    for i, lines in split:
        stay = [x for x in lines if key(x) not in owner or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay).encode())))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(14)
    pool = [("Line é%d " % k) * rng.randrange(1, 9) for k in range(60)]
    line = lambda: rng.choice(["", " ", "\t\x0b"]) + rng.choice([str, str.upper, str.lower])(pool[int(rng.paretovariate(0.5)) % 60]) + rng.choice(["", "\r", "  "])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(9)))) for i in range(300)]
    at_limit = ["x" * 39, "x" * 40, "ü" * 39, "ü" * 40, " " + "y" * 39, " " * 40]
    rows += [(400 + k, "\n".join(at_limit)) for k in range(4)] + [(404, "\n".join(at_limit[:2])), (405, "\n".join(at_limit[2:]))]
    rows += [(None, "n" * 50)] * 6 + [(None, "\n".join(at_limit)), (7, rows[7][1]), (7, rows[7][1]), (600, None), (601, ""), (602, "\n\n"), (603, "q" * 300_000), (604, "\n".join(pool) * 50)]
    return rows + [(700 + k, "q" * 300_000) for k in range(5)]


def test_shared_lines(spark):
    from urbanlattice.llm import line_dedup as D
    from pyspark.sql import functions as F

    rows = line_rows()
    table = docs(spark, rows)
    for held in (D.HELD_BYTES, 0):  # probed where the documents are, and dealt to the shards
        out = D.dedup(table.repartition(5), held_bytes=held)
        assert out.columns == [*table.columns, "n_lines", "n_dropped", "kept"]
        got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()
        assert sorted(map(tuple, got), key=repr) == plain_lines(rows)
        assert D.dedup(docs(spark, []), held_bytes=held).count() == 0


def test_many_shards(spark, monkeypatch):
    from urbanlattice.llm import line_dedup as D

    rows = [(i, "\n".join(f"line {k:040d}" for k in range(i % 40))) for i in range(400)]
    monkeypatch.setattr(D, "SHARD_KEYS", 4)
    path, bits, n = D.build(docs(spark, rows), "doc_id", "text")
    assert n == 39 and bits == 4
    index = D.Shards(path, bits)
    pairs = D.hashes([f"line {k:040d}".encode() for k in range(60)])
    assert index.lost(pairs, np.full(60, -1)).tolist() == [k < 39 for k in range(60)]
    assert not index.lost(pairs, np.full(60, 399)).any()


def test_perfect_hash():
    from urbanlattice.llm.line_dedup import PerfectHash

    rng = np.random.default_rng(15)
    for n in (0, 1, 2, 63, 64, 5000, 200_000):
        a, b = rng.integers(0, 1 << 63, (2, n), np.int64).view(np.uint64)
        a[: n // 2] = a[:1]  # pairs that one word doesn't tell apart
        h = PerfectHash.build(a, b)
        assert h.n == n and sorted(h.find(a, b).tolist()) == list(range(n))
        assert sum(8 * len(w) for w in h.levels) <= n + 200
