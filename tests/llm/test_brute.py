"""What the operators' methods compute, against plain versions of them."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def spark_hash(data: bytes, seed: int = 42) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def longs(values, seed: int = 42) -> int:
    """Spark's xxhash64 of several longs."""
    for v in values:
        seed = spark_hash(struct.pack("<q", SIGNED(v)), seed)
    return seed


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_licence_labels_without_prefilter(spark):
    from urbanlattice.llm import licenses as L

    rng = random.Random(3)
    rules = L.default_rules()
    notes = ["Licensed under the Apache License, Version 2.0", "the GNU General Public License v3", "SPDX-License-Identifier: MIT", "available under CC-BY-SA 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy", "under the terms of the BSD 3-Clause License for details", "GNU Lesser General Public License version 2.1", "mit license apache license", "CC BY CC BY", "all rights reserved", "Mozilla Public License 2.0", "the unlicense"]
    texts = [" ".join(rng.choice(notes + ["some", "words", "in", "between", "é"]) for _ in range(rng.randrange(1, 25))) for _ in range(120)] + ["", None, notes[0] * 400]
    got = by_id(L.digest(L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))))
    for i, text in enumerate(texts):
        folded = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + " "
        found = [(m.start(1), m.end(1), r.priority, k) for k, r in enumerate(rules) for m in re.finditer(f"(?= ({r.pattern}) )", folded)]
        kept, said = [], []
        for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[3], d[0])):
            inside = any(a <= d[0] and b >= d[1] for a, b in kept)
            kept += [] if inside else [d[:2]]
            if not inside or rules[d[3]].base:
                said.append(rules[d[3]])
        assert got[i]["labels"] == ",".join(sorted({r.label for r in said})) and got[i]["score"] == max((r.confidence for r in said), default=0.0), text


def test_url_scores_and_threshold(spark):
    from urbanlattice.llm import url_lm as U

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé-_") for _ in range(rng.randrange(1, 12)))
    urls = [f"http://{word()}.example.com/de/{word()}" for _ in range(70)] + [f"https://b.example.net/en/{word()}?q={word()}" for _ in range(70)] + [f"http://{word()}.org/{word()}" for _ in range(40)] + ["", "x" * 3000]
    got = {r["page_id"]: r for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    label = ["block" if "/de/" in u and "example.com" in u else "allow" if "example.net/en/" in u else None for u in urls]
    held = [SIGNED(spark_hash(u.encode())) % 5 == 0 for u in urls]
    chars = lambda u: "\x02" * U.ORDER + re.sub(r"[^\x21-\x7d]", "~", re.sub("[A-Z]", lambda m: m[0].lower(), u)) + "\x03"
    n = {v: defaultdict(int) for v in ("allow", "block")}
    for u, v, h in zip(urls, label, held):
        if v and not h:
            s = chars(u)
            for i in range(U.ORDER, len(s)):
                for k in range(U.ORDER + 1):
                    n[v][s[i - k : i + 1]] += 1
                    n[v][s[i - k : i] + "\0"] += 1  # the context's own count

    def p(v, gram):
        low = 1 / U.ALPHABET if len(gram) == 1 else p(v, gram[1:])
        return (n[v][gram] + U.SMOOTHING * low) / (n[v][gram[:-1] + "\0"] + U.SMOOTHING)

    scores = []
    for u in urls:
        s = chars(u)
        grams = [s[i - U.ORDER : i + 1] for i in range(U.ORDER, len(s))]
        scores.append(sum(round(1e6 * math.log(p("allow", g) / p("block", g))) for g in grams) / 1e6 / len(grams))
    assert all(abs(got[i]["score"] - x) < 2e-6 for i, x in enumerate(scores))
    known = [(x, v == "allow") for x, v, h in zip(scores, label, held) if v and h]
    rate = lambda cut: sum(x >= cut for x, g in known if g) / max(1, sum(g for _, g in known)) + sum(x < cut for x, g in known if not g) / max(1, sum(not g for _, g in known))
    best = max(rate(c / 1000) for c in range(-5000, 5000))
    # the operator's own cut, read off its verdicts, separates as well as any
    free = [(scores[i], got[i]["verdict"]) for i in range(len(urls)) if label[i] is None]
    accepted, rejected = [x for x, v in free if v == "allow"], [x for x, v in free if v == "block"]
    assert min(accepted, default=9) > max(rejected, default=-9)
    frame = spark.createDataFrame(known, "score double, good boolean")
    assert abs(rate(U.threshold(frame)) - best) < 0.1 and all((x >= U.threshold(frame)) == (v == "allow") for x, v in free)


def test_mixture_is_the_most_likely(spark):
    from urbanlattice.llm import langid as I

    rng = np.random.default_rng(2)
    for _ in range(5):
        p = rng.random((40, 3)) + 1e-3
        p /= p.sum(0)
        c = rng.integers(1, 9, 40).astype(float)
        theta, like = I.mixture(p, c, np.zeros(40, int), np.array([0]), np.full((1, 3), 1 / 3))
        value = lambda t: float((np.log(p @ t) * c).sum())
        assert abs(value(theta[0]) - like[0]) < 1e-9 and abs(theta[0].sum() - 1) < 1e-9
        grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 51) for b in np.linspace(0, 1 - a, 51)]
        assert like[0] > max(map(value, grid)) - 0.05
    # many labels, and a document of five languages: all are learnt, all are found
    words = {f"l{k:03d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}{chr(97 + k % 26)}" for x in "bcdfg"] for k in range(240)}
    rows = [(i, " ".join(random.Random(i).choices(words[f"l{i % 240:03d}"], k=60)), f"l{i % 240:03d}") for i in range(480)]
    trained = I.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(trained[0]) == 240
    got = I.infer([r[1] for r in rows[:240]] + [" ".join(w for k in range(5) for w in words[f"l{k:03d}"] * 40)], *trained)
    assert [g[0] for g in got[:240]] == [r[2] for r in rows[:240]] and set(got[-1][2]) == {f"l{k:03d}" for k in range(5)}


def plain_fingerprint(text):
    from urbanlattice.llm.fingerprints import BINS

    w = [x for x in re.split(r"[ \t-\r]+", text.lower()) if x]
    if not w:
        return ""
    h = [spark_hash(x.encode()) for x in w]
    if len(h) >= 5:
        s = {longs(h[i : i + 5]) for i in range(len(h) - 4)}
    else:
        s = {longs(h, spark_hash(struct.pack("<i", len(h))))}
    full = {}
    for x in s:
        b = x >> 57
        # as signed numbers, which is how they are sorted
        full[b] = min(full.get(b, x), x, key=SIGNED)
    out = []
    for b in range(BINS):
        t, j = 0, b
        while j not in full:
            j = ((7919 * (t + 1) % 8191) * b + 4973 * (t + 2) ** 2) % 8191 % BINS
            t += 1
        out.append(full[j] & 15)
    return "".join(f"{x:x}" for x in out)


def test_fingerprints_and_likeness(spark):
    from urbanlattice.llm import fingerprints as Fp

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (1, 3, 4, 5, 6, 9, 20, 60, 200, 700, 3000)]
    base = texts[-2].split()
    for k in (5, 20, 60):
        w = list(base)
        for i in rng.sample(range(len(w)), k):
            w[i] = f"v{i}"
        texts += [" ".join(base), " ".join(w)]
    texts += ["", "Été ÀB c D e F", None]
    got = by_id(Fp.near_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i]["fingerprint"] == plain_fingerprint(t) and got[i]["edited_fingerprint"] == plain_fingerprint(edited)
        for key, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = plain_fingerprint(t), plain_fingerprint(other)
            same = sum(x == y for x, y in zip(a, b)) / 128
            want = 1.0 if a == b == "" else 0.0 if "" in (a, b) else max(0.0, (same - 1 / 16) / (1 - 1 / 16))
            assert abs(got[i][key] - want) < 1e-12
            if min(len(t.split()), len(other.split())) > 150:
                x, y = shingles(t), shingles(other)
                assert abs(want - len(x & y) / len(x | y)) < 0.17


def best_fit_decreasing(sizes, capacity):
    import bisect

    gaps, bins = [], 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        bins += k == len(gaps)
        g = gaps.pop(k) if k < len(gaps) else capacity
        if g > s:
            bisect.insort(gaps, g - s)
    return bins


def test_no_more_sequences_than_best_fit():
    from urbanlattice.llm.packing import pack_sizes

    rng = random.Random(21)
    for _ in range(60):
        capacity = rng.choice([10, 100, 4096])
        sizes = [rng.randrange(1, rng.choice([capacity, capacity // 2]) + 1) for _ in range(rng.randrange(1, 400))]
        where, offset, bins = pack_sizes(np.array(sizes), capacity)
        assert bins <= best_fit_decreasing(sizes, capacity)
        for b in range(bins):
            spans = sorted((int(o), int(o) + s) for o, s, w in zip(offset, sizes, where) if w == b)
            assert spans and spans[0][0] == 0 and spans[-1][1] <= capacity and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_sequences_of_a_whole_table(spark, scale):
    """The registered query: no more sequences than best fit needs; here as few as the tokens fill."""
    from urbanlattice.llm import queries as Q

    rows = Q.queries()["op10_sum_of_squares_packing"](spark, f"/root/testdata/{scale}").select("length", "sequence_id").collect()
    used = len({r["sequence_id"] for r in rows})
    assert used <= best_fit_decreasing([r["length"] for r in rows], 4096) and used == -(-sum(r["length"] for r in rows) // 4096)


def test_placement_has_the_least_sum_of_squares():
    from urbanlattice.llm.packing import _placed

    rng = random.Random(12)
    for _ in range(40):
        capacity = rng.choice([10, 37, 100])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))]
        where, offset, bins = _placed(np.array(sizes), capacity, capacity)
        gaps: list[int] = []  # of all bins, full ones too
        square = lambda: sum(n * n for g, n in Counter(gaps).items() if g)
        place = {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            options = []
            for g in {g for g in gaps if g >= sizes[i]} | {None}:
                at = gaps.index(g) if g is not None else len(gaps)
                before = list(gaps)
                gaps[at:] = [(capacity if g is None else g) - sizes[i], *gaps[at + 1 :]]
                # a new bin only if no open one holds the piece; the smallest gap on ties
                options.append((g is None, square(), g or 0))
                gaps[:] = before
            new, _, g = min(options)
            used = place.setdefault(int(where[i]), 0)
            assert used == int(offset[i]) == (0 if new else capacity - g), (sizes, i)
            place[int(where[i])] += sizes[i]
            if new:
                gaps.append(capacity - sizes[i])
            else:
                gaps[gaps.index(g)] = g - sizes[i]
        assert len(place) == bins == len(gaps) and max(place.values()) <= capacity


def test_rejected_rows_reach_no_later_rule(spark):
    from urbanlattice.llm import quality as Q

    short = Q.RULES[0]
    # asks for a count and breaks off if a row with few words reaches it
    loud = Q.Rule("loud", lambda c: F.when(c("n_distinct_words") < 20, F.raise_error(F.lit("asked"))).otherwise(F.lit(False)))
    df = spark.createDataFrame([(1, "a few words", "x"), (2, " ".join(f"{chr(97 + i % 26)}word{chr(97 + i // 26)}" for i in range(40)), "y")], "doc_id bigint, text string, n_words string")
    at = Q.cascade_column(Q.with_words(df), [short, loud])
    assert {r["doc_id"]: r["_reason"] for r in at.collect()} == {1: "too_few_words", 2: None}
    ready = Q.cascade_column(Q._counted(df.select("doc_id", "text"), "text"), [short, loud], {c: F.col(c) for c in Q.COUNTS})
    assert {r["doc_id"]: r["_reason"] for r in ready.collect()} == {1: "too_few_words", 2: None}
    with pytest.raises(Exception, match="asked"):
        Q.cascade_column(Q.with_words(df), [loud, short]).collect()
    assert {r["doc_id"]: r["kept"] for r in Q.judge(df).collect()} == {1: False, 2: True}


def test_odd_rows_of_every_operator(spark):
    """Null and repeated ids, repeated rows, names that operators use inside, and no rows."""
    from urbanlattice.llm import byte_bpe, fingerprints, langid, licenses, neardup, packing, quality, token_store

    words = " ".join(f"{a}{b}" for a in "klmnprst" for b in ("a", "eau", "ing", "oi"))
    rows = [(None, words, "x"), (None, words, "y"), (None, None, None), (7, words, "x"), (7, words, "x"), (7, "other text", "z"), (3, "", "x"), (9, words + " " + words[::-1], "en")]
    schema = "doc_id bigint, text string, lang string"
    more = "id bigint, row bigint, digest string, keys string, _text string, _words string, _id bigint, _key string, piece int, part int, k0 string, t string, l string"
    df = spark.createDataFrame(rows, schema)
    df = df.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in more.split(", ")]).repartition(3)
    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
    trained = langid.learn(df)
    asked = {
        "licences": lambda d: licenses.digest(licenses.scan(d)),
        "languages": lambda d: langid.predict(d, trained),
        "tokens": lambda d: token_store.store(d, word),
        "quality": quality.judge,
        "fingerprints": fingerprints.near_edits,
        "bytes": lambda d: byte_bpe.round_trip(d, byte, P.PATTERN),
        "near": lambda d: neardup.link(d, size=2),
        "pieces": lambda d: packing.pack(cut := packing.pieces(d, word).cache(), cut.count()),
    }
    for name, f in asked.items():
        got = f(df).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows), name
        assert f(df.limit(0)).count() == 0, name
    near = neardup.link(df, size=2).collect()
    # copies are linked, also of rows without an id; the least id stands for them
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in near if r["n_shingles"] == 31) == [(-1, 31, 7), (-1, 31, 7), (7, 31, 7), (7, 31, 7)]
    starts = sorted((r["start"], r["n_tokens"]) for r in token_store.store(df, word).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and len(starts) == len(rows)
