"""The corpus pipeline, stage by stage, against brute force over rows with odd ids and columns of any name."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
# names that the operators use inside
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, reason string, _text string, `row` int, k0 string, digest string, `od``d name` string"


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    said = {"en": [f"{a}{b}" for a in ("th", "wh", "sh", "st") for b in ("e", "is", "at", "ere", "ing", "ough")], "fr": [f"{a}{b}" for a in ("qu", "ch", "ê", "l") for b in ("e", "oi", "eau", "aise", "ème", "ouille")]}
    texts = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        texts.append((sentences(rng, said[lang], 60 + i), lang))
    copy = texts[4][0]
    long = sentences(rng, [w + str(k) for w in said["en"] for k in range(60)], 30_000)
    odd = [(copy, "en")] * 3 + [(copy.replace(" ", "\n", 3), None), (long, "en"), (long + " end", "en"), ("a" * 700_000, "en"), ("few words", "en"), ("", "en"), (None, None), (sentences(rng, ["12", "34", "%%", "7"], 50), None), ("same line of words here\n" * 12, "en")]
    both = texts + odd
    ids = [None if i % 9 == 0 else 5 if i in (7, 20, 61) else i for i in range(len(both))]
    return [(ids[i], t, lang, "s", None, f"r{i}", f"t{i}", i, f"k{i}", None, f"o{i}") for i, (t, lang) in enumerate(both)]


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
    symbols = sum(c in "#*$%&|<>" for c in t)
    return not (len(w) < 20 or 100 * len(twice) > 30 * len(w) or chars < 2 * len(w) or chars > 20 * len(w) or 4 * symbols > len(w) or (dup >= 3 and 20 * dup > len(w)) or 20 * len(set(w)) < len(w) or 2 * sum(c.isalpha() or ord(c) > 127 for c in t) < chars)


def brute_groups(rows, size=5):
    """Indexes of rows by linked group, and those without a set alone."""
    sets = []
    for r in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_stages_against_brute_force(spark, rows):
    import corpus_pipeline as C
    from urbanlattice.llm import langid
    from urbanlattice.llm.word_ids import encoder

    def materialized(df):
        got = df.collect()
        return got, spark.createDataFrame(got, docs.schema).repartition(3) if got else docs.limit(0)

    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    (_, quality), (_, language), (_, dedup), (_, packing) = C.STAGES
    got, kept = materialized(quality(spark, docs, ""))
    assert sorted(r["k0"] for r in got) == sorted(r[8] for r in rows if brute_quality(r[1])) and kept.columns == docs.columns
    assert {tuple(r) for r in got} <= set(rows)

    # learning and inference by themselves, on the driver
    trained = langid.learn(kept.where(~langid.held_out("doc_id")))
    want = {r["k0"] for r, (lang, score, _, _) in zip(got, langid.infer([r["text"] for r in got], *trained)) if lang != "und" and score >= C.LEAST_SHARE}
    before = got
    got, kept = materialized(language(spark, kept, ""))
    assert {r["k0"] for r in got} == want and len(got) == len(want) < len(before) + 1 and {tuple(r) for r in got} <= set(rows)

    group, before = brute_groups(got), got
    got, kept = materialized(dedup(spark, kept, ""))
    assert {tuple(r) for r in got} <= {tuple(r) for r in before}
    place = {r["k0"]: g for r, g in zip(before, group)}
    assert sorted(place[r["k0"]] for r in got) == sorted(set(group))
    for r in got:
        ids = [x["doc_id"] for x, g in zip(before, group) if g == place[r["k0"]]]
        assert r["doc_id"] == min((i for i in ids if i is not None), default=None)

    e = encoder(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in got:
        ids = np.append(e.encode(r["text"] or ""), np.uint32(1)).astype("<u4")
        want.update((r["doc_id"], k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096)))
    pieces = packing(spark, kept, "").collect()
    assert Counter(tuple(r[:5]) for r in pieces) == want
    for s in {r["sequence_id"] for r in pieces}:
        at = 0
        for r in sorted((r for r in pieces if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_stages_of_nothing(spark, rows):
    import corpus_pipeline as C

    nothing = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, nothing, "")
        assert out.count() == 0 and (k == 3 or out.columns == nothing.columns)


def test_words_beyond_a_segment_hash_alike():
    from urbanlattice.llm import neardup as N

    long = "x" * (N.SEGMENT - 1), "y" * N.SEGMENT, "z" * (2 * N.SEGMENT + 17)
    for w in long:
        alone = N.word_hashes(w)
        assert len(alone) == 1
        for text in (w + " b", "a " + w, f"a {w}\tb", f"{'q ' * 1000}{w.upper()} {w}"):
            got = N.word_hashes(text)
            assert alone[0] in got.tolist() and len(got) == len(text.split())
    words = [f"w{k % 977}" for k in range(200_000)]
    got = N.word_hashes(" ".join(words))
    assert len(got) == len(words) and len(set(got.tolist())) == 977 and (got[:977] == got[977:1954]).all()
