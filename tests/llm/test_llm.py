"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, reason string"
P = pytest.importorskip("public_tokenizers")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "extra") for i, t in enumerate(texts)], SCHEMA)


def some_texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "rue", "été", "MIT", "license", "cc", "by", "Apache"]
    long = " ".join(rng.choice(words) + str(rng.randrange(200)) for _ in range(3000))
    base = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(120))
    near = base.replace(base.split()[7], "other", 1)
    odd = [None, "", " ", "\n\n", "one", "GNU General Public License cc by cc by", "a" * 5000, "x y \x1c z", base, base, near, long, long, "it's  don't \n end "]
    return odd + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(30)]


@pytest.fixture(scope="module")
def texts():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_license_base_places(docs, texts, empty):
    from urbanlattice.llm import licenses as L

    got = by_id(L.digest(L.scan(docs)))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in L.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert L.digest(L.scan(empty)).count() == 0


def test_suppression_is_by_priority_then_length():
    from urbanlattice.llm.licenses import resolve

    rng = random.Random(2)
    for _ in range(200):
        found = [(s, s + rng.randrange(1, 9), rng.randrange(3), i) for i in range(rng.randrange(12)) for s in [rng.randrange(20)]]
        kept, want = [], [False] * len(found)
        for i in sorted(range(len(found)), key=lambda i: (-found[i][2], found[i][0] - found[i][1], found[i][3], found[i][0])):
            want[i] = any(a <= found[i][0] and b >= found[i][1] for a, b in kept)
            if not want[i]:
                kept.append(found[i][:2])
        assert resolve(found) == want


def test_url_rules_and_model(spark):
    from urbanlattice.llm import url_lm as U

    urls = [f"http://www.shop{i}.example.com/de/{i}" for i in range(60)] + [f"https://b.example.net/en/{i}?q=1" for i in range(60)] + ["http://x.net", "http://a.ORG/fr/x#y", None, "no scheme", "http://example.com/dex", "http://example.com/de/", "http://example.com/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id bigint, url string")
    rows = U.judge(df).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: r for r in rows}
    assert got[0]["verdict"] == "block" and got[60]["rule"] == "example.net/en/" and got[120]["rule"] is None and got[121]["rule"] == "org/fr/" and got[121]["host"] == "a.org"
    assert got[122]["host"] == "" and got[122]["rule"] is None and got[123]["path"] == "" and got[124]["rule"] is None and got[125]["rule"] == "example.com/de/"
    assert got[124]["verdict"] == "block"  # reads like the rejected ones
    assert U.judge(df.limit(0)).count() == 0


def test_language_mixture(spark, empty):
    from urbanlattice.llm import langid as I

    rng = random.Random(1)
    said = {"en": "the cat and this other thing with that was here".split(), "fr": "le chat est dans la maison avec une pomme verte".split()}
    rows = [(i, " ".join(rng.choices(said[k], k=40)), k) for i in range(200) for k in [("en", "fr")[i % 2]]] + [(900, None, "en"), (901, "123 !!", "fr"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = by_id(I.predict(df, I.learn(df.where(~I.held_out("doc_id")))))
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:200]) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    both = spark.createDataFrame([(1, " ".join(rng.choices(said["en"], k=90) + rng.choices(said["fr"], k=60)))], "doc_id bigint, text string")
    r = I.predict(both, I.learn(df)).first()
    assert set(r["lang_set"]) == {"en", "fr"} and r["lang_pred"] == "en" and 0.5 < r["score"] < 0.75
    assert I.predict(empty, I.learn(df)).count() == 0 and I.predict(docs_of(spark, ["abc"]), I.learn(empty)).first()["lang_pred"] == "und"


def test_token_store(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    from urbanlattice.llm import token_store as T

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got, start = by_id(T.store(docs, path)), 0
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4"))), repr(x)[:60]
        start += len(ids)
    assert T.store(empty, path).count() == 0


def test_elias_fano():
    from urbanlattice.llm.token_store import EliasFano

    rng = random.Random(3)
    for v in ([], [0], [7, 7, 7], [0, 1, 2**40], sorted(rng.randrange(10**6) for _ in range(999))):
        e, _ = EliasFano.frombytes(memoryview(EliasFano.encode(np.array(v, np.uint64)).tobytes()), 0)
        assert e.decode().tolist() == v and [e.select(i) for i in range(len(v))] == v


def test_quality(docs, texts, empty):
    from urbanlattice.llm import quality as Q

    got = by_id(Q.judge(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {k + j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    plain = docs.drop("reason")
    cascade = by_id(Q.cascade(plain))
    assert all((cascade[i]["reason"] is None) == got[i]["kept"] for i in got) and Q.judge(empty).count() == 0


@pytest.mark.parametrize("most_coarse", [256, 3])
def test_warc(spark, most_coarse):
    from urbanlattice.llm import warc as W

    rows = [(i, f"http://h{i % 3}.org/p{i % 5}#x", h) for i, h in enumerate(["<a>", "", None, "<a>", "é" * 9000, "<b>", "<a>"] * 9)] + [(None, None, "<b>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = W.archive(df, archive_bytes=200, range_captures=7, most_coarse=most_coarse).collect()
    assert len(got) == len(rows)
    most = {}
    for i, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if i is None else i)
    import base64

    for r in got:
        h = "<b>" if r["page_id"] is None else rows[r["page_id"]][2] or ""
        keeper = most[h]
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == keeper else ("revisit", keeper))
    order = {r["page_id"]: (r["index_range"], r["place"]) for r in got}
    key = lambda x: (W.url_key(x[1] or ""), W.stamp(W.FIRST_CAPTURE + (x[0] or 0)), -1 if x[0] is None else x[0])
    assert [x[0] for x in sorted(rows, key=key)] == sorted(order, key=order.get)
    assert len({r["index_range"] for r in got}) > 4
    # names that the operator uses inside, repeated rows, no rows
    odd = spark.createDataFrame([(1, "http://a/b", "x", "s", 1), (1, "http://a/b", "x", "s", 1), (None, None, None, "t", 2)], "page_id bigint, url string, html string, sha string, seconds int")
    assert [(r["page_id"], r["record_type"]) for r in W.archive(odd).orderBy("page_id").collect()] == [(None, "response"), (1, "response"), (1, "response")]
    assert W.archive(odd.limit(0)).count() == 0


def test_warc_reader_is_linear_and_whole():
    from urbanlattice.llm import warc as W

    rng = random.Random(6)
    payloads = [rng.randbytes(n) for n in (0, 1, W.SLICE - 1, W.SLICE, 3 * W.SLICE + 5, 700)] * 3
    raw = b"".join(W.record(i, "http://a/ü", W.stamp(i), p, "D", None) for i, p in enumerate(payloads))
    at = 0
    for i, p in enumerate(payloads):
        fields, payload, end = W.parse(raw, at)
        assert payload == p and fields["WARC-Record-ID"] == f"<urn:page:{i}>" and end > at
        at = end
    assert at == len(raw)
    with pytest.raises(ValueError):
        W.parse(raw[:-3], at - 3 if at < 3 else raw.rindex(b"\x1f\x8b\x08"))


def test_loser_tree():
    from urbanlattice.llm.warc import LoserTree

    rng = random.Random(4)
    for k in range(9):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(8))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_fingerprints(spark, docs, texts, empty):
    from urbanlattice.llm import fingerprints as Fp

    got = by_id(Fp.near_edits(docs))
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())
    same = {}
    for i, t in enumerate(texts):
        assert same.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert got[8]["near_next"] == 1.0 and got[9]["near_next"] > 0.8 and got[10]["near_next"] < 0.2
    assert Fp.near_edits(empty).count() == 0
    assert Fp.near_edits(docs_of(spark, ["only one"])).first()["near_next"] == 1.0


def test_byte_bpe(docs, texts):
    import tiktoken

    from urbanlattice.llm import byte_bpe as E

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=E.read_ranks(path), special_tokens={})
    got = by_id(E.round_trip(docs, path, P.PATTERN))
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    c, rng = E.codec(path, P.PATTERN), random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choice(" \n\tab'sé.1 ") for _ in range(rng.randrange(14)))
        assert c.encode(t) == ",".join(map(str, lib.encode_ordinary(t))), repr(t)


def brute_components(texts, size, threshold=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, texts, size):
    from urbanlattice.llm import neardup as N

    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    group = []
    for _ in range(40):  # each some edits away from the base: many pairs lie about the threshold
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 14)):
            w[k] = f"v{rng.randrange(10**6)}"
        group.append(" ".join(w))
    everything = texts + group + [" ".join(base)]
    want, sizes = brute_components(everything, size)
    got = by_id(N.link(docs_of(spark, everything), size=size))
    assert [got[i]["component_id"] for i in range(len(everything))] == want
    assert [got[i]["n_shingles"] for i in range(len(everything))] == sizes


def test_near_duplicates_of_nothing(spark, empty):
    from urbanlattice.llm import neardup as N

    assert N.link(empty).count() == 0
    assert [r["component_id"] for r in N.link(docs_of(spark, [None, "", "a b c"])).orderBy("doc_id").collect()] == [0, 1, 2]


def test_odd_sketch_estimates():
    from urbanlattice.llm import neardup as N

    rng = np.random.default_rng(3)
    for share in (0.8, 0.9, 0.97):
        both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        n = int(2000 * (1 - share) / (1 + share))
        a, b = N.odd_sketches(np.array([N.samples(np.concatenate([both[: 2000 - n], rng.integers(0, 2**63, n, dtype=np.uint64)])) for _ in "ab"], np.uint64))
        ones = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        assert abs(N.estimate(ones) - share) < 0.12 and ones <= N.most_ones(0.8)


def test_packing(spark, docs, texts):
    from urbanlattice.llm import packing as K
    from urbanlattice.llm.word_ids import encoder

    path = P.path("word_bpe_49k.json")
    cut = K.pieces(docs, path, capacity=512).cache()
    rows = K.pack(cut, cut.count(), capacity=512).collect()
    ids = {i: np.append(encoder(path).encode(t or ""), np.uint32(1)).astype("<u4") for i, t in enumerate(texts)}
    places = {}
    for r in rows:
        assert r["start"] == 512 * r["piece"] and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= -(-sum(map(len, ids.values())) // 512) + 2
