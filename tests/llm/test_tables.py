"""Registered queries over the driver's tables, against SQL or plain versions; very long texts."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b).hexdigest()


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", ["op5_quality_cascade", "op6_warc_index_merge", "op9_odd_sketch_neardup", "op12_block_max_search", "op13_line_dedup"])
def test_same_as_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    key = [c for c in ("item_id", "rank", "doc_id", "page_id") if c in cols]
    a, b = (x[cols].sort_values(key).reset_index(drop=True).astype(object) for x in (got, want))
    a, b = a.where(a.notna(), None), b.where(b.notna(), None)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_licences_of_a_table(spark):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = {r["doc_id"]: r for r in entry.queries()["op1_license_scan"](spark, SF).collect()}
    for i, text in table("documents")[["doc_id", "text"]].itertuples(index=False):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        at = [(k, label) for phrase, label in base.items() for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_rules_of_a_table(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = {r["page_id"]: r for r in entry.queries()["op2_url_lm_filter"](spark, SF).collect()}
    for i, url in table("pages")[["page_id", "url"]].itertuples(index=False):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = [r for r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and (rule is None or got[i]["verdict"] == rules[rule])


def test_runs_of_a_table(spark):
    from test_runs_search_lines import plain_runs

    got = {r["doc_id"]: r for r in entry.queries()["op11_periodic_runs"](spark, SF).collect()}
    seen = 0
    for i, text in table("documents")[["doc_id", "text"]].itertuples(index=False):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")[:]
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n < 1500:
            found = plain_runs(w)
            seen += len(found)
            assert got[i]["n_runs"] == len(found) and got[i]["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode())
    assert seen > 5


def test_very_long_texts(spark):
    import tiktoken
    from tokenizers import Tokenizer

    from urbanlattice.llm import byte_bpe, fingerprints, licenses, packing, token_store, url_lm, warc

    rng = np.random.default_rng(9)
    words = np.array(["alpha", "Beta", "gámma", "delta,", "x1", "(e)", "\n", "ζ"])
    text = " ".join(words[rng.integers(0, len(words), 200_000)])
    rows = [(1, text + " Licensed under the MIT License."), (2, "short"), (3, text), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    at = lambda df: {r["doc_id"]: r for r in df.collect()}
    found = at(licenses.digest(licenses.scan(docs)))
    assert found[1]["labels"] == "mit" and found[1]["n_base"] == 1 and found[3]["labels"] == ""
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    got = at(token_store.store(docs, P.path("word_bpe_49k.json")))
    assert {i: (r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: (len(x), zlib.crc32(x)) for i, x in ids.items()}
    cut = packing.pieces(docs, P.path("word_bpe_49k.json")).collect()
    assert {i: sum(r["length"] for r in cut if r["doc_id"] == i) for i in ids} == {i: len(x) for i, x in ids.items()}
    prints = at(fingerprints.near_edits(docs))
    assert prints[3]["fingerprint"] == prints[4]["fingerprint"] and prints[1]["near_next"] < 0.2 and prints[3]["near_next"] == 1
    n = len(rows[2][1])
    assert prints[3]["n_chars"] == n and prints[3]["edited_sha256"] == sha((text[: n - n // 4] + text[: n // 4]).encode())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = spark.createDataFrame([(1, text[:300_000]), (2, "a" * 30_000)], "doc_id bigint, text string")
    coded = at(byte_bpe.round_trip(some, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    for i, t in ((1, text[:300_000]), (2, "a" * 30_000)):
        want = public.encode_ordinary(t)
        assert coded[i]["n_tokens"] == len(want) and coded[i]["ids_sha256"] == sha(",".join(map(str, want)).encode()) and coded[i]["decoded_sha256"] == sha(t.encode())
    pages = spark.createDataFrame([(1, "http://a.org/" + "p" * 100_000, text), (2, None, text), (None, "http://b.net/x", None), (None, None, None)], "page_id bigint, url string, html string")
    kept = {r["page_id"]: r for r in warc.archive(pages).where("page_id IS NOT NULL").collect()}
    assert kept[2]["record_type"] == "response" and kept[1]["refers_to"] == 2 and kept[1]["payload_bytes"] == len(text.encode())
    judged = url_lm.judge(pages.select("page_id", "url")).collect()
    assert len(judged) == 4 and {r["host"] for r in judged} == {"a.org", "b.net", ""} and max(len(r["path"]) for r in judged) == 100_001
