"""Cases that the other tests' texts or oracles leave out."""

import zlib

import numpy as np
import public_tokenizers

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["a <|endoftext|> b", "a<|endoftext|>b", "a <|ENDOFTEXT|> b", "a <|endoftext|> x", "don<|endoftext|>'t", "  <|startoftext|>  <|endoftext|>\n", "<|endoftext|>", "<|endoftext", "e<|endoftext|>́ café", "<|endoftext|><|startoftext|>x<|<|endoftext|>", "plain words", ""]


def test_added_tokens_as_the_library(spark):
    from tokenizers import Tokenizer

    from urbanlattice.llm import packing, token_store

    library = Tokenizer.from_file(PATH)
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    starts = np.cumsum([0, *map(len, want)]).tolist()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.store(docs, PATH).collect()}
    assert got == {i: (starts[i], len(x), zlib.crc32(x)) for i, x in enumerate(want)}
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pieces(docs, PATH).collect()}
    assert got == {i: (len(x), zlib.crc32(x)) for i, x in enumerate(want)}


def test_segments_are_read_by_select(spark):
    from urbanlattice.llm import token_store

    # workers load the package anew, so that the probe has to be where read() looks: in its source
    names = token_store.read.__code__.co_consts
    inner = next(c for c in names if hasattr(c, "co_names") and c.co_name == "run")
    used = set(inner.co_names) | {n for c in inner.co_consts if hasattr(c, "co_names") for n in c.co_names}
    assert "select" in used and "decode" not in used
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7)) for i in range(5000)], "doc_id bigint, text string")
    got = sorted(token_store.store(docs, PATH).collect())
    assert len(got) == 5000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_capitals_with_marks_as_the_library(spark):
    """Capitals that compose with a mark that their small letters don't compose with, and the other way round."""
    import random

    from tokenizers import Tokenizer

    from urbanlattice.llm import packing, token_store

    library = Tokenizer.from_file(PATH)
    texts = [" ".join(f"{a}{chr(m)} x{a}{chr(m)}y" for m in range(0x300, 0x370)) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    texts += ["T\u0308", "a T\u0308b", "H\u0331h J\u030c W\u030aw Y\u030a", "T\u0323\u0308", "T\u0591\u0308", "T \u0308", "\u0344T\u0344"]
    rng = random.Random(5)
    some = "aTtHhJjwWyYI .,'0\n\u00e9\u00c9\u0130\u0131\u017f\u03a3\u0308\u0331\u030c\u030a\u0301\u0327\u0591\u1dc4\u212a\u4e2d"
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    starts = np.cumsum([0, *map(len, want)]).tolist()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.store(docs, PATH).collect()}
    assert got == {i: (starts[i], len(x), zlib.crc32(x)) for i, x in enumerate(want)}
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pieces(docs, PATH).collect()}
    assert got == {i: (len(x), zlib.crc32(x)) for i, x in enumerate(want)}


def test_labels_with_copies_of_one_text(spark):
    from urbanlattice.llm import langid

    rows = [(i, "lang one says the same thing", "aa") for i in range(3000)] + [(3000 + i, f"ein anderer text nummer {i}", "bb") for i in range(3000)] + [(9000, "uno solo", "cc"), (None, "quattro cinque", "cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for sample in (1, 30, 300):
        langs, logp = langid.learn(docs, sample=sample)
        assert langs == ["aa", "bb", "cc"] and (logp.max(0) - logp.min(0) > 0.5).all()
    said = {r["doc_id"]: r["h"] for r in docs.select("doc_id", langid.held_out("doc_id").alias("h")).collect()}
    assert said[None] is False


def test_schemes_of_the_shared_folder():
    from urbanlattice.llm.common import arrow_uri

    assert arrow_uri("s3a://bucket/a b") == "s3://bucket/a b" and arrow_uri("s3n://b/x") == "s3://b/x" and arrow_uri("hdfs://h:9/x") == "hdfs://h:9/x"
    assert arrow_uri("/tmp/x") == "file:///tmp/x" and arrow_uri("file:/tmp/x") == "file:///tmp/x" and arrow_uri("file:///tmp/x") == "file:///tmp/x"


def test_written_tables_are_deleted(spark):
    from urbanlattice.llm import common

    with common.scratch() as keep:
        one, two = common.written(spark.range(5), "one"), keep(common.written(spark.range(7), "two"))
    store, at = common.filesystem(one.written_to)
    assert store.get_file_info(at).type.name == "NotFound" and two.count() == 7
